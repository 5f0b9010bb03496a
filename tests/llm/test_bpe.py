"""Encoding and decoding against the tokenizers library."""

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from panel360.llm import bpe
from panel360.llm.queries import VOCABULARY, op3_bpe_encoding

PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "1", "$", "<|endoftext|>", "the", "xxx", "　", "\xa0",
         "中", "😀", "'", "ll", "\r\n", " \n ", "<|", "\x00", "\x1c", "\x85", "ſ", "²", "than", "in"]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(VOCABULARY)
    made.no_padding()
    made.no_truncation()
    return made


def unpack(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_random_texts(library):
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["x" * 5000, "ab" * 3000, " " * 300, "é" * 500, "".join(rng.choices("theranding", k=4000)), ""]
    vocabulary = bpe.vocabulary(VOCABULARY)
    for _ in range(2):  # the second time from memory
        packed = vocabulary.encode_all(texts)
        for text, mine in zip(texts, packed):
            ids = library.encode(text, add_special_tokens=False).ids
            assert unpack(mine) == ids, text
            assert vocabulary.decode(mine) == library.decode(ids, skip_special_tokens=False)


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY", 10)
    vocabulary = bpe.Vocabulary(VOCABULARY)
    rng = random.Random(6)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcdetr", k=5)) for _ in range(8)) for _ in range(3)]
        packed = vocabulary.encode_all([*texts, "y" * 200])
        assert [unpack(p) for p in packed[:3]] == [
            library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(vocabulary.met) <= 60 and all(len(w) <= bpe.SHORT + 1 for w in vocabulary.met)


def test_ids_that_are_no_text(library):
    vocabulary = bpe.vocabulary(VOCABULARY)
    for ids in ([164], [50256, 220, 164, 98], [11737, 11737], []):
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert vocabulary.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_query_nulls_repeats_and_clashes(spark, tmp_path, library):
    rows = [(1, "a b  c"), (1, "a b  c"), (None, None), (2, ""), (3, "<|endoftext|> z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, None, None, None) for r in rows], schema).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = op3_bpe_encoding(spark, str(tmp_path)).collect()
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((repr(key), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    clash = spark.createDataFrame([("x", "y", "z")], "text string, IDS string, decoded string")
    made = bpe.decode(bpe.encode(clash, VOCABULARY), VOCABULARY)
    assert made.first().decoded == "x" and len(made.columns) == 4
    assert bpe.encode(clash.limit(0), VOCABULARY).collect() == []


def test_checked_encoding(spark):
    rows = [(1, "a <|endoftext|> é😀"), (2, None), (3, ""), (4, " ".join(PARTS))]
    df = spark.createDataFrame(rows, "k long, text string")
    checked = bpe.encode(df, VOCABULARY, check=True)
    assert checked.columns == ["k", "text", "ids", "n_tokens", "round_trip"]
    assert all(r.round_trip for r in checked.collect())
    assert sorted(map(tuple, checked.drop("round_trip").collect())) == sorted(
        map(tuple, bpe.encode(df, VOCABULARY).collect()))
