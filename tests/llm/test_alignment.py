"""Alignment against whole texts encoded by both libraries, and the laws of fragments."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panel360.llm import alignment, queries
from panel360.llm.alignment import Fragment, compose, finished, fragment, tokenizers

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return tokenizers(BPE, PIECES)


def plain(texts):
    """Per text: n_a, n_b, groups, links; by the libraries' own calls and byte offsets as sets."""
    a_side = Tokenizer.from_file(BPE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    symbols = alignment.byte_symbols()
    out = []
    for text in texts:
        data = b" " + (text or "").encode()
        a = a_side.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(symbols[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()
                   for i in b for p in [b_side.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            out.append((0, 0, [], []))
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (a_bytes, b_bytes)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, end in zip(ids, ends[side]):
                groups[next(k for k, c in enumerate(cuts) if c >= end)][side].append(i)
        at = [dict(zip(e, ids)) for e, ids in zip(ends, (a, b))]
        out.append((len(a), len(b), groups, [(at[0][c], at[1][c]) for c in cuts]))
    return out


def text_of(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


TEXTS = [None, "", " ", "a", "  two  blanks ", "é😀 naïve", "a▁b", "tab\tand\r\nlines\n\n", "<|endoftext|> <s>",
         "\x00\x1f", "x" * 300, " " * 90 + "z", "　wide　", "don't we'll", "日本語 テキスト", "12345 6.78e9"]


def sample(rng, n):
    words = ["the", "tokenization", "Zürich", "naïve", "😀", "don't", "12345", "x▁y", "\n", "  ", "\t", "ﬁ", "—"]
    return [" ".join(rng.choices(words[:7] + words[8:], k=rng.randint(1, 60))) for _ in range(n)]


def check(spark, texts, chunk):
    docs = spark.createDataFrame([(i, t, "g") for i, t in enumerate(texts)], "k long, text string, GROUPS string")
    made = alignment.align(docs.repartition(3), BPE, PIECES, chunk=chunk).cache()
    got = {r["k"]: r for r in alignment.score(made, BPE, PIECES).collect()}
    want = plain(texts)
    counts = Counter(link for *_, links in want for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    assert len(got) == len(texts)
    for i, (n_a, n_b, groups, links) in enumerate(want):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["groups"]) == (n_a, n_b, len(groups), text_of(groups)), texts[i]
        assert dict(zip(r["pairs"], r["times"])) == {a * 32000 + b: n for (a, b), n in Counter(links).items()}
        assert (r["n_links"], r["n_best"], r["count_sum"]) == (
            len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links))
        assert r["text"] == texts[i]


def test_against_the_libraries(spark):
    texts = TEXTS + sample(random.Random(1), 60)
    check(spark, texts + texts[:30], alignment.CHUNK)


def test_ranges_of_long_texts(spark):
    rng = random.Random(2)
    texts = TEXTS + sample(rng, 25) + ["nospaces" * 60, "a b " + "c" * 400 + " d e f", " ".join("abc" * 99)]
    texts += ["valid words " * 20 + "a▁b " + "more words " * 20]
    check(spark, texts + texts[-3:], 17)


def test_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(rng.choices(["tokenization", "Zürich", "don't", "x\ny", "😀"], k=120_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x" * 200_000)], "k long, text string")
    got = {r["k"]: r for r in alignment.align(docs, BPE, PIECES).collect()}
    both = tokenizers(BPE, PIECES)
    (a,), (b,) = both.encode([text])
    b = np.array(b)
    whole, pairs = fragment(both, a, both.a_len[a].cumsum(), b, both.b_len[b].cumsum())
    assert got[1]["groups"] == got[2]["groups"] == finished(whole)
    assert (got[1]["n_a"], got[1]["n_b"], got[1]["n_groups"]) == (len(a), len(b), len(pairs))
    assert got[3]["n_a"] > 0


def test_fragments_compose_in_any_tree(both):
    rng = random.Random(4)
    for text in sample(rng, 40):
        (a,), (b,) = both.encode([text])
        if not len(a):
            continue
        b = np.array(b, np.int64)
        a_end, b_end = both.a_len[a].cumsum(), both.b_len[b].cumsum()
        size = int(a_end[-1])
        bounds = sorted({0, size, *(rng.randint(0, size) for _ in range(rng.randint(0, 12)))})
        parts, links = [], []
        for low, high in zip(bounds, bounds[1:]):
            in_a, in_b = ((e > low) & (e <= high) for e in (a_end, b_end))
            some, pairs = fragment(both, a[in_a], a_end[in_a], b[in_b], b_end[in_b])
            parts.append(some)
            links += pairs.tolist()
        whole, pairs = fragment(both, a, a_end, b, b_end)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i:i + 2] = [compose(parts[i], parts[i + 1])]
        assert parts[0] == whole and sorted(links) == sorted(pairs.tolist())
        assert compose(alignment.NOTHING, whole) == whole == compose(whole, alignment.NOTHING)
        assert finished(whole) == text_of(plain([text])[0][2])


def test_most_pairs_holds_for_any_text(both):
    assert 0 < alignment.most_pairs(both) < 1_000_000


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k long, text string")
    made = alignment.align(empty, BPE, PIECES)
    assert alignment.score(made, BPE, PIECES).collect() == []
    assert isinstance(compose(alignment.NOTHING, alignment.NOTHING), Fragment)


def test_query(spark, tmp_path):
    texts = TEXTS + sample(random.Random(5), 20)
    docs = [(i if i else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, queries.SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_token_alignment(spark, str(tmp_path)).collect()}
    for i, (n_a, _, groups, links) in enumerate(plain(texts)):
        r = got[i if i else None]
        digest = hashlib.sha256(text_of(groups).encode()).hexdigest() if groups else ""
        assert (r["n_a"], r["groups_sha256"], r["n_links"]) == (n_a, digest, len(links))
