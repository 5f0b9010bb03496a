"""Hits against a comparison of every span."""

import random
import re

import pytest

from panel360.llm import decontaminate as d
from panel360.llm.queries import op6_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, named = words(text), set(), set()
    for name, item in items:
        q = words(item)
        n = min(10, len(q))
        spans = {tuple(q[k:k + n]) for k in range(len(q) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k:k + n]) in spans:
                hit.update(range(k, k + n))
                named.add(name)
    return len(w), sorted(hit), sorted(named - {None})


def cases(seed):
    rng = random.Random(seed)
    some = ["a", "b", "A", "c-d", "é", "1", "x\x00y", "\n"]
    docs = [" ".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(6)]
    items = [(i, " ".join(rng.choices(some, k=rng.choice([0, 1, 3, 5, 6, 9, 10, 11, 14])))) for i in range(5)]
    for k in range(3):
        w = docs[k].split()
        items.append((10 + k, " ".join(["zz", *w[1:13], "yy"])))
    return [*docs, "", ". ,", None], items


@pytest.mark.parametrize("seed", range(40))
def test_index(seed):
    docs, items = cases(seed)
    index, laid = d.Index(items, d.SPAN, d.GRAM), d.Words([(t or "").encode() for t in docs])
    places, found = index.hits(laid)
    first = laid.count.cumsum() - laid.count
    for i, text in enumerate(docs):
        assert (int(laid.count[i]), sorted(p - int(first[i]) for p in places.get(i, ())),
                sorted({index.names[k] for k in found.get(i, ())})) == brute(text, items)


@pytest.mark.parametrize("block", [10 ** 9, 200, 60])
def test_blocks_give_the_same(spark, monkeypatch, block):
    monkeypatch.setattr(d, "_BLOCK_WORDS", 7)
    docs, items = [], []
    for seed in range(3):
        more, asked = cases(seed)
        docs += more
        items += [(100 * seed + i, t) for i, t in asked]
    items += [(None, items[5][1]), (7, items[6][1]), (7, items[6][1]), (8, None)]
    docs += [docs[0], docs[0]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)],
                               "doc_id long, text string, Items string, n_words int")
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = d.decontaminate(df, asked, block_bytes=block).collect()
    assert len(rows) == len(docs)
    for r in rows:
        places = [p for s in r.hit_spans for p in range(s.start, s.end)]
        assert (r.n_words, places, r["items"]) == brute(r.text, items)


def test_long_text_and_common_passage(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(i, "filler words " * (30000 if i == 0 else 3) + passage) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, passage.upper())], "item_id long, text string")
    for r in d.decontaminate(df, items).collect():
        assert [s.end - s.start for s in r.hit_spans] == [11] and r["items"] == [1, 2]


def test_empty(spark, tmp_path):
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "a b", None, None, None)], docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = op6_decontamination(spark, str(tmp_path)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    none = spark.createDataFrame([], docs)
    assert d.decontaminate(none, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_blocks_are_bounded(spark, monkeypatch):
    sizes, made = [], d.Index.__init__

    def init(self, items, span, gram):
        sizes.append(sum(len(t) for _, t in items))
        made(self, items, span, gram)

    monkeypatch.setattr(d.Index, "__init__", init)
    monkeypatch.setattr(d, "CHAIN", 100)
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(400))
    items = [(1, "ten words said again and again in one short text")] * 300 + [(2, long)]
    items += [(i, " ".join(f"{i}x{k}" for k in range(12))) for i in range(3, 9)]
    w = long.split()
    rows = [(i, "pad " * i + " ".join(w[at:at + 12]) + " pad") for i, at in enumerate(range(0, 389, 7))]
    rows += [(100, items[0][1]), (101, items[-1][1]), (102, long), (103, " ".join(w[20:29]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = d.decontaminate(df, asked, block_bytes=1000).collect()
    assert 1 < len(sizes) < 15 and max(sizes) <= 1000
    for r in got:
        places = [p for s in r.hit_spans for p in range(s.start, s.end)]
        assert (r.n_words, places, r["items"]) == brute(r.text, items)
