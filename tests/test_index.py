"""The segmented index: against a scan of the living texts, with revisions, bounds and stopped writers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panel360.operators import index, search

WORDS = ["the", "of", "arni", "label", "warning", "criteria", "potassium", "diet", "plan", "dose", "é", "x1"]


def corpus(spark, rng, keys):
    rows = [(k, " ".join(rng.choices(WORDS, weights=[30, 20, 5, 4, 3, 3, 2, 2, 2, 2, 1, 1],
                                     k=rng.randint(0, 40))), rng.choice("ab")) for k in keys]
    return spark.createDataFrame(rows + [(1000 + keys[0], None, "a"), (2000 + keys[0], "", "b")],
                                 "id long, text string, grp string")


def asked(spark, rng, n):
    rows = [(f"q{i}", " ".join(rng.choices(WORDS + ["unknown"], k=rng.randint(0, 5))), rng.choice("ab"))
            for i in range(n)]
    return spark.createDataFrame(rows, "qid string, question string, grp string")


def rows_of(df):
    return sorted(map(tuple, df.select("qid", "id", "score", "coverage", "rank").collect()))


def check(spark, path, texts, queries, k=5):
    want = rows_of(search.text_search(texts, queries, k, "id", "text"))
    for bounded in (True, False):
        found = index.search_index(spark, path, queries, k, "id", "text", ("grp",), bounded=bounded)
        assert rows_of(found) == want
    held = {r["id"]: (r["text"], r["grp"]) for r in texts.collect()}
    assert all((r["text"], r["grp"]) == held[r["id"]] for r in found.collect())
    filtered = index.search_index(spark, path, queries, k, "id", "text", filters=("grp",))
    assert rows_of(filtered) == rows_of(search.text_search(texts, queries, k, "id", "text", filters=("grp",)))


def test_one_segment_and_bounds(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    texts, queries = corpus(spark, rng, range(150)), asked(spark, rng, 25)
    path = str(tmp_path / "index")
    index.write_index(texts, path, "id", "text", ("grp",), buckets=3)
    check(spark, path, texts, queries)
    monkeypatch.setattr(index, "LEAD", 1)
    monkeypatch.setattr(index, "TASK_POSTINGS", 7)  # most terms are spread over several salts
    check(spark, path, texts, queries, k=2)
    floor = rows_of(index.search_index(spark, path, queries, 3, "id", "text", min_score=1.0))
    assert floor == rows_of(search.text_search(texts, queries, 3, "id", "text", min_score=1.0))


def test_bounds_leave_documents_out(spark, tmp_path):
    """A rare term decides: postings of the common one are not scored for the others."""
    rows = [(i, "common " * (1 + i % 3) + ("rare rare rare" if i < 8 else "")) for i in range(400)]
    path = str(tmp_path / "index")
    index.write_index(spark.createDataFrame(rows, "id long, text string"), path, "id", "text")
    queries = spark.createDataFrame([("q", "rare common")], "qid string, question string")
    scored = []
    inner = index.stored

    def seen(df, name):
        out = inner(df, name)
        scored.append((name, out.count()))
        return out

    index.stored = seen
    try:
        got = index.search_index(spark, path, queries, 2, "id", "text", bounded=True)
    finally:
        index.stored = inner
    assert got.count() == 2 and dict(scored)["sums"] <= 8


def test_pairs_do_not_leave_their_block(spark, tmp_path, monkeypatch):
    """Many documents have the asked term: of each block and query the best alone are written. Documents that
    share a key count together."""
    rows = [(i % 290, "dose " * (1 + i % 10) + "plan " * (i * 7 % 61)) for i in range(300)]
    rows += [(1000 + i, "diet") for i in range(900)]
    path = str(tmp_path / "index")
    index.write_index(spark.createDataFrame(rows, "id long, text string"), path, "id", "text")
    queries = spark.createDataFrame([("q", "dose"), ("r", "dose unknown"), ("s", None)], "qid string, question string")
    monkeypatch.setattr(index, "BLOCK_POSTINGS", 100)
    monkeypatch.setattr(index, "BLOCK_TERMS", 2)
    counts, inner = {}, index.stored

    def seen(df, name):
        out = inner(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(index, "stored", seen)
    found, want = (rows_of(index.search_index(spark, path, queries, 4, "id", "text", bounded=b)) for b in (True, False))
    assert found == want and {r[0] for r in found} == {"q", "r"}
    assert counts["sums"] < 100


def test_revisions_and_merge(spark, tmp_path):
    rng = random.Random(2)
    first, second, third = (corpus(spark, rng, k) for k in (range(80), range(60, 120), range(100, 110)))
    queries, path = asked(spark, rng, 20), str(tmp_path / "index")
    index.write_index(first, path, "id", "text", ("grp",))
    dead = first.join(second, "id", "left_semi").select("id", F.lit(0).alias("of"))
    index.write_segment(second, path, 1, "id", "text", ("grp",), dead)
    check(spark, path, first, queries)  # not committed, not read
    index.commit(spark, path, 1)
    living = first.join(second, "id", "left_anti").unionByName(second)
    check(spark, path, living, queries)
    dead = second.join(third, "id", "left_semi").select("id", F.lit(1).alias("of"))
    for _ in range(2):  # a writer that runs again replaces what it wrote
        index.write_segment(third, path, 2, "id", "text", ("grp",), dead)
    index.commit(spark, path, 2)
    living = living.join(third, "id", "left_anti").unionByName(third)
    check(spark, path, living, queries)
    target = str(tmp_path / "merged")
    index.merge(spark, path, target, "id", 2)
    check(spark, target, living, queries)
    for table in ("terms", "size"):
        one, two = (sorted(map(tuple, index.read_index(spark, p, table, "id").select(
            *(["term", "doc_freq", "occurrences"] if table == "terms" else ["docs", "words"])).collect()))
            for p in (path, target))
        assert one == two
    stats = search.term_stats(search.postings(living, "id", "text"))
    assert sorted(map(tuple, stats.collect())) == one_of(spark, path)


def one_of(spark, path):
    return sorted(map(tuple, index.read_index(spark, path, "terms", "id").select(
        "term", "doc_freq", "occurrences").collect()))


def test_empty_segments_and_no_commit(spark, tmp_path):
    path = str(tmp_path / "index")
    queries = spark.createDataFrame([("q", "the dose")], "qid string, question string")
    none = spark.createDataFrame([], "id long, text string, grp string")
    with pytest.raises(ValueError, match="no committed segment"):
        index.search_index(spark, path, queries, 3, "id", "text")
    index.write_index(none, path, "id", "text", ("grp",))
    assert index.search_index(spark, path, queries, 3, "id", "text").collect() == []
    texts = corpus(spark, random.Random(3), range(30))
    index.write_segment(texts, path, 1, "id", "text", ("grp",))
    index.commit(spark, path, 1)
    assert rows_of(index.search_index(spark, path, queries, 3, "id", "text")) == rows_of(
        search.text_search(texts, queries, 3, "id", "text"))
    everything = texts.select("id", F.lit(1).alias("of"))
    index.write_segment(none, path, 2, "id", "text", ("grp",), everything)
    index.commit(spark, path, 2)
    assert index.search_index(spark, path, queries, 3, "id", "text").collect() == []
    with pytest.raises(ValueError, match="without filters"):
        index.search_index(spark, path, queries, 3, "id", "text", min_coverage=0.5, bounded=True)


def test_texts_are_cut_once(spark, tmp_path):
    """Postings, terms and size come from the counts that stand with the documents."""
    path = str(tmp_path / "index")
    texts = corpus(spark, random.Random(4), range(20))
    index.write_index(texts, path, "id", "text")
    for r in index.read_index(spark, path, "documents", "id").collect():
        held = [w for w in (r["text"] or "").lower().split()]
        assert r["doc_length"] == len(held)
        assert [(t["term"], t["tf"]) for t in r["terms"]] == sorted(
            ((w, held.count(w)) for w in set(held)), key=lambda t: t[0].encode())


def test_distinctive_terms(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(0, "the rare rare other other"), (1, "the other"), (2, "the"), (50, "")]
    index.write_index(spark.createDataFrame(rows, "id long, text string"), path, "id", "text")
    got = index.distinctive_terms(spark, path, "id", F.col("id") % 50 == 0, n=2).collect()
    assert [(r["qid"], r["question"]) for r in got] == [(0, "rare other")]


def test_postings_hold_numbers_for_keys(spark, tmp_path):
    """Neither keys nor attributes are written again for each term; they come back with the postings."""
    path = str(tmp_path / "index")
    index.write_index(spark.createDataFrame([("a", "dose dose plan", "g"), ("b", "dose", "h")],
                                            "id string, text string, grp string"), path, "id", "text", ("grp",))
    assert set(spark.read.parquet(f"{path}/postings").columns) == {
        index.NUMBER, "doc_length", "term", "tf", "bucket", "segment"}
    rows = index.read_index(spark, path, "postings", "id").select("id", "grp", "term", "tf", "doc_length").collect()
    assert sorted(map(tuple, rows)) == [("a", "g", "dose", 2, 3), ("a", "g", "plan", 1, 3), ("b", "h", "dose", 1, 1)]
