from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panel360.operators import search

DOCS = {1: "the arni label the warning", 2: "arni coverage criteria potassium", 3: "the the the",
        4: "diet plan"}


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame([(k, t, "a" if k < 3 else "b") for k, t in DOCS.items()],
                                 "doc_id long, text string, grp string")


def brute(question):
    n, mean = len(DOCS), sum(len(t.split()) for t in DOCS.values()) / len(DOCS)
    scores = {}
    for key, text in DOCS.items():
        counts, total = Counter(text.split()), 0.0
        for term in set(question.split()) & set(counts):
            df = sum(term in t.split() for t in DOCS.values())
            tf = counts[term]
            total += math.log(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (
                tf + 1.2 * (.25 + .75 * len(text.split()) / mean))
        if total:
            scores[key] = round(total, 4)
    return scores


@pytest.mark.parametrize("bound", [None, 10])
def test_text_search_equals_brute_force(spark, corpus, bound):
    asked = spark.createDataFrame([("q1", "arni the criteria"), ("q2", "warfarin dose")],
                                  "qid string, question string")
    got = search.text_search(corpus, asked, 5, "doc_id", "text", max_queries=bound)
    assert {r.doc_id: r.score for r in got.filter("qid = 'q1'").collect()} == pytest.approx(
        brute("arni the criteria"), abs=1e-4)
    assert [r.qid for r in search.no_evidence(asked, got).collect()] == ["q2"]
    top = search.text_search(corpus, asked, 1, "doc_id", "text", max_queries=bound)
    assert [r.doc_id for r in top.collect()] == [2]
    covered = search.text_search(corpus, asked, 5, "doc_id", "text", min_coverage=0.6)
    assert {r.doc_id for r in covered.collect()} == {1, 2}


def test_filters_come_before_ranking(spark, corpus):
    asked = spark.createDataFrame([("q1", "the arni", "b")],
                                  "qid string, question string, grp string")
    got = search.text_search(corpus, asked, 5, "doc_id", "text", filters=("grp",))
    assert [r.doc_id for r in got.collect()] == [3]


def test_query_bound_is_enforced(spark, corpus):
    asked = spark.createDataFrame([("q1", "the"), ("q2", "the")], "qid string, question string")
    with pytest.raises(Exception, match="more than 1 queries"):
        search.text_search(corpus, asked, 5, "doc_id", "text", max_queries=1).collect()


def test_vectors_scan_and_join_agree(spark):
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [0.0, 1.0], 0), (4, [1.0, 0.0], 1),
         (5, [0.0, 0.0], 0)], "id long, v array<float>, grp int")
    asked = spark.createDataFrame([("q", [2.0, 0.0], 0)],
                                  "qid string, query_vector array<double>, grp int")
    want = [(1, 1.0), (2, 0.6)]
    joined = search.vector_search(vectors, asked, 2, "id", "v", ("grp",))
    scanned = search.vector_scan(vectors, asked, 2, "id", "v", filters=("grp",))
    for got in (joined, scanned):
        assert [(r.id, r.score) for r in got.orderBy("rank").collect()] == want
    everything = search.vector_scan(vectors, asked, 2, "id", "v")
    assert {r.id for r in everything.collect()} == {1, 4}
    with pytest.raises(Exception, match="more than 1 query vectors"):
        search.vector_scan(vectors, asked.union(asked), 2, "id", "v", max_queries=1).collect()
    with pytest.raises(ValueError):
        search.vector_search(vectors, asked, 2, "id", "v", ())


def test_scan_of_many_vectors_keeps_ties_and_odd_rows(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    data += [(300, None), (301, []), (302, [1.0]), (303, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(data, "id long, v array<float>").repartition(5)
    asked = spark.createDataFrame([(q, [float(x) for x in rng.normal(size=3)]) for q in range(6)] + [
        (6, None), (7, [0.0, 0.0, 0.0]), (8, [1.0])], "qid int, query_vector array<double>")
    got = {}
    for r in search.vector_scan(vectors, asked, 5, "id", "v").collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
    held = [(i, np.array(v)) for i, v in data if v and len(v) == 3 and any(v)]
    for q in asked.collect()[:6]:
        a = np.array(q.query_vector)
        scores = sorted(((-round(float(a @ v / np.sqrt(a @ a) / np.sqrt(v @ v)), 4), i)
                         for i, v in held))[:5]
        assert [i for _, i, _ in sorted(got[q.qid])] == [i for _, i in scores]
    assert set(got) == {*range(6), 8} and [i for _, i, _ in got[8]] == [302]


def test_corpus_terms_equal_the_index_and_shuffle_once(spark, corpus):
    direct = search.corpus_terms(corpus, "text")
    stored = search.term_stats(search.postings(corpus, "doc_id", "text"))
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, stored.collect()))
    plan = search.corpus_terms(corpus, "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fusion_adds_reciprocal_ranks(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "qid string, id long, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "qid string, id long, rank int")
    got = search.fuse([a, b], 3, "id").orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1, 3]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-6)


def test_lookup_prefers_the_closer_name(spark):
    people = spark.createDataFrame(
        [("P1", "Ann Smith"), ("P2", "Ann Smithson"), ("P3", "Bo Lee")],
        "patient_id string, full_name string").selectExpr(
        "*", "'NORTH' AS attributed_clinic", "'HMO' AS line_of_business", "50 AS age_years",
        "'F' AS sex")
    asked = spark.createDataFrame([("L", "ann smith")], "qid string, phrase string")
    got = search.patient_lookup(people, asked).orderBy("rank").collect()
    assert [r.patient_id for r in got] == ["P1", "P2"]
    assert people.select(F.count("*")).first()[0] == 3


def test_terms_not_asked_stay_in_the_scan(spark, monkeypatch):
    """The plan for any number of queries shuffles the counts of asked terms, and of all if they are too many."""
    texts = spark.createDataFrame([(i, f"asked word{i} other{i}", "a") for i in range(9)], "doc_id long, text string, grp string")
    queries = spark.createDataFrame([("q", "asked word3 none")], "qid string, question string")

    def plan_and_rows():
        df = search.text_search(texts, queries, 3, "doc_id", "text")
        return df._jdf.queryExecution().optimizedPlan().toString(), sorted(map(tuple, df.collect()))

    few, got = plan_and_rows()
    monkeypatch.setattr(search, "SENT_TERMS", 1)
    many, want = plan_and_rows()
    assert got == want and "LeftSemi" in few and "LeftSemi" not in many
