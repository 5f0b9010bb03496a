"""Nearest vectors against all products."""

from __future__ import annotations

import numpy as np
import pytest

from panel360.operators import vectors


def plain(data, asked, k):
    out = []
    for q, a in asked:
        if not a or not any(a):
            continue
        a = np.array(a) / np.linalg.norm(a)
        scores = sorted((-round(float(a @ (np.array(v) / np.linalg.norm(v))), 4), i) for i, v in data
                        if v and len(v) == len(a) and any(v))
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, data, asked, k, **options):
    corpus = spark.createDataFrame(data, "id long, v array<float>").repartition(4)
    queries = spark.createDataFrame(asked, "qid string, query_vector array<double>").repartition(3)
    got = sorted(tuple(r) for r in vectors.nearest(corpus, queries, k, "id", "v", **options).select(
        "qid", "id", "score", "rank").collect())
    want = plain([(i, None if v is None else [float(np.float32(x)) for x in v]) for i, v in data], asked, k)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1.01e-4)


def clustered(rng, n, size, groups):
    centres = rng.normal(size=(groups, size))
    return [(i, (centres[i % groups] + 0.1 * rng.normal(size=size)).tolist()) for i in range(n)]


@pytest.mark.parametrize("pivots", [1, 7, 60])
def test_against_all_products(spark, pivots):
    rng = np.random.default_rng(pivots)
    data = clustered(rng, 500, 6, 9)
    asked = [(f"q{i}", data[i][1]) for i in range(0, 500, 25)] + [("r", rng.normal(size=6).tolist())]
    check(spark, data, asked, 5, pivots=pivots)


def test_small_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    data = [(i, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(400)]
    data += [(400, None), (401, []), (402, [0.0] * 3), (403, [1.0]), (404, [2.0, 1.0])]
    data += [(405, [1.0, 0.0, 0.0])] * 90
    asked = [(f"q{i}", rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(12)]
    asked += [("a", None), ("b", []), ("c", [0.0] * 3), ("d", [3.0]), ("e", [1.0, 1.0]), ("f", [1.0] * 9)]
    check(spark, data, asked, 4, pivots=6)


def test_fewer_vectors_than_k_and_empty_tables(spark):
    check(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [("q", [1.0, 0.5])], 5)
    check(spark, [], [("q", [1.0])], 5)
    check(spark, [(1, [1.0])], [], 5)


def test_cells_are_left_out(spark, monkeypatch):
    """Far clusters are not compared: fewer visits than queries times cells."""
    rng = np.random.default_rng(8)
    data = clustered(rng, 600, 8, 12)
    corpus = spark.createDataFrame(data, "id long, v array<float>")
    queries = spark.createDataFrame([(f"q{i}", data[i][1]) for i in range(40)],
                                    "qid string, query_vector array<double>")
    counts, inner = [], vectors.stored

    def seen(df, name):
        out = inner(df, name)
        if name == "visits":
            counts.append(out.count())
        return out

    monkeypatch.setattr(vectors, "stored", seen)
    vectors.nearest(corpus, queries, 3, "id", "v", pivots=48).collect()
    assert sum(counts) < 40 * 48 / 3
