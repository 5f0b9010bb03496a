"""Laws of the shards: near-equal bytes, gapless slots, few cut groups."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panel360.llm import sharding
from panel360.llm.queries import op8_sharding

SCHEMA = "doc_id long, text string, shard string"


def check(rows, got, shards):
    assert sorted((repr(k), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in rows) \
        == sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got)
    size, slots = [0] * shards, defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for held in slots.values():
        assert sorted(held) == list(range(len(held)))
    mean, most = sum(size) / shards, max(r.size for r in got)
    assert all(abs(s - mean) <= most for s in size)
    groups = defaultdict(set)
    for r in got:
        groups[r.text_crc32].add(r.shard)
    assert sum(len(g) - 1 for g in groups.values()) <= shards - 1 + 2  # a cut each; CRC clashes aside


@pytest.mark.parametrize("per_range", [10 ** 6, 40])
def test_shards(spark, per_range):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([1, 5, 50, 400]) + str(i), "x") for i in range(1200)]
    rows += [(5000 + i, "the same text", "x") for i in range(600)] + [(None, None, None), (1, "", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.shard(df, rows_per_range=per_range).collect()
    check(rows, got, 24)
    assert {r.shard for r in got} == set(range(24))


def test_hot_rows_that_share_their_key(spark):
    rows = [(7, "repeated", "x")] * 900 + [(i, f"t{i}", "x") for i in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(4), rows_per_range=50).collect()
    check(rows, got, 24)


def test_same_shards_however_the_rows_lie(spark):
    rows = [(i, f"text {i % 50} " * (i % 9), "x") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(tuple, sharding.shard(d, shards=7).collect())) for d in (df, df.repartition(9)))
    assert a == b


def test_fewer_rows_than_shards_and_none(spark, tmp_path):
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "a", None, None, None)], docs).write.parquet(f"{tmp_path}/documents.parquet")
    row = op8_sharding(spark, str(tmp_path)).first()
    assert (row.size, row.slot, row.law, row.grown_shard) == (9, 0, "bytes", None)
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []


def test_splitters():
    cuts = sharding.splitters(np.array([5, 1, 9, 3]), np.array([1.0, 1, 1, 1]), 2)
    assert cuts.tolist() == [3]
    assert sharding.splitters(np.empty(0, np.int64), np.empty(0), 4).tolist() == []
