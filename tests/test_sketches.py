"""Stored sketches of distinct counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panel360.operators import sketches


def test_roll_ups_of_sketches_are_close(spark, tmp_path):
    rows = spark.range(120_000).select(
        (F.col("id") % 5).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") * 7919 % 30_000).alias("v"))
    sketches.distinct_sketches(rows.union(rows), ["a", "b"], "v").write.parquet(str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    assert kept.count() == 35
    for grain in (["a", "b"], ["a"], []):
        exact = {tuple(r)[:-1]: r["n"] for r in rows.groupBy(*grain).agg(F.count_distinct("v").alias("n")).collect()}
        for r in sketches.distinct_estimates(kept, grain).collect():
            n = exact[tuple(r)[:-1]]
            assert abs(r["distinct_estimate"] - n) <= 4 * sketches.standard_error() * n


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("x", None), ("x", "1"), ("y", None), (None, "1")], "a string, v string")
    got = {r["a"]: r["distinct_estimate"] for r in sketches.distinct_estimates(
        sketches.distinct_sketches(rows, ["a"], "v"), ["a"]).collect()}
    assert got == {"x": 1, "y": 0, None: 1}
    assert sketches.distinct_estimates(sketches.distinct_sketches(rows.limit(0), ["a"], "v"), ["a"]).collect() == []
