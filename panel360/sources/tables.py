"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table as a whole. Hive-style partitions serve queries that filter on a clinic."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """With the schema it was written with, a partition column keeps its type: '007' stays text."""
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Replace a table of the catalog, one sorted file per bucket of the key. Tables with the same buckets
    of the same key are joined, ranked and aggregated by it without moving a row. Rows without key, which
    would all be one bucket, are a table of their own, `<name>_unkeyed`."""
    (df.filter(F.col(key).isNotNull()).repartition(buckets, key).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    df.filter(F.col(key).isNull()).write.mode("overwrite").format("parquet").saveAsTable(f"{name}_unkeyed")


def read_bucketed(spark: SparkSession, name: str, keyed_only: bool = False) -> DataFrame:
    """A table that `write_bucketed` wrote, or its rows with a key alone, which keep their buckets."""
    keyed = spark.table(name)
    return keyed if keyed_only else keyed.unionByName(spark.table(f"{name}_unkeyed"))


def append_rows(df: DataFrame, path: str, defaults: dict[str, Column] | None = None) -> None:
    """Append log rows; a column the caller left out gets its default."""
    for name, value in (defaults or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    df.write.mode("append").parquet(path)


def audit_defaults(user: str, role: str) -> dict[str, Column]:
    """Defaults of the answer log: a fresh id, the clock, and who asked under which role."""
    return {"audit_id": F.uuid(), "asked_at": F.current_timestamp().cast("timestamp_ntz"),
            "asked_by": F.lit(user), "asked_role": F.lit(role)}


def run_defaults() -> dict[str, Column]:
    """Defaults of an evaluation run. `run_id` has none: it groups the rows of one run."""
    return {"run_at": F.current_timestamp().cast("timestamp_ntz")}
