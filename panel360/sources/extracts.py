"""Typed CSV extracts: header skipped, loaded by position, '' and NULL are null, bad rows abort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panel360.schemas import EXTRACTS


def read_extract(spark: SparkSession, path: str, schema: T.StructType,
                 line_breaks: bool = True) -> DataFrame:
    """One extract. Quoted values may hold line breaks, for which each file is one task; a large
    file that is known to have none is split with `line_breaks=False`. Columns are read as text so that the word NULL is null in every type, then
    cast under ANSI rules, so a value that does not fit its type fails the load."""
    text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = (spark.read.schema(text)
           .option("header", True).option("enforceSchema", True).option("mode", "FAILFAST")
           .option("sep", ",").option("quote", '"').option("escape", '"')
           .option("nullValue", "").option("multiLine", line_breaks)
           .csv(path))
    return raw.selectExpr(*[
        f"CAST(nullif({f.name}, 'NULL') AS {f.dataType.simpleString()}) AS {f.name}"
        for f in schema.fields])


def read_extracts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All eight extracts of a folder, by table name."""
    return {name: read_extract(spark, f"{folder}/{name}.csv", schema)
            for name, schema in EXTRACTS.items()}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project a table to its declared columns and types; a missing column is an error."""
    present = set(df.columns)
    missing = [f.name for f in schema.fields if f.name not in present]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}"
                           for f in schema.fields])
