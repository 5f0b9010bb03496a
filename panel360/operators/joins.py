"""Joins whose key may be NULL in many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPREAD = "_spread"


def left_join(left: DataFrame, right: DataFrame, key: str, spread: bool = True) -> DataFrame:
    """A left join in one pass over `left`. Rows whose key is NULL find no partner; they would all go to the
    task of the NULL key, so they take a second key from their other columns, which no row of `right`
    has. Rows with a key have 0 there, as have those of `right`. Without `spread` it is a plain join, for
    tables that are bucketed by the key and have it in every row."""
    if not spread:
        return left.join(right, key, "left")
    others = [F.col(f"`{f.name}`").cast("string") for f in left.schema.fields if f.name != key]
    second = F.when(F.col(key).isNull(), F.xxhash64(*others).bitwiseOR(F.lit(1))).otherwise(F.lit(0))
    return left.withColumn(_SPREAD, second).join(
        right.withColumn(_SPREAD, F.lit(0).cast("long")), [key, _SPREAD], "left").drop(_SPREAD)
