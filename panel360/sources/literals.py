"""Small tables written in the source."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return str(value)


def inline_rows(spark: SparkSession, schema: T.StructType, rows: Sequence[Sequence[Any]]) -> DataFrame:
    """Rows as a VALUES clause. Their size is known to the optimizer, so Spark itself decides
    whether a join with them is a broadcast; rows built on the Python side have no size."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(f.name for f in schema.fields)
    typed = [f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields]
    return spark.sql(f"SELECT {', '.join(typed)} FROM VALUES {values} AS t({columns})")
