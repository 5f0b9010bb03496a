"""Helpers shared by the operators: scratch tables, lambda binding and batches of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panel360.sources.scratch import scratch, stored

__all__ = ["fresh", "let", "once", "scratch", "slices", "stored", "without"]

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with columns that are computed once for each row: they come out of a one-row generator,
    into which the optimizer does not push the filters and lambdas that use them."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it (case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` less the columns that an operator is about to add, case apart: its own replace them."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def slices(batch: pa.RecordBatch, column: int, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes in one column, or one row where that is longer."""
    ends = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().cumsum()
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
