"""Shards of near-equal bytes by sampled splitters.

Rows are ordered by a key whose upper 40 bits come from the text and whose lower 24 bits come from
the id: copies stand side by side, and a group of copies of any size can be cut. A sample drawn
with probability in proportion to size gives quantiles that cut the key space into ranges of
about equal bytes; ranges that turn out overfull are divided further, one in which all rows
share a key by the rows' own hash. Exact sums of each range then give every row its place in the
whole order, and a row goes to the shard in which the middle of its bytes falls. So a shard's
bytes miss the mean by at most one row's bytes, and at most `shards - 1` groups of copies are cut.

Only key, id, size and checksum are shuffled. The driver gets a sample of about `DRAWS` rows per
range and one sum per range.

Defined results: null text counts as empty with size 8; null ids are ordered first among copies;
repeated rows take successive slots; an empty table gives no rows; with fewer rows than shards some
shards stay empty. Columns beyond id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panel360.functions.arrow import map_arrow
from panel360.llm.common import stored

SHARDS, ROWS_PER_RANGE, DRAWS, OVERFULL, ROUNDS = 24, 1_000_000, 64, 2.0, 6


def splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> np.ndarray:
    """Keys that cut a weighted sample into ranges of about equal weight; a key equal to a splitter
    belongs behind it."""
    if not len(keys):
        return np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    filled = np.cumsum(weights[order])
    at = np.searchsorted(filled, filled[-1] * np.arange(1, ranges) / ranges, side="left")
    return np.unique(keys[order][np.minimum(at, len(keys) - 1)])


def _in_ranges(rows: DataFrame, cuts: np.ndarray, parts: dict[int, int]) -> DataFrame:
    """`rows` with their range and, in ranges of a single key, a division by the rows' own hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cuts.searchsorted(batch.column("place").to_numpy(), side="right")
            own = batch.column("own").to_numpy()
            sub = np.zeros(len(at), np.int64)
            for r, n in parts.items():
                sub[at == r] = own[at == r] % n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at, pa.int64()), pa.array(sub, pa.int64())],
                [*batch.schema.names, "range", "sub"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(rows, run, f"{fields}, range long, sub long")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
          rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Key, size, text_crc32, shard and slot (from 0 in each shard) of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by_text = F.xxhash64(body)
    upper, lower = -1 << 24, (1 << 24) - 1
    rows = stored(df.select(
        F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), by_text.alias("by_text"),
        by_text.bitwiseAND(F.lit(upper)).bitwiseOR(
            F.xxhash64(F.col(key)).bitwiseAND(F.lit(lower))).alias("place"),
        F.monotonically_increasing_id().alias("row"))
        .withColumn("own", F.xxhash64("row")), "shard-rows")
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    ranges = max(shards, math.ceil(count / rows_per_range))
    cuts, parts = _sampled(rows, total or 1, ranges), {}
    for last in range(ROUNDS + 1):
        sums = _in_ranges(rows, cuts, parts).groupBy("range", "sub").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
            F.min("place").alias("low"), F.max("place").alias("high")).orderBy("range", "sub").collect()
        over = [] if last == ROUNDS else [
            r for r in sums if r["n"] > 1 and r["bytes"] > OVERFULL * total / ranges]
        new = [c for r in over if r["low"] < r["high"]
               for c in _evenly(r["low"], r["high"], math.ceil(2 * r["bytes"] * ranges / total))]
        single = {r["range"]: math.ceil(r["bytes"] * ranges / total) for r in over
                  if r["low"] == r["high"] and r["range"] not in parts}
        if new:
            cuts, parts = np.union1d(cuts, np.array(new, np.int64)), {}
        elif single:
            parts = parts | single
        else:
            break
    offsets, before, first = [], 0, 0
    for r in sums:
        offsets.append((r["range"], r["sub"], before, first))
        before, first = before + r["bytes"], first + r["n"]
    starts = df.sparkSession.createDataFrame(
        offsets, "range long, sub long, bytes_before long, rows_before long")
    inside = Window.partitionBy("range", "sub").orderBy("place", "by_text", "key", "row")
    placed = _in_ranges(rows, cuts, parts).select(
        "*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("till"),
        F.row_number().over(inside).alias("number"))
    middle = 2 * (F.col("bytes_before") + F.col("till")) - F.col("size")
    placed = stored(placed.join(starts, ["range", "sub"]).select(
        "key", "size", "text_crc32",
        F.floor(middle * shards / (2 * (total or 1))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("number") - 1).alias("at")), "shards")
    firsts = dict(placed.groupBy("shard").agg(F.min("at")).collect())
    first_at = F.get(F.array(*[F.lit(firsts.get(s, 0)) for s in range(shards)]), F.col("shard"))
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard",
                         (F.col("at") - first_at).cast("long").alias("slot"))


def _sampled(rows: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Splitters from a sample of about DRAWS rows per range, each row drawn in proportion to size."""
    expected = F.col("size") * (DRAWS * ranges / total)
    chance = F.pmod(F.xxhash64("place", "own"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(chance < expected).select(
        "place", F.greatest(expected, F.lit(1.0)).alias("weight")).collect()
    return splitters(np.array([r[0] for r in drawn], np.int64),
                     np.array([r[1] for r in drawn], np.float64), ranges)


def _evenly(low: int, high: int, pieces: int) -> list[int]:
    return sorted({low + (high - low) * i // pieces for i in range(1, pieces)} - {low} | {high})
