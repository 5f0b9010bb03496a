"""Exact cosine top k for any number of unfiltered queries.

Vectors of length 1 are as near as their cosine is high, so the triangle inequality holds. Some vectors
serve as pivots; every vector belongs to the cell of its nearest pivot, and a cell knows how near and how
far from the pivot its vectors are. A query is first compared with the nearest cells that together hold
k vectors. The k-th score so far then rules out each cell whose vectors all lie too far from the
query, by the query's distance to the pivot alone; the cells that are left are compared too. Pivots
decide how much is ruled out, never what is found.

Cells are cut into blocks of about `BLOCK_BYTES`, and the queries of a cell into blocks of `QUERY_BLOCK`. A
task multiplies one block of vectors with one of queries, as matrices, and hands on the best k of each
query; the best of the blocks are merged. A cell that holds a third of all vectors is many blocks, a
cell that all queries visit is read by many blocks of queries. Only the pivots and one row per cell,
`PIVOTS` at most for each length of vectors, are known to the driver and all tasks.

Defined results: null, empty and zero vectors have no cosine, are not found and find nothing; a query
meets vectors of its own length; repeated rows are each found; scores have four places, and of equal
scores the smaller key comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.functions.arrow import map_arrow
from panel360.operators.search import _top
from panel360.sources.scratch import stored

PIVOTS, BLOCK_BYTES, QUERY_BLOCK = 128, 4_000_000, 2_048
_SLACK = 1e-4  # for scores that are equal once rounded


def nearest(corpus: DataFrame, queries: DataFrame, k: int, key: str, vector: str, query_key: str = "qid",
            query_vector: str = "query_vector", pivots: int = PIVOTS) -> DataFrame:
    """query key, key, score and rank of the k nearest vectors of each query."""
    unit = _units(corpus, key, vector)
    chosen = unit.orderBy(F.xxhash64("id"), "id", "body").limit(pivots).select("body").distinct().collect()
    cells = _Cells([np.frombuffer(r["body"]) for r in chosen])
    placed_schema = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()),
        *unit.schema.fields, T.StructField("deal", T.LongType())])
    placed = stored(map_arrow(unit.withColumn("deal", F.monotonically_increasing_id()),
                              _placed(cells, placed_schema.names), placed_schema), "cells")
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"),
                                        F.max("far").alias("high")).collect():
        cells.held[r["cell"]] = r["n"], r["low"], r["high"]
    asked = stored(_units(queries, query_key, query_vector).withColumn(
        "deal", F.monotonically_increasing_id()), "queries")
    # Which cells a query visits follows from its vector alone, so the second round can tell which the
    # first has visited.
    first = stored(_products(placed, asked.withColumn("floor", F.lit(None).cast("double")), cells, k), "best")
    place = Window.partitionBy("qid").orderBy(F.desc("score"))
    floors = first.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).filter(
        F.col("place") == k).select(F.col("qid").alias("id"), F.col("score").alias("floor"))
    again = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    second = _products(placed, again, cells, k)
    found = first.union(second).select(F.col("qid").alias(query_key), F.col("id").alias(key),
                                       F.round("score", 4).alias("score"))
    return _top(found, query_key, key, k)


def _units(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and body: the vectors of length 1 as bytes, without those that have no direction."""
    schema = T.StructType([T.StructField("id", rows.schema[key].dataType), T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, bodies = [], []
            for i, values in enumerate(batch.column(1)):
                if values.is_valid and len(values):
                    made = np.asarray(values.values.to_numpy(zero_copy_only=False), float)
                    size = np.sqrt(made @ made)
                    if np.isfinite(size) and size > 0:
                        keep.append(i)
                        bodies.append((made / size).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(bodies, pa.binary())], schema.names)

    return map_arrow(rows.select(key, F.col(vector).cast("array<double>")), run, schema)


class _Cells:
    """Pivots by the length of their vectors, and what is held near each. A length without pivot is one
    cell, of which nothing is known."""

    def __init__(self, pivots: list[np.ndarray]):
        self.pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(p) for p in pivots}):
            at = [i for i, p in enumerate(pivots) if len(p) == size]
            self.pivots[size] = np.array(at), np.array([pivots[i] for i in at])
        self.held: dict[int, tuple[int, float, float]] = {}

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells for vectors of one length, and how far each vector is from their pivots."""
        size = vectors.shape[1]
        if size not in self.pivots:
            return np.array([-size]), np.zeros((len(vectors), 1))
        at, matrix = self.pivots[size]
        return at, np.sqrt(np.maximum(0, 2 - 2 * (vectors @ matrix.T)))

    def rows_of(self, cell: int) -> int:
        """How many vectors a block of the cell has."""
        size = -cell if cell < 0 else next(s for s, (at, _) in self.pivots.items() if cell in at)
        return max(64, BLOCK_BYTES // (8 * size))


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch and their vectors, one length after the other."""
    bodies = batch.column(column).to_pylist()
    sizes = np.array([len(b) // 8 for b in bodies])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(bodies[i] for i in at)).reshape(-1, size)


def _placed(cells: _Cells, names: list[str]):
    """Each vector in the cell of its nearest pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in _by_length(batch, 1):
                known, far = cells.distances(vectors)
                best = far.argmin(axis=1)
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(known[best], pa.int32()), pa.array(far[np.arange(len(at)), best]), *some.columns],
                    names)
    return run


def _visits(cells: _Cells, k: int, names: list[str]):
    """The cells that each query visits: without a floor the nearest that hold k vectors, with one all
    others that may hold a vector above it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in _by_length(batch, batch.schema.get_field_index("body")):
                known, far = cells.distances(vectors)
                n, low, high = (np.array(x) for x in zip(*(cells.held.get(c, (0, 0.0, 0.0))
                                                           for c in known.tolist())))
                order = np.argsort(far, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                near = np.zeros(far.shape, bool)
                np.put_along_axis(near, order, before < k, axis=1)
                floor = np.array([np.nan if f is None else f for f in
                                  batch.column("floor").take(pa.array(at)).to_pylist()], float)
                reach = np.sqrt(np.clip(2 - 2 * (floor - _SLACK), 0, None))[:, None] + 1e-6
                least = np.maximum(far - high, low - far)
                if known[0] < 0:
                    least = np.zeros(far.shape)
                wanted = np.where(np.isnan(floor)[:, None], near, ~near & ~(least > reach)) & (n > 0)
                row, cell = np.nonzero(wanted)
                some = batch.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(known[cell], pa.int32()), *(some.column(c) for c in ("id", "body", "deal"))], names)
    return run


def _products(placed: DataFrame, asked: DataFrame, cells: _Cells, k: int) -> DataFrame:
    """The best k of each query (qid, id, score) in each block of the cells it visits."""
    schema = T.StructType([placed.schema["cell"], asked.schema["id"], asked.schema["body"], asked.schema["deal"]])
    visits = stored(map_arrow(asked.select("id", "body", "deal", "floor"), _visits(cells, k, schema.names), schema),
                    "visits")
    session = placed.sparkSession
    counts = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = [(c, -(-cells.held[c][0] // cells.rows_of(c)), -(-n // QUERY_BLOCK)) for c, n in counts.items()]
    sizes = F.broadcast(session.createDataFrame(blocks, "cell INT, blocks LONG, query_blocks LONG"))
    id_type, qid_type = placed.schema["id"].dataType, asked.schema["id"].dataType

    def deal(of: str):
        return F.pmod(F.xxhash64("deal"), F.col(of))

    def every(of: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    vectors = placed.join(sizes, "cell").select(
        "cell", deal("blocks").alias("block"), every("query_blocks").alias("query_block"),
        F.lit(0).alias("kind"), "id", F.lit(None).cast(qid_type).alias("qid"), "body")
    wanted = visits.join(sizes, "cell").select(
        "cell", every("blocks").alias("block"), deal("query_blocks").alias("query_block"),
        F.lit(1).alias("kind"), F.lit(None).cast(id_type).alias("id"), F.col("id").alias("qid"), "body")
    unit = ["cell", "block", "query_block"]
    both = vectors.union(wanted).repartition(*unit).sortWithinPartitions(*unit, "kind")
    out = T.StructType([T.StructField("qid", qid_type), T.StructField("id", id_type),
                        T.StructField("score", T.DoubleType())])
    return map_arrow(both, _multiplied(k, out.names), out)


def _multiplied(k: int, names: list[str]):
    """Block by block of a sorted partition: the vectors, then the queries as they come."""
    def best(queries: pa.RecordBatch, ids: pa.Array, matrix: np.ndarray) -> pa.RecordBatch:
        asked = np.frombuffer(b"".join(queries.column("body").to_pylist())).reshape(len(queries), -1)
        scores = asked @ matrix.T
        rows, at = [], []
        for i, row in enumerate(scores):
            # All that may tie with the k-th once scores are rounded.
            edge = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            found = np.flatnonzero(row >= edge - _SLACK)
            rows.append(np.full(len(found), i))
            at.append(found)
        rows, at = np.concatenate(rows), np.concatenate(at)
        return pa.RecordBatch.from_arrays(
            [queries.column("qid").take(pa.array(rows)), ids.take(pa.array(at)), pa.array(scores[rows, at])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, ids, matrix = None, [], None, None
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "query_block", "kind")]
            change = np.any([np.diff(c) != 0 for c in keys], axis=0)
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for start, stop in zip(bounds, bounds[1:]):
                part = batch.slice(start, stop - start)
                if not len(part):
                    continue
                now = tuple(int(c[start]) for c in keys[:3])
                if now != unit:
                    unit, held, matrix = now, [], None
                if keys[3][start] == 0:
                    held.append(part)
                    continue
                if matrix is None:
                    if not held:
                        continue
                    ids = pa.concat_arrays([h.column("id") for h in held])
                    flat = b"".join(b for h in held for b in h.column("body").to_pylist())
                    matrix, held = np.frombuffer(flat).reshape(len(ids), -1), []
                for at in range(0, len(part), 256):
                    yield best(part.slice(at, 256), ids, matrix)
    return run
