"""Merkle dataset manifest: a tree of SHA-256 digests whose parents keep their midstates.

A leaf is the digest of a row's fields. The leaves of a tree (one per language, say) are ordered; runs
of `FANOUT` consecutive nodes become the digest of their concatenated hex digests, level by level,
until one node is left, the subroot. Subroots, ordered by their tree's name, likewise give the root.

A parent's hash state is copied before each child slot. To fold a changed leaf to the root, each level
resumes the state before its slot with the new digest and the siblings to the right only; what lies to
the left is never hashed again. Without change the same folding proves the leaf.

Ranks come from a range partition: rows are sorted by tree and order, written with their place, and
the place of a tree's first row in each partition follows from counts per partition. A task then holds
`FANOUT ** LEVELS` neighbouring nodes at most, builds their `LEVELS` levels and hands on one node; tier
by tier there are 4,096 times fewer. Downwards each such group gets one row with the siblings above
it, and its leaves are folded where its midstates are. So a tree of any size, or one that holds all
rows, is spread over tasks; no digest passes the driver but the root.

Defined results: fields that are null are `-`, others their UTF-8 byte count, `:` and value; rows without
tree are a tree of their own, which comes first; rows without order come first in their tree, and
equal orders follow their leaves' digests, so that repeated rows are neighbours and each is a leaf; an
empty table gives no rows. Other columns are kept, columns of the added names replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.functions.arrow import map_arrow
from panel360.llm.common import stored, without

FANOUT, LEVELS = 8, 4
ADDED = ("subroot", "root", "proof", "folded_root", "verified")
_PLACE_BITS = 33  # of a monotonically increasing id: the row within its partition
_OUT_ROWS = 1_000
_PATH = "array<struct<left: string, right: string>>"


def leaf_digest(*fields: Column) -> Column:
    """The hex digest of some fields of a row."""
    def encoded(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*map(encoded, fields)), 256)


class Subtree:
    """Some levels above neighbouring nodes, with the state of each parent before each of its slots."""

    def __init__(self, digests: list[bytes], levels: int):
        self.levels: list[tuple[list[bytes], list]] = []
        for _ in range(levels):
            states, parents = [], []
            for at in range(0, len(digests), FANOUT):
                state = hashlib.sha256()
                for digest in digests[at:at + FANOUT]:
                    states.append(state.copy())
                    state.update(digest)
                parents.append(state.hexdigest().encode())
            self.levels.append((digests, states))
            digests = parents
        self.root = digests[0]

    def siblings(self, at: int) -> Iterator[tuple[bytes, bytes]]:
        """On each level what is left and right of a node's ancestor in its run."""
        for digests, _ in self.levels:
            first = at - at % FANOUT
            yield b"".join(digests[first:at]), b"".join(digests[at + 1:first + FANOUT])
            at //= FANOUT

    def fold(self, at: int, digest: bytes) -> bytes:
        """The subtree's root with another digest at a place."""
        for digests, states in self.levels:
            digest = resumed(states[at], digest, b"".join(digests[at + 1:at - at % FANOUT + FANOUT]))
            at //= FANOUT
        return digest


def resumed(state, digest: bytes, right: bytes) -> bytes:
    """A parent's digest from its midstate, the digest in the slot and those to the right."""
    state = state.copy()
    state.update(digest)
    state.update(right)
    return state.hexdigest().encode()


def levels_of(n: int) -> int:
    """Levels that a task builds over nodes of a tree that has `n` of them."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def manifest(rows: DataFrame, tree: str, order: str, leaf: str = "leaf",
             changed: str | None = None) -> DataFrame:
    """`rows` with subroot, root, proof (the hex digests of the siblings, level by level, left to right),
    folded_root (the root folded from `changed`, or from the leaf where that is null) and verified
    (whether it equals the root)."""
    kept = without(rows, ADDED)
    other = F.col(changed) if changed else F.lit(None).cast("string")
    leaves = _ranked(kept.select(
        F.col(tree).alias("tree"), F.col(order).alias("at"), F.col(leaf).alias("digest"),
        other.alias("changed"), F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row")),
        ["at", "digest"]).drop("at")
    tiers = _climb(leaves)
    if tiers is None:
        return kept.limit(0).select("*", *[F.lit(None).cast("boolean" if n == "verified" else "string")
                                           .alias(n) for n in ADDED])
    subroots = tiers[-1].select(F.lit(0).alias("tree"), F.struct("tree").alias("row"), "digest")
    forest = _ranked(subroots.withColumn("at", F.col("row.tree")), ["at"]).drop("at")
    above = _climb(forest)
    root = above[-1].first()["digest"]
    paths = above[-1].select("tree", F.col("idx").alias("chunk"), F.array().cast(_PATH).alias("path"))
    for tier in reversed(above[1:-1]):
        paths = _paths(tier, paths).select("tree", F.col("idx").alias("chunk"), "path")
    paths = _paths(above[0], paths).select(
        F.col("row.tree").alias("tree"), F.lit(0).cast("long").alias("chunk"), "path",
        F.col("digest").alias("subroot"))
    for tier in reversed(tiers[1:-1]):
        paths = _paths(tier, paths, "subroot").select("tree", F.col("idx").alias("chunk"), "path", "subroot")
    added = [T.StructField(n, T.BooleanType() if n == "verified" else T.StringType()) for n in ADDED]
    schema = T.StructType([*kept.schema.fields, *added])
    grouped = _with_paths(leaves, paths, "subroot")
    return map_arrow(grouped, _folded(root.encode(), schema.names), schema)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with idx, their rank from 0 in their tree, and n, the rows of the tree."""
    salted = rows.withColumn("salt", F.rand(0))  # spreads rows that are equal in all of the order
    placed = stored(salted.repartitionByRange("tree", *order, "salt").sortWithinPartitions("tree", *order)
                    .withColumn("place", F.monotonically_increasing_id()).drop("salt"), "placed")
    part = F.shiftright("place", _PLACE_BITS)
    row = F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    counts = placed.groupBy("tree", part.alias("part")).agg(F.count("*").alias("held"), F.min(row).alias("low"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("tree").alias("of"), "part", F.sum("held").over(whole).alias("n"),
                            (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    joined = placed.join(offsets, F.col("tree").eqNullSafe(F.col("of")) & (part == F.col("part")))
    return joined.select(*rows.columns, (row + F.col("shift")).alias("idx"), "n")


def _grouped(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "idx")


def _chunked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("idx") / F.lit(FANOUT ** LEVELS)))


def _climb(nodes: DataFrame) -> list[DataFrame] | None:
    """The nodes, and tier by tier those `LEVELS` levels above, up to one for each tree."""
    biggest = nodes.agg(F.max("n")).first()[0]
    if biggest is None:
        return None
    tiers = [nodes]
    schema = T.StructType([nodes.schema["tree"], T.StructField("idx", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])
    while len(tiers) == 1 or biggest > 1:
        below = _chunked(tiers[-1].select("tree", "idx", "n", "digest"))
        tiers.append(stored(map_arrow(_grouped(below), _reduced(schema.names), schema), "tier"))
        biggest = -(-biggest // FANOUT ** LEVELS)
    return tiers


def _with_paths(nodes: DataFrame, paths: DataFrame, *more: str) -> DataFrame:
    """The nodes of each group behind one row with the siblings above the group."""
    head = paths.select("tree", "chunk", "path", F.lit(-1).cast("long").alias("idx"), *more)
    return _grouped(_chunked(nodes).unionByName(head, allowMissingColumns=True))


def _paths(nodes: DataFrame, paths: DataFrame, *more: str) -> DataFrame:
    """`nodes` with the siblings on each level above them, given those above each group."""
    extra = [paths.schema[m] for m in more]
    schema = T.StructType([*nodes.schema.fields, paths.schema["path"], *extra])
    return stored(map_arrow(_with_paths(nodes, paths, *more), _handed_down(schema.names), schema), "paths")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group of a sorted partition."""
    held: list[pa.RecordBatch] = []
    group = None
    for batch in batches:
        start = 0
        keys = zip(batch.column("tree").to_pylist(), batch.column("chunk").to_pylist())
        for i, key in enumerate(keys):
            if key != group:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, group, start = [], key, i
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _subtree(table: pa.Table) -> Subtree:
    return Subtree([d.encode() for d in table["digest"].to_pylist()], levels_of(table["n"][0].as_py()))


def _reduced(names: list[str]):
    """One node for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            rest = -(-table["n"][0].as_py() // FANOUT ** LEVELS)
            yield pa.RecordBatch.from_arrays(
                [table["tree"].slice(0, 1).combine_chunks(), table["chunk"].slice(0, 1).combine_chunks(),
                 pa.array([rest], pa.int64()), pa.array([_subtree(table).root.decode()])], names)
    return run


def _handed_down(names: list[str]):
    """Each node with its own levels' siblings before those above its group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            head, nodes = table.slice(0, 1).to_pylist()[0], table.slice(1)
            subtree = _subtree(nodes)
            kind = table.schema.field("path").type
            for at in range(0, nodes.num_rows, _OUT_ROWS):
                some = nodes.slice(at, _OUT_ROWS).combine_chunks()
                made = {"path": pa.array([[
                    *({"left": a.decode(), "right": b.decode()} for a, b in subtree.siblings(at + i)),
                    *head["path"]] for i in range(some.num_rows)], kind)}
                if "subroot" in names:
                    made["subroot"] = pa.array([head["subroot"]] * some.num_rows, pa.string())
                yield pa.Table.from_arrays(
                    [made.get(n, some[n] if n in some.column_names else None) for n in names],
                    names).to_batches()[0]
    return run


def _folded(root: bytes, names: list[str]):
    """The leaves of each group with their proofs, folded to the root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            head, leaves = table.slice(0, 1).to_pylist()[0], table.slice(1)
            subtree = _subtree(leaves)
            above = [(hashlib.sha256(p["left"].encode()), p["right"].encode()) for p in head["path"]]
            tail = "".join(p["left"] + p["right"] for p in head["path"])
            for at in range(0, leaves.num_rows, _OUT_ROWS):
                some = leaves.slice(at, _OUT_ROWS).combine_chunks()
                proofs, folded = [], []
                digests, changed = some["digest"].to_pylist(), some["changed"].to_pylist()
                for i, (old, new) in enumerate(zip(digests, changed), at):
                    proofs.append(b"".join(a + b for a, b in subtree.siblings(i)).decode() + tail)
                    digest = subtree.fold(i, (old if new is None else new).encode())
                    for state, right in above:
                        digest = resumed(state, digest, right)
                    folded.append(digest)
                n = some.num_rows
                row = some["row"].combine_chunks() if n else some["row"]
                row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
                yield pa.RecordBatch.from_arrays(
                    [*row.flatten(), pa.array([head["subroot"]] * n), pa.array([root.decode()] * n),
                     pa.array(proofs), pa.array([d.decode() for d in folded]),
                     pa.array([d == root for d in folded])], names)
    return run
