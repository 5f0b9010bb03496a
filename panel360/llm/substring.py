"""Substring dedup: suffix automata of reference shards give matching statistics, spans go.

A window is `span` consecutive words. A window of a document goes if the same words also start in a
document of smaller id, and with it every word it covers; windows are judged on the input. So the
reference is the table itself, and its automata together grow with it: none is built on the driver,
none is sent to every task. Instead

1. each window gets a key, the smallest hash of the `gram`-word runs in it, so equal windows have equal
   keys; neighbouring windows mostly share theirs, which leaves a key for about every sixteenth word;
2. a key that two ids share has an owner, the smallest of them. Owners are dealt into shards of about
   `SHARD_KEYS` keys, and windows whose key has another owner are sent, as segments of text, to that
   owner's shard, in blocks of about `BLOCK_KEYS` keys. The shard's reference text travels to each of
   its blocks, so that no group of copies meets in one task;
3. a task builds the automaton of a shard over words (several, one after the other, where the text has
   more than `AUTOMATON_WORDS` words), streams the block's segments through it, and at each word has
   the length of the longest suffix that occurs in the reference. Where it reaches `span`, the window
   ending there is the owner's too, and goes;
4. windows that their key's owner does not hold are left over. They are few. The next round takes them
   alone, with a hash over the whole window as key, so that equal windows now have one owner; only
   windows that differ but share this hash are left over again, and get another hash. Rounds end
   when nothing is left.

No window is lost: all documents that hold a window share its key, so either the owner holds it and all
others match it, or none matches it and all meet again in the next round. Hashes only bring texts
together; what goes is decided by the automaton, on the words themselves.

Defined results: null and empty texts have no words and keep nothing; a document shorter than a span
keeps all; repeats within one id, in one text or in repeated rows, stay; rows with null id neither
lose words nor cost others any; each repeated row is returned; an empty table gives no rows. Other
columns are kept, columns of the added names replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.functions.arrow import map_arrow
from panel360.llm.common import fresh, slices, stored, without

SPAN, GRAM = 50, 20
SHARD_KEYS, BLOCK_KEYS, AUTOMATON_WORDS = 3_000, 60_000, 100_000
MEMORY = 200_000
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18
_REFERENCE, _QUERY = 0, 1


class Automaton:
    """The suffix automaton of some texts, over words: its states are the classes of word sequences
    that end at the same places, `length` is the longest of a state, `link` the state of the next
    shorter suffix."""

    def __init__(self):
        self.after: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, after: dict[bytes, int], link: int) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, parent: int, word: bytes, state: int) -> int:
        """A state for the sequences of `state` that `parent` and its suffixes lead to by `word`."""
        copy = self._state(self.length[parent] + 1, dict(self.after[state]), self.link[state])
        self.link[state] = copy
        while parent >= 0 and self.after[parent].get(word) == state:
            self.after[parent][word] = copy
            parent = self.link[parent]
        return copy

    def add(self, words: list[bytes]) -> None:
        """Take in one more text."""
        after, link, length = self.after, self.link, self.length
        last = 0
        for word in words:
            known = after[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, word, known)
                continue
            state = self._state(length[last] + 1, {}, 0)
            at = last
            while at >= 0 and word not in after[at]:
                after[at][word] = state
                at = link[at]
            if at >= 0:
                known = after[at][word]
                link[state] = known if length[known] == length[at] + 1 else self._split(at, word, known)
            last = state

    def statistics(self, words: list[bytes]) -> list[int]:
        """At each word the length of the longest sequence ending there that the texts hold."""
        after, link, length = self.after, self.link, self.length
        state = size = 0
        out = []
        for word in words:
            nxt = after[state].get(word)
            while nxt is None and state:
                state = link[state]
                size = length[state]
                nxt = after[state].get(word)
            if nxt is not None:
                state = nxt
                size += 1
            out.append(size)
        return out


class _Values(dict):
    """The hash of each word met."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= 32:
            if len(self) > MEMORY:
                self.clear()
            self[word] = value
        return value


_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(_BLOCK + 2 * SPAN + 1, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def window_keys(words: list[bytes], span: int, gram: int, values: _Values) -> np.ndarray:
    """For each window of `span` words the smallest hash of its runs of `gram` words."""
    n = len(words) - span + 1
    out = np.empty(max(n, 0), np.uint64)
    up, down = _power_tables()
    step = len(up) - span - 1
    for at in range(0, n, step):
        some = words[at:min(at + step, n) + span - 1]
        value = np.fromiter(map(values.__getitem__, some), np.uint64, len(some))
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(value * up[:len(some)], out=sums[1:])
        run = (sums[gram:] - sums[:-gram]) * down[:len(some) - gram + 1]
        run ^= run >> np.uint64(29)
        run *= np.uint64(0xBF58476D1CE4E5B9)
        run ^= run >> np.uint64(32)
        left, width = span - gram + 1, 1  # the minimum of `left` neighbours, by doubling
        while width < left:
            shift = min(width, left - width)
            run = np.minimum(run[:-shift], run[shift:])
            width += shift
        out[at:at + len(run)] = run
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Ranges [start, end) of the true places."""
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
    return list(zip(edge[::2], edge[1::2]))


def _split_text(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # at exactly x20 and x09 to x0D


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN,
          gram: int = GRAM) -> DataFrame:
    """`documents` with n_words, removed (ranges of word places [start, end) that went) and kept (the
    other words, joined by one blank)."""
    if not 1 <= gram <= span <= SPAN * 2:
        raise ValueError(f"need 1 <= gram <= span <= {SPAN * 2}")
    rows = without(documents, ["n_words", "removed", "kept"])
    mark, found = fresh(rows, "text_hash"), fresh(rows, "found")
    rows = rows.withColumn(mark, F.xxhash64(text))
    left = rows.where(F.col(key).isNotNull() & (F.length(text) >= 2 * span - 1)).select(
        F.col(key).alias("id"), F.col(mark).alias("mark"), F.lit(0).cast("long").alias("place"),
        F.col(text).alias("body"))
    hits, number = [], 0
    while True:
        made = _round(left, span, gram if number == 0 else span, number)
        if made is None:
            break
        hits.append(made.where("body IS NULL").select("id", "mark", "place", "n"))
        left = made.where("body IS NOT NULL").select("id", "mark", "place", "body")
        number += 1
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                      T.StructField("end", T.LongType())]))
    if hits:
        every = hits[0]
        for more in hits[1:]:
            every = every.union(more)
        ranges = every.groupBy(F.col("id").alias(key), F.col("mark").alias(mark)).agg(F.sort_array(
            F.collect_list(F.struct(F.col("place").alias("start"),
                                    (F.col("place") + F.col("n")).alias("end")))).alias(found))
        rows = rows.join(ranges, [key, mark], "left").select(
            *[F.col(f"`{c}`") for c in rows.columns if c != mark], F.col(found))
    else:
        rows = rows.drop(mark).withColumn(found, F.lit(None).cast(spans))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_words", T.LongType()),
                           T.StructField("removed", spans), T.StructField("kept", T.StringType())])
    return map_arrow(rows, _cut(rows.columns.index(text), spans, schema.names), schema)


def _round(left: DataFrame, span: int, gram: int, seed: int) -> DataFrame | None:
    """Of the segments `left` (id, mark, place, body): the ranges of words that go (body null), and the
    segments whose key's owner does not hold them. None if no two ids share a key."""
    id_type = left.schema["id"].dataType
    keyed = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", id_type)])
    keys = stored(map_arrow(left.select("id", "body"), _keys(span, gram, seed), keyed), "keys")
    live = stored(keys.groupBy("key").agg(F.min("id").alias("owner"), F.max("id").alias("last"),
                                          F.count(F.lit(1)).alias("held"))
                  .where("owner < last").drop("last"), "live-keys")
    shards = live.count() // SHARD_KEYS + 1
    if live.isEmpty():
        return None
    live = live.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    loads = live.groupBy("shard").agg(
        F.ceil(F.sum("held") / F.lit(BLOCK_KEYS)).cast("int").alias("blocks"))
    live = live.join(loads, "shard").select("key", "owner", "shard", "blocks")
    sent = (keys.join(live, "key")
            .groupBy("id").agg(F.sort_array(F.collect_set(F.struct(
                "key", "shard", "blocks", (F.col("id") == F.col("owner")).alias("own")))).alias("keys")))
    to = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("block", T.IntegerType()),
        T.StructField("kind", T.IntegerType()), T.StructField("id", id_type),
        T.StructField("mark", T.LongType()), T.StructField("place", T.LongType()),
        T.StructField("body", T.StringType())])
    # The block of a document's segments, by its id and text: the same in whatever order rows arrive.
    segments = map_arrow(left.join(sent, "id").select(
        "id", "mark", "place", "body", F.xxhash64("id", "mark").alias("deal"), "keys"),
        _segments(span, gram, seed, to.names), to)
    segments = segments.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    out = T.StructType([to["id"], to["mark"], to["place"], T.StructField("n", T.LongType()), to["body"]])
    return stored(map_arrow(segments, _match(span, out.names), out), "matches")


def _keys(span: int, gram: int, seed: int):
    """Each document's keys, every one once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _Values(seed)
        for whole in batches:
            for batch in slices(whole, 1):
                made, owner = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    found = np.unique(window_keys(_split_text(text), span, gram, values))
                    made.append(found.view(np.int64))
                    owner.append(np.full(len(found), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(made)), batch.column(0).take(pa.array(np.concatenate(owner)))],
                    ["key", "id"])
    return run


def _segments(span: int, gram: int, seed: int, names: list[str]):
    """The segments of each document that go to the shards of its keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _Values(seed)
        for whole in batches:
            for batch in slices(whole, 3):
                out: list[list] = [[] for _ in range(6)]
                column = batch.column(5)
                ends = column.offsets.to_numpy()
                held = [column.values.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
                place, deal = batch.column(2).to_pylist(), batch.column(4).to_pylist()
                for i, text in enumerate(batch.column(3).to_pylist()):
                    key, shard, blocks, own = (h[ends[i]:ends[i + 1]] for h in held)
                    order = np.argsort(key.view(np.uint64))
                    words = _split_text(text)
                    wanted = window_keys(words, span, gram, values)
                    at = np.minimum(key.view(np.uint64)[order].searchsorted(wanted), len(key) - 1)
                    at = order[at]
                    goal = np.where(key.view(np.uint64)[at] == wanted, shard[at] * 2 + own[at], -1)
                    for target in np.unique(goal[goal >= 0]).tolist():
                        number, mine = divmod(target, 2)
                        parts = int(blocks[shard == number][0])
                        for begin, end in _runs(goal == target):
                            body = b" ".join(words[begin:end + span - 1]).decode()
                            for block in range(parts) if mine else (deal[i] % parts,):
                                for values_, value in zip(out, (
                                        number, block, _REFERENCE if mine else _QUERY, i,
                                        place[i] + begin, body)):
                                    values_.append(value)
                rows = pa.array(out[3], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                    pa.array(out[2], pa.int32()), batch.column(0).take(rows),
                    batch.column(1).take(rows), pa.array(out[4], pa.int64()),
                    pa.array(out[5], batch.column(3).type)], names)
    return run


def _automata(texts: list[str], span: int) -> Iterator[Automaton]:
    """One automaton after the other, each of at most about `AUTOMATON_WORDS` words, that together hold
    every window of the texts."""
    made, size = Automaton(), 0
    for text in texts:
        words = _split_text(text)
        for at in range(0, len(words) - span + 1, AUTOMATON_WORDS):
            some = words[at:at + AUTOMATON_WORDS + span - 1]
            if size and size + len(some) > AUTOMATON_WORDS:
                yield made
                made, size = Automaton(), 0
            made.add(some)
            size += len(some)
    yield made


def _match(span: int, names: list[str]):
    """The segments of each block through the automata of its shard."""
    def judged(texts: list[str], queries: list[tuple]) -> Iterator[list[tuple]]:
        found = [np.zeros(len(_split_text(q[-1])) - span + 1, bool) for q in queries]
        for automaton in _automata(texts, span):
            for query, seen in zip(queries, found):
                if not seen.all():
                    sizes = np.array(automaton.statistics(_split_text(query[-1])))
                    seen |= sizes[span - 1:] >= span
        for (key, mark, place, body), seen in zip(queries, found):
            rows = [(key, mark, place + a, b - a + span - 1, None) for a, b in _runs(seen)]
            if not seen.all():
                words = _split_text(body)
                rows += [(key, mark, place + a, b - a + span - 1,
                          b" ".join(words[a:b + span - 1]).decode()) for a, b in _runs(~seen)]
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, texts, queries = None, [], []
        types = None

        def flush() -> Iterator[pa.RecordBatch]:
            made: list[tuple] = []
            for rows in judged(texts, queries):
                made += rows
                if len(made) > 2_000:
                    yield batch_of(made)
                    made = []
            if made:
                yield batch_of(made)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for whole in batches:
            kinds = whole.schema.types
            types = [kinds[3], kinds[4], kinds[5], pa.int64(), kinds[6]]
            for batch in slices(whole, 6):
                for shard, block, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if (shard, block) != group:
                        if queries:
                            yield from flush()
                        group, texts, queries = (shard, block), [], []
                    if kind == _REFERENCE:
                        texts.append(row[-1])
                    else:
                        queries.append(tuple(row))
        if queries:
            yield from flush()
    return run


def _cut(at: int, spans: T.ArrayType, names: list[str]):
    """Documents with their ranges (the last column) less the words in them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                counts, removed, kept = [], [], []
                found = batch.column(batch.num_columns - 1).to_pylist()
                for text, ranges in zip(batch.column(at).to_pylist(), found):
                    words = _split_text(text)
                    counts.append(len(words))
                    merged: list[dict] = []
                    for r in ranges or ():
                        if merged and r["start"] <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], r["end"])
                        else:
                            merged.append(r)
                    for r in reversed(merged):
                        del words[r["start"]:r["end"]]
                    removed.append(merged)
                    kept.append(b" ".join(words).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(removed, kind),
                     pa.array(kept, pa.string())], names)
    return run
