"""Benchmark decontamination by winnowing.

Of each `window` consecutive words of an item (its `span` words in production: a 10-word span holds six
5-grams) winnowing keeps the smallest k-gram hash. Two texts that share a span of `span` words have
the same k-grams there, hence the same smallest one, so every shared span has a kept k-gram in
common. Documents are winnowed the same way, their kept k-grams are looked up among those of the
items, and each hit is extended to the spans that lie over it, which are compared byte for byte.
An item shorter than a span is one span; such items are winnowed by their own length.

The items form an index that travels to the tasks, block by block. Repeated rows of an item are
dropped, texts of more than `BLOCK_BYTES` are cut into pieces that share all but one word of a span,
and the pieces are dealt into buckets by hash, whose bytes are counted: buckets are packed into blocks
of at most `BLOCK_BYTES`, and are made smaller where one of several pieces has more. Only a single
span, whose words are very long, can be a larger block. The documents pass one block after the
other, `CHAIN` blocks to a pass over the table. Documents are never shuffled, and no pair of a
document and an item leaves a task other than in that document's own row.

Defined results: null and empty texts have no words and are clean; items without words match
nothing; items with equal texts are each counted; repeated item ids are named once; repeated
documents are each returned; null item ids count as items and are left out of the list; an empty
table gives no rows, an empty benchmark leaves all documents clean. Other columns are kept, columns
of the added names replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.functions.arrow import map_arrow
from panel360.llm.common import slices, stored, without

SPAN, GRAM = 10, 5
BLOCK_BYTES, CHAIN = 16_000_000, 4
BUCKETS, MOST_BUCKETS = 64, 1 << 16  # for each block, and in all
#: Fixed value: bytes that are part of a word. Others separate words.
_WORD = np.array([b > 0x7F or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE_BITS = 20
_BLOCK_WORDS = 1 << 18


class Words:
    """The words of some texts, laid end to end with one blank between them."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        inside = _WORD[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
        self.text = ends_of_texts.searchsorted(begin, side="right")  # which text a word is in
        self.count = np.bincount(self.text, minlength=len(texts))
        keep = inside.copy()
        keep[end[end < len(raw)]] = True
        squeezed = _LOWER[raw[keep]]
        length = end - begin
        self.start = np.cumsum(length + 1) - (length + 1)
        self.stop = self.start + length
        squeezed[self.stop[self.stop < len(squeezed)]] = 32
        self.data = squeezed.tobytes()

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each run of `size` words and whether the run stays in one text."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        out = np.empty(n, np.uint64)
        data = np.frombuffer(self.data, dtype=np.uint8)
        for at in range(0, n, _BLOCK_WORDS):
            till = min(n, at + _BLOCK_WORDS)
            low, high = self.start[at], self.stop[till + size - 2]
            powers = _powers(_BASE, high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
            first = self.start[at:till] - low
            value = sums[self.stop[at + size - 1:till + size - 1] - low] - sums[first]
            value *= _powers(_BASE_INVERSE, high - low)[first]
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            out[at:till] = value ^ (value >> np.uint64(32))
        return out, self.text[:n] == self.text[size - 1:]

    def run(self, first: int, size: int) -> bytes:
        """The bytes of `size` words."""
        return self.data[self.start[first]:self.stop[first + size - 1]]

    def winnowed(self, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the k-grams that are smallest (ties included) in some window of
        `window` consecutive k-grams of one text."""
        value, whole = self.grams(gram)
        if window == 1:
            return np.flatnonzero(whole), value[whole]
        n = len(value) - window + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        inside = self.text[:n] == self.text[window + gram - 2:]
        least = reduce(np.minimum, (value[i:n + i] for i in range(window)))
        kept = np.zeros(len(value), bool)
        for i in range(window):
            kept[i:n + i] |= inside & (value[i:n + i] == least)
        return np.flatnonzero(kept), value[kept]


_known: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first powers of `base`, modulo 2 ** 64."""
    held = _known.get(int(base), np.empty(0, np.uint64))
    if len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _known[int(base)] = held
    return held[:n]


class Index:
    """Spans of some items by their bytes, and the winnowed k-grams that lead to them."""

    def __init__(self, items: list[tuple], span: int, gram: int):
        self.span, self.gram = span, gram
        self.spans: dict[int, dict[bytes, list[int]]] = {}
        self.names = [name for name, _ in items]
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        words = Words([(t or "").encode() for _, t in items])
        first = np.cumsum(words.count) - words.count
        for i, count in enumerate(words.count.tolist()):
            size = min(count, span)
            for at in range(first[i], first[i] + count - size + 1) if size else ():
                found = self.spans.setdefault(size, {}).setdefault(words.run(at, size), [])
                if not found or found[-1] != i:
                    found.append(i)
        for size, spans in self.spans.items():
            gram, window = self.shape(size)
            hashes = np.unique(Words(list(spans)).winnowed(gram, window)[1])
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[hashes & np.uint64((1 << _TABLE_BITS) - 1)] = True
            self.grams[size] = hashes, table

    def shape(self, size: int) -> tuple[int, int]:
        """k and the window for spans of `size` words: k + window - 1 = size."""
        return (self.gram, size - self.gram + 1) if size > self.gram else (size, 1)

    def hits(self, words: Words) -> tuple[dict[int, set[int]], dict[int, set[int]]]:
        """By text: the places of its words that lie in an item's span, and the items."""
        places: dict[int, set[int]] = {}
        items: dict[int, set[int]] = {}
        for size, spans in self.spans.items():
            gram, window = self.shape(size)
            at, value = words.winnowed(gram, window)
            hashes, table = self.grams[size]
            maybe = table[value & np.uint64((1 << _TABLE_BITS) - 1)]
            at, value = at[maybe], value[maybe]
            found = np.minimum(hashes.searchsorted(value), len(hashes) - 1)
            seen: set[int] = set()
            for hit in at[hashes[found] == value].tolist():
                text = int(words.text[hit])
                for begin in range(max(0, hit - window + 1), hit + 1):
                    last = begin + size - 1
                    if (begin in seen or last >= len(words.text) or words.text[begin] != text
                            or words.text[last] != text):
                        continue
                    seen.add(begin)
                    if (named := spans.get(words.run(begin, size))) is not None:
                        places.setdefault(text, set()).update(range(begin, begin + size))
                        items.setdefault(text, set()).update(named)
        return places, items


def _runs(places: set[int], first: int) -> list[tuple[int, int]]:
    """Sorted places as ranges [start, end), counted from `first`."""
    out: list[tuple[int, int]] = []
    for p in sorted(places):
        if out and out[-1][1] == p - first:
            out[-1] = out[-1][0], p - first + 1
        else:
            out.append((p - first, p - first + 1))
    return out


def decontaminate(documents: DataFrame, items: DataFrame, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", span: int = SPAN,
                  gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`documents` with n_words, hit_spans (ranges of word places [start, end) that items occur in)
    and items (the ids of those items, sorted)."""
    id_type = items.schema[item_id].dataType
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                      T.StructField("end", T.LongType())]))
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", spans),
                          T.StructField("items", T.ArrayType(id_type))])
    kept = without(documents, added.names)
    rows = kept.select("*", F.lit(0).cast("long").alias("n_words"),
                       F.array().cast(spans).alias("hit_spans"),
                       F.array().cast(added["items"].dataType).alias("items"))
    schema, at = rows.schema, rows.columns.index(text)
    questions = items.select(item_id, item_text).where(F.length(item_text) > 0)
    pieces = stored(map_arrow(questions, _cut(span, block_bytes), questions.schema).distinct(), "items")
    blocks = _blocks(pieces, item_id, item_text, block_bytes)
    for n, block in enumerate(blocks):
        index = documents.sparkSession.sparkContext.broadcast(
            Index([tuple(r) for r in pieces.where(block).collect()], span, gram))
        rows = map_arrow(rows, _pass(index, at, added), schema)
        if n % CHAIN == CHAIN - 1 and n < len(blocks) - 1:
            rows = stored(rows, "decontaminate")
    return rows


def _cut(span: int, most: int):
    """Items in pieces of at most `most` bytes, or one span, that together hold the same spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                owners, made = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    words = Words([text.encode()])
                    begin, end, n = 0, 0, len(words.start)
                    while end < n:
                        end = int(words.stop.searchsorted(words.start[begin] + most, side="right"))
                        end = min(n, max(end, begin + span))
                        owners.append(i)
                        made.append(words.run(begin, end - begin).decode())
                        begin = end - span + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owners, pa.int64())),
                     pa.array(made, batch.column(1).type)], whole.schema.names)
    return run


def _blocks(pieces: DataFrame, item_id: str, item_text: str, block_bytes: int) -> list[Column]:
    """Conditions that share out the pieces in blocks, by counted bytes."""
    size = F.octet_length(item_text)
    buckets = BUCKETS * int((pieces.agg(F.sum(size)).first()[0] or 0) // block_bytes + 1)
    while True:
        bucket = F.pmod(F.xxhash64(item_id, item_text), F.lit(buckets))
        held = pieces.groupBy(bucket.alias("bucket")).agg(
            F.sum(size).alias("bytes"), F.count("*").alias("n")).orderBy("bucket").collect()
        if buckets >= MOST_BUCKETS or all(r["n"] == 1 or r["bytes"] <= block_bytes for r in held):
            break
        buckets *= 2
    starts, total = [0], 0
    for r in held:
        if total and total + r["bytes"] > block_bytes:
            starts.append(r["bucket"])
            total = 0
        total += r["bytes"]
    return [(bucket >= a) & (bucket < b) for a, b in zip(starts, [*starts[1:], buckets])]


def _pass(index, at: int, added: T.StructType):
    """Each row with what one block of items adds to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names = whole.schema.names
            place = {n: names.index(n) for n in added.names}
            for batch in slices(whole, at):
                words = Words([(t or "").encode() for t in batch.column(at).to_pylist()])
                places, found = index.value.hits(words)
                first = np.cumsum(words.count) - words.count
                spans = batch.column(place["hit_spans"]).to_pylist()
                items = batch.column(place["items"]).to_pylist()
                for i, held in places.items():
                    for s in spans[i]:
                        held.update(range(first[i] + s["start"], first[i] + s["end"]))
                    spans[i] = [{"start": a, "end": b} for a, b in _runs(held, int(first[i]))]
                    named = {index.value.names[k] for k in found[i]} - {None}
                    items[i] = sorted(named.union(items[i]))
                columns = list(batch.columns)
                columns[place["n_words"]] = pa.array(words.count, pa.int64())
                columns[place["hit_spans"]] = pa.array(spans, columns[place["hit_spans"]].type)
                columns[place["items"]] = pa.array(items, columns[place["items"]].type)
                yield pa.RecordBatch.from_arrays(columns, schema=whole.schema)
    return run
