"""Byte-level BPE encoding and decoding with a vocabulary file, as the file's library does it.

A text is cut at special tokens, then into words by the vocabulary's pattern; each word's bytes are
merged by rank. Merging keeps, in one array, the parts of a word between boundaries and the rank of each
part joined with the next; it takes the smallest rank (the leftmost of equals), deletes the boundary
behind it and refreshes the two ranks beside it, until no rank is left. Words of one length go through
this side by side, as rows of one numpy array. A word longer than `SHORT` bytes takes the same merges in the same order from a heap, so that a long text without
spaces costs n log n instead of n squared.

Words repeat, so each task keeps the ids of those it has met, about `MEMORY` of them, and then starts
anew. Ids travel as packed little-endian unsigned 32-bit integers.

Defined results: null text is empty; an empty text has no ids and decodes to the empty text; bytes
that are no UTF-8 decode to U+FFFD as in the library; null ids decode to the empty text. Repeated rows
are each returned, an empty table gives no rows, other columns are kept and columns of the added
names replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panel360.functions.arrow import map_arrow
from panel360.llm.common import slices, without

#: Fixed value: how byte-level vocabularies of this family cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, MEMORY = 64, 150_000
_ROWS = 1 << 13
_NONE = 1 << 62
_SAFE = regex.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s | \s|^ | $")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file, and back."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Vocabulary:
    """Pairs' ranks, ids and special tokens of a vocabulary file, and the ids of words met before."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        pre = data["pre_tokenizer"]
        if (data["model"]["type"], pre["type"], pre["add_prefix_space"], data["normalizer"]) != (
                "BPE", "ByteLevel", False, None):
            raise ValueError("only byte-level BPE without normalizer or prefix space")
        to_byte = byte_symbols()
        as_bytes = {s: bytes(to_byte[c] for c in s) for s in data["model"]["vocab"]}
        self.ids = {as_bytes[s]: i for s, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        vocab = data["model"]["vocab"]
        # For each pair of ids its rank and, in the low bits, the id it becomes; sorted and by key.
        self.pairs = {vocab[x] << 32 | vocab[y]: r << 32 | vocab[x + y]
                      for r, (x, y) in enumerate(merges)}
        self.keys = np.array(sorted(self.pairs) or [-1], dtype=np.int64)
        self.values = np.array([self.pairs.get(k, _NONE) for k in self.keys.tolist()], np.int64)
        self.single = [self.ids[bytes([i])] for i in range(256)]
        self.words = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.met: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word. Words of one length are merged side by side, a row each."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, rows in by_length.items():
            if length > SHORT:
                for i in rows:
                    out[i] = np.array(self._merge_long([self.single[b] for b in words[i]]),
                                      "<u4").tobytes()
            else:
                for at in range(0, len(rows), _ROWS):
                    some = rows[at:at + _ROWS]
                    data = np.frombuffer(b"".join([words[i] for i in some]), np.uint8)
                    for i, ids in self._merge_rows(data.reshape(-1, length), some):
                        out[i] = ids
        return out

    def _merge_rows(self, data: np.ndarray, names: list[int]) -> Iterator[tuple[int, bytes]]:
        """`parts[:, i]` is the id between two boundaries, `ranks[:, i]` that of the pair it starts."""
        parts, names = np.array(self.single, np.int64)[data], np.array(names)
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while len(parts):
            rows = np.arange(len(parts))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(parts), np.int64)
            least = ranks[rows, at] if ranks.shape[1] else np.full(len(parts), _NONE)
            over = least == _NONE
            if over.any():
                packed, size = parts[over].astype("<u4").tobytes(), 4 * parts.shape[1]
                for k, name in enumerate(names[over].tolist()):
                    yield name, packed[k * size:(k + 1) * size]
                live = ~over
                parts, ranks, names, at, least = (x[live] for x in (parts, ranks, names, at, least))
                rows = rows[:len(parts)]
                if not len(parts):
                    return
            made = least & 0xFFFFFFFF
            parts[rows, at] = made
            column, width = np.arange(parts.shape[1] - 1), parts.shape[1] - 1
            parts = np.take_along_axis(parts, column + (column > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= at[:, None]), axis=1)
            on = rows[at < width - 1]
            ranks[on, at[on]] = self._ranks(made[on], parts[on, at[on] + 1])
            on = rows[at > 0]
            ranks[on, at[on] - 1] = self._ranks(parts[on, at[on] - 1], made[on])

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges from a heap; a part that is gone is -1."""
        find, n = self.pairs.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (r := find(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, x, y = heapq.heappop(heap)
            nxt = after[at]
            if parts[at] != x or nxt >= n or parts[nxt] != y:
                continue  # one of the two has changed since
            parts[at], parts[nxt] = rank & 0xFFFFFFFF, -1
            after[at] = after[nxt]
            if after[at] < n:
                before[after[at]] = at
                if (r := find(parts[at] << 32 | parts[after[at]])) is not None:
                    heapq.heappush(heap, (r, at, parts[at], parts[after[at]]))
            if (prior := before[at]) >= 0:
                if (r := find(parts[prior] << 32 | parts[at])) is not None:
                    heapq.heappush(heap, (r, prior, parts[prior], parts[at]))
        return [p for p in parts if p >= 0]

    def _resolve(self, pieces: set[str]) -> dict[str, bytes]:
        """The packed ids of pieces."""
        words, merged = {p: self.words.findall(p) for p in pieces}, self.merged
        new = list({w for found in words.values() for w in found if w not in merged})
        merged.update(zip(new, self.merge_all([w.encode() for w in new])))
        out = {p: b"".join([merged[w] for w in found]) for p, found in words.items()}
        if len(merged) > MEMORY or any(len(w) > SHORT for w in new):
            merged.clear()
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of whole texts."""
        met, rows = self.met, []
        if len(met) > MEMORY:
            met.clear()
        starts: set[str] = set()
        todo: set[str] = set()
        for text in texts:
            row, at = [], 0
            for found in self.cut.finditer(text or "") if self.cut else ():
                if found.start() > at:
                    row.append(_pieces(text[at:found.start()]))
                row.append(struct.pack("<I", self.special[found.group()]))
                at = found.end()
            if text and at < len(text):
                row.append(_pieces(text[at:] if at else text))
            for pieces in row:
                if not isinstance(pieces, bytes):
                    starts.add(pieces[0])
                    todo.update(pieces)
            rows.append(row)
        behind = self._resolve({f" {p}" for p in todo if p not in met})
        met.update((p[1:], packed) for p, packed in behind.items())
        first = self._resolve(starts)
        out = []
        for row in rows:
            out.append(b"".join([
                part for pieces in row for part in (
                    (pieces,) if isinstance(pieces, bytes)
                    else (first[pieces[0]], *map(met.__getitem__, pieces[1:])))]))
        for p in behind:  # long ones are not worth their memory
            if len(p) > SHORT:
                del met[p[1:]]
        return out

    def decode(self, packed: bytes | None) -> str:
        return decoded(packed, self.bytes)


def _pieces(text: str) -> list[str]:
    """A text cut at each blank between two black characters: the pattern joins nothing across it,
    and the blank goes to the piece behind it."""
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


@lru_cache(maxsize=4)
def byte_table(path: str) -> dict[int, bytes]:
    """The bytes of each id: all that decoding needs, without what encoding holds."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    to_byte = byte_symbols()
    table = {i: bytes(to_byte[c] for c in s) for s, i in data["model"]["vocab"].items()}
    return table | {t["id"]: t["content"].encode() for t in data["added_tokens"]}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path)


def decoded(packed: bytes | None, table: dict[int, bytes]) -> str:
    """The text of packed ids."""
    ids = np.frombuffer(packed or b"", dtype="<u4").tolist()
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", errors="replace")


def _added(df: DataFrame, fields: dict[str, T.DataType], source: str, make) -> DataFrame:
    rows = without(df, fields)
    at = rows.columns.index(source)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                made = make(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    return map_arrow(rows, run, schema)


def encode(df: DataFrame, path: str, text: str = "text", check: bool = False) -> DataFrame:
    """`df` with `ids` (packed) and `n_tokens`; with `check` also `round_trip`, whether the ids, decoded in
    the same task, give the text again. The file at `path` must be on every worker."""
    fields = {"ids": T.BinaryType(), "n_tokens": T.LongType()}
    if check:
        fields["round_trip"] = T.BooleanType()

    def make(texts: pa.Array) -> list[pa.Array]:
        words, given = vocabulary(path), texts.to_pylist()
        packed = words.encode_all(given)
        made = [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
        if check:
            made.append(pa.array([words.decode(p) == (t or "") for p, t in zip(packed, given)], pa.bool_()))
        return made

    return _added(df, fields, text, make)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`df` with `decoded`, the text of its packed ids."""
    def make(packed: pa.Array) -> list[pa.Array]:
        table = byte_table(path)
        return [pa.array([decoded(p.as_py(), table) for p in packed], pa.string())]

    return _added(df, {"decoded": T.StringType()}, ids, make)
