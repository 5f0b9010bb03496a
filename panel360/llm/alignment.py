"""Cross-tokenizer alignment: token groups, and links between tokens, of two vocabularies.

Both tokenizers cover the same bytes, a blank and the text. Byte offsets where a token of A and one of
B both end cut the two streams into groups; the two tokens that end at a cut are linked.

Alignment is an associative fragment monoid. A range of bytes yields a `Fragment`: the tokens up to
its first cut (the open prefix), the groups closed between its cuts, and the tokens behind its last cut
(the open suffix); a range without a cut is open altogether. Two neighbouring fragments compose by
joining the suffix of one with the prefix of the next, so any tree of compositions gives the whole.

Texts up to `CHUNK` bytes are one fragment, made for a whole batch of texts at a time. Longer ones are cut
into ranges of `CHUNK` bytes, wherever that falls; each range travels to a task of its own, with the
bytes around it up to the nearest places where neither tokenizer joins anything (a single blank
between two black characters), and keeps the tokens that end in it. Fragments are composed `FANIN` at a
time, level by level, across tasks. A stretch without such a place is not divided. Equal long texts
are aligned once.

How often each pair is linked in all texts is one number per pair. Of linked tokens one ends in the
other's bytes, so there are at most as many pairs as the two vocabularies have suffixes (`most_pairs`,
some hundred thousand), however many texts there are: that table is counted by Spark, checked against
this bound, and sent to the tasks that score documents.

Defined results: null and empty texts, and texts whose tokens of A or B do not join to a blank and the
text, have no tokens: zeros and empty text; special tokens' strings inside texts are plain text;
repeated rows are each returned and counted; an empty table gives no rows. Other columns are kept,
columns of the added names replaced. The groups of one text are one string, which Spark holds to 2 GB.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.functions.arrow import map_arrow
from panel360.llm.bpe import PATTERN, byte_symbols
from panel360.llm.common import fresh, slices, stored, without

CHUNK, FANIN = 32_768, 8
ADDED = ("n_a", "n_b", "n_groups", "groups", "pairs", "times")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class Tokenizers:
    """A: the byte-level BPE of a vocabulary file; B: a piece model. Of both, the bytes of each id."""

    def __init__(self, bpe_path: str, piece_path: str):
        with open(bpe_path, encoding="utf-8") as file:
            data = json.load(file)
        vocab, special = data["model"]["vocab"], {t["content"] for t in data["added_tokens"]}
        to_byte = byte_symbols()
        ranks = {bytes(to_byte[c] for c in s): i for s, i in vocab.items() if s not in special}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in data["model"]["merges"]]
        if made != sorted(made) or data["pre_tokenizer"]["type"] != "ByteLevel" or data["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer, its ids in the order of merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces must not join words")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else
                        p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(t) for t in self.a_bytes])
        self.b_len = np.array([len(t) for t in self.b_bytes])
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.names = [f"{i}{end}" for size, ends in ((n, ",|"), (m, ",;")) for end in ends
                      for i in range(size)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        """The ids of each text behind a blank; none where the bytes do not come back."""
        a = [self.a.encode_to_numpy(f" {t}", disallowed_special=()).astype(np.int64) for t in texts]
        b = self.b.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            data = b" " + text.encode()
            if (not text or b"".join(map(self.a_bytes.__getitem__, a[i].tolist())) != data
                    or b"".join(map(self.b_bytes.__getitem__, b[i])) != data):
                a[i], b[i] = a[i][:0], []
        return a, b

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for each pair of ids."""
        return (a * len(self.b_bytes) + b).astype(np.int64)


@lru_cache(maxsize=2)
def tokenizers(bpe_path: str, piece_path: str) -> Tokenizers:
    """One per worker process and pair of files."""
    return Tokenizers(bpe_path, piece_path)


def most_pairs(both: Tokenizers) -> int:
    """How many pairs can be linked at most: those of which one token's bytes end in the other's."""
    a, b = Counter(both.a_bytes), Counter(both.b_bytes)
    return (sum(b[t[i:]] for t in both.a_bytes for i in range(len(t)))
            + sum(a[t[i:]] for t in both.b_bytes for i in range(1, len(t))))


def _cuts(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray):
    """Places in `a` and in `b` of the tokens that end at a cut."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(b_end.searchsorted(a_end), len(b) - 1)
    hit = b_end[at] == a_end
    return np.flatnonzero(hit), at[hit]


def _group_texts(both: Tokenizers, a: np.ndarray, b: np.ndarray, in_a: np.ndarray,
                 in_b: np.ndarray) -> list[str]:
    """The ids of both streams with the marks behind them, group by group; each stream ends at a cut."""
    n, m = len(both.a_bytes), len(both.b_bytes)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[in_a], last_b[in_b] = True, True
    start_a, start_b = (np.concatenate([[0], x + 1]) for x in (in_a, in_b))
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + start_b[np.cumsum(last_a) - last_a]] = a + n * last_a
    codes[np.arange(len(b)) + start_a[np.cumsum(last_b) - last_b + 1]] = 2 * n + b + m * last_b
    return list(map(both.names.__getitem__, codes.tolist()))


class Fragment(NamedTuple):
    """What a range of bytes yields: ids of A and B in the open prefix, the closed groups as text, ids in
    the open suffix. Without a cut all ids are in the prefix."""

    cut: bool
    head_a: list[int]
    head_b: list[int]
    closed: str
    tail_a: list[int]
    tail_b: list[int]


NOTHING = Fragment(False, [], [], "", [], [])


def group(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if not left.cut:
        return right._replace(head_a=left.head_a + right.head_a, head_b=left.head_b + right.head_b)
    if not right.cut:
        return left._replace(tail_a=left.tail_a + right.head_a, tail_b=left.tail_b + right.head_b)
    middle = group(left.tail_a + right.head_a, left.tail_b + right.head_b)
    closed = ";".join(c for c in (left.closed, middle, right.closed) if c)
    return Fragment(True, left.head_a, left.head_b, closed, right.tail_a, right.tail_b)


def finished(whole: Fragment) -> str:
    """The groups of a text from its whole fragment: its start closes the prefix."""
    if not whole.cut:
        return ""
    return ";".join(c for c in (group(whole.head_a, whole.head_b), whole.closed) if c)


def fragment(both: Tokenizers, a: np.ndarray, a_end: np.ndarray, b: np.ndarray,
             b_end: np.ndarray) -> tuple[Fragment, np.ndarray]:
    """The fragment of the tokens that end in one range, and the pairs linked there."""
    in_a, in_b = _cuts(a, a_end, b, b_end)
    if not len(in_a):
        return Fragment(False, a.tolist(), b.tolist(), "", [], []), np.empty(0, np.int64)
    (fa, fb), (la, lb) = (in_a[0] + 1, in_b[0] + 1), (in_a[-1] + 1, in_b[-1] + 1)
    middle = _group_texts(both, a[fa:la], b[fb:lb], in_a[1:] - fa, in_b[1:] - fb)
    return Fragment(True, a[:fa].tolist(), b[:fb].tolist(), "".join(middle)[:-1], a[la:].tolist(),
                    b[lb:].tolist()), both.pairs(a[in_a], b[in_b])


def align(documents: DataFrame, bpe_path: str, piece_path: str, text: str = "text",
          chunk: int = CHUNK) -> DataFrame:
    """`documents` with n_a, n_b (tokens), n_groups, groups (`a1,a2|b1;a3|b2,b3`, ids in order), pairs (the
    linked pairs, each once, as `a * pieces + b`) and times (how often the text links each). The files
    must be on every worker."""
    rows = without(documents, ADDED)
    added = T.StructType([T.StructField(n, T.LongType()) for n in ADDED[:3]]
                         + [T.StructField("groups", T.StringType()),
                            T.StructField("pairs", T.ArrayType(T.LongType())),
                            T.StructField("times", T.ArrayType(T.LongType()))])
    long = F.coalesce(F.octet_length(text) > chunk, F.lit(False))
    schema = T.StructType([*rows.schema.fields, *added.fields])
    short = map_arrow(rows.where(~long), _short(bpe_path, piece_path, rows.columns.index(text), schema.names),
                      schema)
    key = fresh(rows, "key")
    keyed = rows.where(long).withColumn(key, F.sha2(text, 256))
    whole = _long(keyed.select(F.col(key).alias("key"), F.col(text).alias("body")), bpe_path, piece_path,
                  chunk, added)
    joined = keyed.join(whole.withColumnRenamed("key", key).hint("merge"), key).select(schema.names)
    return short.union(joined)


def _counted(owner: np.ndarray, pairs: np.ndarray, n: int) -> list[pa.Array]:
    """For each of `n` owners its pairs, every one once, and their numbers."""
    order = np.lexsort((pairs, owner))
    owner, pairs = owner[order], pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(pairs)))
    ends = pa.array(owner[first].searchsorted(np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in (pairs[first], times)]


def _short(bpe_path: str, piece_path: str, at: int, names: list[str]):
    """Whole texts, a batch of them side by side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, 250_000):
                yield pa.RecordBatch.from_arrays([*batch.columns, *made(batch.column(at))], names)

    def made(texts: pa.Array) -> list[pa.Array]:
        both = tokenizers(bpe_path, piece_path)
        found_a, found_b = both.encode([t or "" for t in texts.to_pylist()])
        count_a, count_b = (np.array([len(x) for x in f]) for f in (found_a, found_b))
        a = np.concatenate(found_a)
        b = np.fromiter(chain.from_iterable(found_b), np.int64, int(count_b.sum()))
        # Each text has the same bytes in both streams, so their ends can be counted through.
        in_a, in_b = _cuts(a, both.a_len[a].cumsum(), b, both.b_len[b].cumsum())
        pieces = _group_texts(both, a, b, in_a, in_b)
        stop = (count_a + count_b).cumsum()
        groups = ["".join(pieces[e - n:e])[:-1] for e, n in zip(stop.tolist(), (count_a + count_b).tolist())]
        owner = np.repeat(np.arange(len(texts)), count_a)[in_a]
        return [pa.array(count_a, pa.int64()), pa.array(count_b, pa.int64()),
                pa.array(np.bincount(owner, minlength=len(texts)), pa.int64()), pa.array(groups, pa.string()),
                *_counted(owner, both.pairs(a[in_a], b[in_b]), len(texts))]
    return run


def _long(texts: DataFrame, bpe_path: str, piece_path: str, chunk: int, added: T.StructType) -> DataFrame:
    """Different long texts (key, body) with what `align` adds, through fragments of their ranges."""
    ranges = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("at", T.LongType()),
        T.StructField("parts", T.LongType()), T.StructField("after", T.LongType()),
        T.StructField("upto", T.LongType()), T.StructField("body", T.StringType())])
    ids = T.ArrayType(T.IntegerType())
    fragments = T.StructType([
        *ranges.fields[:3], T.StructField("ok", T.BooleanType()), T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
        T.StructField("cut", T.BooleanType()), T.StructField("head_a", ids), T.StructField("head_b", ids),
        T.StructField("closed", T.StringType()), T.StructField("tail_a", ids), T.StructField("tail_b", ids),
        added["pairs"], added["times"]])
    # One shuffle spreads the ranges and drops those of equal texts.
    cut = map_arrow(texts, _ranges(chunk, ranges.names), ranges).dropDuplicates(["key", "at"])
    made = stored(map_arrow(cut, _fragments(bpe_path, piece_path, fragments.names), fragments), "fragments")
    left = made.agg(F.max("parts")).first()[0] or 1
    while left > 1:
        dealt = made.withColumn("goal", F.floor(F.col("at") / FANIN))
        made = map_arrow(dealt.repartition("key", "goal").sortWithinPartitions("key", "goal", "at"),
                         _composed(fragments.names), fragments)
        left = -(-left // FANIN)
        if left > 1:
            made = stored(made, "fragments")
    schema = T.StructType([fragments["key"], *added.fields])
    return map_arrow(made, _finished(schema.names), schema)


def _ranges(chunk: int, names: list[str]):
    """The ranges of each text: their number, and the bytes from the last safe place before to the
    first one behind them, of which they are those after `after` up to `upto`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(*(c.to_pylist() for c in batch.columns)):
                data, rows = b" " + body.encode(), []
                bounds, safe = divided(body, len(data), chunk)
                for at, (low, high) in enumerate(zip(bounds, bounds[1:])):
                    begin = safe[safe.searchsorted(low, side="right") - 1]
                    end = safe[safe.searchsorted(high)]
                    rows.append((key, at, len(bounds) - 1, int(low - begin), int(high - begin),
                                 data[begin + 1:end].decode()))
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    return run


def divided(body: str, size: int, chunk: int) -> tuple[list[int], np.ndarray]:
    """Bounds of the ranges of a blank and a text (`size` bytes), each with a safe place inside, and the safe
    places, start and end included."""
    places, chars, offset = [0], 0, 1
    for found in _SAFE.finditer(body):
        offset += len(body[chars:found.start()].encode())
        chars = found.start()
        places.append(offset)
    safe = np.array([*places, size])
    bounds = [0]
    for bound in range(chunk, size, chunk):
        last = safe[safe.searchsorted(bound, side="right") - 1]
        if last > bounds[-1]:
            bounds.append(bound)
    return [*bounds, size], safe


def _fragments(bpe_path: str, piece_path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 5):
                yield from made(batch)

    def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        both = tokenizers(bpe_path, piece_path)
        for key, at, parts, after, upto, body in zip(*(c.to_pylist() for c in batch.columns)):
            (a,), (b,) = both.encode([body])
            b = np.array(b, np.int64)
            ok = len(a) > 0
            a_end, b_end = both.a_len[a].cumsum(), both.b_len[b].cumsum()
            in_a, in_b = ((e > after) & (e <= upto) for e in (a_end, b_end))
            some, pairs = fragment(both, a[in_a], a_end[in_a], b[in_b], b_end[in_b])
            values = [key, at, parts, ok, int(in_a.sum()), int(in_b.sum()), len(pairs), *some]
            yield _row(values, _counted(np.zeros(len(pairs), np.int64), pairs, 1), names)
    return run


def _row(values: list, lists: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    kinds = {list: pa.list_(pa.int32()), int: pa.int64(), bool: pa.bool_(), str: pa.string()}
    return pa.RecordBatch.from_arrays([*(pa.array([v], kinds[type(v)]) for v in values), *lists], names)


def _composed(names: list[str]):
    """Neighbouring fragments, sorted, into one for each goal (the last column)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goal, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n not in ("pairs", "times")}
                lists = [np.asarray(batch.column(n)[i].values) for n in ("pairs", "times")]
                if (row["key"], row["goal"]) != goal:
                    if held:
                        yield closed(held)
                    goal = row["key"], row["goal"]
                    held = [row, NOTHING, True, 0, 0, 0, [], []]
                held[1] = compose(held[1], Fragment(*(row[f] for f in Fragment._fields)))
                held[2] = held[2] and row["ok"]
                for k, n in enumerate(("n_a", "n_b", "n_groups"), 3):
                    held[k] += row[n]
                held[6].append(lists[0])
                held[7].append(lists[1])
        if held:
            yield closed(held)

    def closed(held: list) -> pa.RecordBatch:
        row, whole, ok, n_a, n_b, n_groups, pairs, times = held
        pairs, at = np.unique(np.concatenate(pairs), return_inverse=True)
        times = np.bincount(at, np.concatenate(times), len(pairs)).astype(np.int64)
        lists = [pa.array([v], pa.list_(pa.int64())) for v in (pairs, times)]
        return _row([row["key"], row["goal"], row["parts"], ok, n_a, n_b, n_groups, *whole], lists, names)
    return run


def _finished(names: list[str]):
    """Whole fragments as rows of their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                values = [row["key"], 0, 0, 0, ""]
                lists = [pa.array([[]], pa.list_(pa.int64()))] * 2
                if row["ok"]:
                    values[1:] = [row["n_a"], row["n_b"], row["n_groups"],
                                  finished(Fragment(*(row[f] for f in Fragment._fields)))]
                    lists = [batch.column(n).slice(i, 1) for n in ("pairs", "times")]
                yield _row(values, lists, names)
    return run


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair and n, how many links hold it in all rows."""
    links = aligned.select(F.inline(F.arrays_zip("pairs", "times")))
    return links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))


def score(aligned: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """`aligned` (read more than once) with n_links, n_best (links whose count in all rows is the highest
    of their B id) and count_sum (over links)."""
    both = tokenizers(bpe_path, piece_path)
    bound, pieces = most_pairs(both), len(both.b_bytes)
    counts = stored(link_counts(aligned), "links")
    if counts.count() > bound:
        raise ValueError(f"more than {bound} pairs: not aligned with these vocabularies")
    table = counts.toArrow()
    pair, n = (table[c].to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    highest = np.zeros(pieces, np.int64)
    np.maximum.at(highest, pair % pieces, n)
    sent = aligned.sparkSession.sparkContext.broadcast((pair, n, n == highest[pair % pieces]))
    rows = without(aligned, ["n_links", "n_best", "count_sum"])
    schema = T.StructType([*rows.schema.fields, *(
        T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum"))])
    return map_arrow(rows, _scored(sent, schema.names), schema)


def _scored(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            times = batch.column("times").values.to_numpy()
            ends = lists.offsets.to_numpy()
            at = pair.searchsorted(lists.values.to_numpy())
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times, times * best[at], times * n[at])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)], names)
    return run
