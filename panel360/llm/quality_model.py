"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A word (a run without white space, lower-cased; a word that repeats the one before it gives a mark
that counts as one more word) has one vector for itself and one for each of
its character n-grams, all found by hash; the word's vector is their mean, a document's the mean of its
words', and a softmax layer turns that into the probability of label 1. Vectors and layer are
learned together on the driver from a sample of labelled documents, of at most `MAX_ROWS` rows and
`MAX_BYTES` bytes of whole texts, taken in the order of a hash of their id. A text that does not fit into
what is left is passed over and later ones are taken; sizes and hashes choose the sample, and only
chosen texts are moved. If these bounds leave out one of two labels, an error is raised.

For scoring, each hashed vector is multiplied with the layer once, so a model is one number per
bucket and a bias: `BUCKETS` floats sent to the tasks. Each task keeps the values of about `MEMORY`
words it has met. Rows are neither shuffled nor grouped.

Defined results: null and empty texts score by the bias; labels other than 0 and 1 are left out;
ids labelled more than once count once for each label; repeated rows are each scored, and the one with
the smallest text hash is trained on; an empty table gives no rows; without labelled rows, or with one
label only, every score is 0.5 (a warning says so where there are labels). Other columns are kept,
columns of the added names replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.functions.arrow import map_arrow
from panel360.llm.common import slices, stored, without

BUCKETS, WIDTH, GRAMS = 1 << 17, 8, (3, 4)
MAX_ROWS, MAX_BYTES = 4000, 32_000_000
EPOCHS, RATE, SEED = 6, 2.0, 7
MEMORY, _LONG = 150_000, 64
_PRIME, _AGAIN = np.uint64(0x100000001B3), "\0again"


def held_out(key: Column) -> Column:
    """Whether an id is kept from training: crc32 of its text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, with their ends marked, word after word, and
    how many belong to each word."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(length) - length
    word = np.repeat(np.arange(len(words)), length)
    left = np.repeat(start + length, length) - np.arange(len(codes))  # to the end of the word
    place = np.arange(len(codes)) - start[word]
    whole = np.add.reduceat((codes + np.uint64(1)) * _powers(int(length.max()))[place], start)
    hashes, owner, value = [whole], [np.arange(len(words))], np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS[-1] + 1):
        value = value[:len(codes) - n + 1] * _PRIME + codes[n - 1:]
        if n >= GRAMS[0]:
            inside = left[:len(value)] >= n
            hashes.append(value[inside] ^ np.uint64(n << 56))
            owner.append(word[:len(value)][inside])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    mixed = np.concatenate(hashes)[order] * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(31))) & np.uint64(BUCKETS - 1)).astype(np.int64), \
        np.bincount(owners, minlength=len(words))


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _PRIME, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def words_of(text: str | None) -> list[str]:
    """The words of a text, and at the end one mark for each word that repeats the one before."""
    words = (text or "").lower().split()
    return words + [_AGAIN] * sum(map(eq, words, words[1:]))


def document_features(words: list[str], known: dict[str, np.ndarray]) -> tuple:
    """Buckets of a document and their weights, which sum to 1."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    if new := [w for w in dict.fromkeys(words) if w not in known]:
        buckets, sizes = word_buckets(new)
        known.update(zip(new, np.split(buckets, np.cumsum(sizes)[:-1])))
    found = [known[w] for w in words]
    sizes = np.array([len(f) for f in found])
    weights = np.repeat(1.0 / sizes / len(words), sizes)
    buckets, at = np.unique(np.concatenate(found), return_inverse=True)
    return buckets.astype(np.int32), np.bincount(at, weights=weights).astype(np.float32)


@dataclass
class Model:
    """The value of each bucket and the bias: the log odds of label 1 are their mean over a text."""
    values: np.ndarray
    bias: float

    def word_values(self, words: list[str]) -> list[float]:
        """The mean over each word's buckets."""
        buckets, sizes = word_buckets(words)
        sums = np.add.reduceat(self.values[buckets].astype(np.float64), np.cumsum(sizes) - sizes)
        return (sums / sizes).tolist()


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE,
          seed: int = SEED) -> Model:
    """Stochastic gradient descent on the cross entropy, one document a step, the rate falling to 0.
    Both labels weigh the same."""
    marks = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng, known = np.random.default_rng(seed), {}
    docs = [document_features(words_of(t), known) for t in texts]
    known.clear()
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    weight = len(marks) / (2 * np.bincount(marks, minlength=2))
    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            buckets, share = docs[i]
            now, step = rate * (1 - step / steps), step + 1
            mean = share @ vectors[buckets]
            logits = mean @ layer + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[marks[i]] -= 1
            error *= np.float32(weight[marks[i]])
            back = np.clip(layer @ error, -1, 1)
            layer -= now * np.outer(mean, error)
            bias -= now * error
            vectors[buckets] -= now * share[:, None] * back
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                    max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """At most `max_rows` labelled rows, not held out, and `max_bytes` bytes of their whole texts."""
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).select(
        F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(
        "key IS NOT NULL AND text IS NOT NULL")
    measured = F.struct(F.xxhash64("text").alias("at"), F.octet_length("text").alias("size"))
    sized = rows.groupBy("key").agg(F.min(measured).alias("one")).select(
        F.xxhash64("key").alias("place"), "key", "one.*").join(usable, "key")
    sized = stored(sized.select("place", "key", "label", "at", "size"), "training-sample")
    chosen = _choose(sized, max_rows, max_bytes)
    if len({r["label"] for r in chosen}) < 2:
        known = sized.select("label").distinct().count()
        if known == 2:
            raise ValueError("the bounds of the training sample leave out a label: "
                             f"{len(chosen)} rows in max_rows={max_rows}, max_bytes={max_bytes}")
        if usable.take(1):
            warnings.warn(f"labelled texts have {known} of 2 labels, so every score is 0.5")
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], sized.schema)
    found = rows.join(F.broadcast(wanted), "key").where(
        (F.xxhash64("text") == F.col("at")) & (F.octet_length("text") == F.col("size")))
    found = found.groupBy("key", "label", "at").agg(F.min("text").alias("text"))
    return [(r["text"], r["label"]) for r in found.orderBy("at", "text", "label").collect()]


def _choose(sized: DataFrame, max_rows: int, max_bytes: int) -> list[Row]:
    """Rows in the order of their place, each that fits into what is left of the bounds. A round
    fetches the next rows that may fit, without their texts; the first one of a round does."""
    chosen, left, after = [], max_bytes, F.lit(True)
    names = ["place", "key", "label"]
    while len(chosen) < max_rows:
        asked = max_rows - len(chosen)
        fitting = sized.where((F.col("size") <= left) & after)
        found = fitting.orderBy(*names).limit(asked).collect()
        for row in found:
            if row["size"] <= left:
                chosen.append(row)
                left -= row["size"]
        if len(found) < asked:
            break
        after = F.struct(*names) > F.struct(*[
            F.lit(found[-1][n]).cast(sized.schema[n].dataType).alias(n) for n in names])
    return chosen


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "quality", **options) -> Model:
    sample = training_sample(docs, labels, key, text, label)
    return train([t for t, _ in sample], [y for _, y in sample], **options)


class Scorer:
    """A model with the values of the words met so far."""

    def __init__(self, model: Model):
        self.model, self.met = model, {}

    def score_all(self, texts: list[str | None]) -> list[float]:
        words, met, out = [words_of(t) for t in texts], self.met, []
        new = list({w for found in words for w in found if w not in met})
        met.update(zip(new, self.model.word_values(new)) if new else ())
        for found in words:
            mean = sum(map(met.__getitem__, found)) / len(found) if found else 0.0
            out.append(float(1 / (1 + np.exp(-np.clip(self.model.bias + mean, -700, 700)))))
        if len(met) > MEMORY or any(len(w) > _LONG for w in new):
            met.clear()
        return out


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from a score of 0.5)."""
    rows = without(docs, ["score", "predicted"])
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for whole in batches:
            for batch in slices(whole, at):
                values = scorer.score_all(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(values, pa.float64()),
                     pa.array([int(v >= 0.5) for v in values], pa.int32())], schema.names)

    return map_arrow(rows, run, schema)
