"""A stored text index in immutable segments, for searches over and over and for tables that grow.

A segment holds the documents of one build or one micro-batch: `documents` (attributes, text, a number in
the segment, length and each term with its count), `postings` (by that number, so that neither keys nor
attributes are copied for each term) in folders by a hash of the term, `terms` (documents and
occurrences per term) and `size`. A later segment can bury documents of earlier ones (`dead`): it then carries
their frequencies and lengths with a minus sign, so the sums over all segments are those of the living
documents alone. A segment counts once its row in `commits`, written last, is there; what a stopped
writer leaves behind is never read, and is replaced when the segment is written again. `merge` writes
the living documents of all segments as one.

NULL texts are no documents. Texts are cut into terms once, when a segment is written; everything else is derived from those counts.
Scores are those of `search.text_search` over the living documents.

A bounded search leaves out what cannot reach rank k. Documents are dealt into blocks, and each block of
them meets all queries in one task, so that no pair of a query and a document is shuffled but the k best of
each query and block. Within a block a query's terms are ordered by the most each can add; its leading terms
are scored first, and the k-th score so far bounds the rest: documents that hold only terms which together
stay below it are never summed, and the postings of trailing terms count for the others alone. The result is
the same as without bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.functions import tokens
from panel360.functions.arrow import ship
from panel360.operators.search import B, K1, SENT_TERMS, _top
from panel360.sources.scratch import stored

# What an index keeps of a chunk besides its terms.
INDEX_ATTRIBUTES = ("doc_id", "scope", "patient_id", "doc_type", "section_heading")
BUCKETS = 64
# Words that a task which writes postings has at least, and documents of a term that one task of a search reads.
TASK_WORDS, TASK_POSTINGS = 1_000_000, 200_000
# How many documents, in multiples of k, the leading terms of a query should hold.
LEAD = 4
# Postings and terms of queries that meet in one task of a bounded search, some tens of megabytes.
BLOCK_POSTINGS, BLOCK_TERMS = 2_000_000, 1_500_000
_SLACK = 1e-3  # for scores that are equal once rounded

NUMBER = "_number"
TERMS = "array<struct<term: string, tf: bigint>>"


def term_counts(words: Column) -> Column:
    """Each term of an array of words with its number, in the order of terms; row-local."""
    def bound(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def counted(s: Column) -> Column:
        places = F.filter(F.transform(s, lambda t, i: F.when(~t.eqNullSafe(F.get(s, i - 1)), i)),
                          lambda i: i.isNotNull())
        return bound(places, lambda p: F.transform(p, lambda i, n: F.struct(
            F.get(s, i).alias("term"),
            (F.coalesce(F.get(p, n + 1), F.size(s)) - i).cast("long").alias("tf"))))
    return bound(F.array_sort(words), counted)


def _save(df: DataFrame, path: str, *folders: str) -> None:
    df.write.mode("overwrite").partitionBy(*folders).parquet(path)


def write_segment(corpus: DataFrame, path: str, segment: int, key: str, text: str,
                  attributes: Sequence[str] = (), dead: DataFrame | None = None,
                  buckets: int = BUCKETS) -> None:
    """Write one segment without committing it. `dead` names (key, of) the documents of committed
    segments that it buries. `buckets` must be the same for all segments of an index."""
    spark = corpus.sparkSession

    def part(table: str) -> str:
        return f"{path}/{table}/segment={segment}"

    cut = corpus.select(key, *attributes, text, F.inline(F.array(F.struct(
        tokens(F.coalesce(F.col(text), F.lit(""))).alias("_words")))))
    _save(cut.select(key, *attributes, text, F.monotonically_increasing_id().alias(NUMBER), F.size("_words").cast("long").alias("doc_length"),
                     term_counts(F.col("_words")).cast(TERMS).alias("terms")), part("documents"))
    documents = spark.read.parquet(part("documents"))
    sums = documents.agg(F.count(text).alias("docs"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("words"))
    _save_postings(spark, path, segment, buckets, sums.first()["words"])
    counts = _table(spark, path, "postings", [segment]).groupBy("term").agg(
        F.count("*").alias("doc_freq"), F.sum("tf").alias("occurrences"))
    none = corpus.limit(0).select(key, F.lit(0).alias("of"))
    _save((none if dead is None else dead).select(key, F.col("of").cast("int").alias("of")), part("dead"))
    if dead is not None:
        buried = _table(spark, path, "documents", committed(spark, path)).join(
            spark.read.parquet(part("dead")).select(F.col(key).alias("_key"), "of"),
            (F.col(key) == F.col("_key")) & (F.col("segment") == F.col("of")))
        counts = counts.unionByName(buried.select(F.inline("terms")).groupBy("term").agg(
            (-F.count("*")).alias("doc_freq"), (-F.sum("tf")).alias("occurrences")))
        sums = sums.union(buried.agg(-F.count(text), -F.coalesce(F.sum("doc_length"), F.lit(0))))
    _save(counts, part("terms"))
    _save(sums, part("size"))


def _save_postings(spark: SparkSession, path: str, segment: int, buckets: int, words: int) -> None:
    """The postings of a segment from the counts that stand with its documents. Nothing is shuffled: each task
    writes its documents' postings, a file for each bucket."""
    documents = spark.read.parquet(f"{path}/documents/segment={segment}")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    _save(documents.coalesce(max(1, words // TASK_WORDS)).select(NUMBER, "doc_length", F.inline("terms"))
          .withColumn("bucket", bucket).sortWithinPartitions("bucket", "term"),
          f"{path}/postings/segment={segment}", "bucket")


def commit(spark: SparkSession, path: str, segment: int, buckets: int = BUCKETS) -> None:
    """From now on the segment is read."""
    _save(spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1),
          f"{path}/commits/segment={segment}")


def _known(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def committed(spark: SparkSession, path: str) -> dict[int, int]:
    """The committed segments and their number of buckets; one small row each."""
    if not _known(spark, f"{path}/commits"):
        return {}
    rows = spark.read.schema("buckets INT, segment INT").parquet(f"{path}/commits").collect()
    return {r["segment"]: r["buckets"] for r in rows}


def write_index(corpus: DataFrame, path: str, key: str, text: str,
                attributes: Sequence[str] = (), buckets: int = BUCKETS) -> None:
    """An index of one segment."""
    write_segment(corpus, path, 0, key, text, attributes, buckets=buckets)
    commit(corpus.sparkSession, path, 0, buckets)


def _table(spark: SparkSession, path: str, table: str, segments: Sequence[int]) -> DataFrame:
    """The rows that some segments have in a table."""
    folders = [f"{path}/{table}/segment={s}" for s in segments]
    reader = spark.read.option("basePath", f"{path}/{table}")
    if table == "postings":  # in folders, of which an empty segment has none
        reader = reader.schema(f"{NUMBER} LONG, doc_length LONG, term STRING, tf LONG, bucket INT, segment INT")
    return reader.parquet(*folders)


def _living(spark: SparkSession, path: str, key: str, segments: Sequence[int]) -> DataFrame:
    """The documents that no committed segment has buried."""
    dead = _table(spark, path, "dead", segments).select(key, F.col("of").alias("segment")).distinct()
    return _table(spark, path, "documents", segments).join(dead, [key, "segment"], "left_anti")


def _postings(spark: SparkSession, path: str, key: str, segments: Sequence[int], columns: Sequence[str],
              terms: DataFrame | None = None) -> DataFrame:
    """The postings of living documents with their key and `columns`; those of some `terms` (bucket, term),
    before anything else."""
    rows = _table(spark, path, "postings", segments)
    if terms is not None:
        rows = rows.join(terms, ["bucket", "term"], "left_semi")
    documents = _living(spark, path, key, segments).select(key, *columns, NUMBER, "segment")
    return rows.join(documents, [NUMBER, "segment"]).drop(NUMBER)


def read_index(spark: SparkSession, path: str, table: str, key: str) -> DataFrame:
    """`documents` or `postings` of the living documents, or the sums of `terms` or `size` over them."""
    segments = sorted(committed(spark, path))
    if table == "documents":
        return _living(spark, path, key, segments).drop(NUMBER)
    if table == "postings":
        # All of a document's columns but its text, the last before its number.
        names = _table(spark, path, "documents", segments).columns
        kept = names[:names.index(NUMBER) - 1]
        return _postings(spark, path, key, segments, [n for n in kept if n != key])
    rows = _table(spark, path, table, segments)
    if table == "size":
        return rows.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    return rows.groupBy("term").agg(
        F.sum("doc_freq").alias("doc_freq"), F.sum("occurrences").alias("occurrences")).where("doc_freq > 0")


def merge(spark: SparkSession, path: str, target: str, key: str, segment: int = 0) -> None:
    """The living documents of all segments as the one segment of a new index. Nothing is cut into
    terms again."""
    held = committed(spark, path)
    if not held:
        return
    segments, buckets = sorted(held), next(iter(held.values()))

    def put(df: DataFrame, table: str, *folders: str) -> None:
        _save(df.drop("segment"), f"{target}/{table}/segment={segment}", *folders)

    put(_living(spark, path, key, segments).withColumn(NUMBER, F.monotonically_increasing_id()), "documents")
    _save_postings(spark, target, segment, buckets, read_index(spark, path, "size", key).first()["words"])
    for table in ("terms", "size"):
        put(read_index(spark, path, table, key), table)
    put(_table(spark, path, "dead", segments).limit(0), "dead")
    commit(spark, target, segment, buckets)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str, text: str,
                 attributes: Sequence[str] = (), query_key: str = "qid",
                 query_text: str = "question", filters: Sequence[str] = (),
                 min_score: float = 0.0, min_coverage: float = 0.0, bounded: bool = False) -> DataFrame:
    """Top k per query over the living documents, with their attributes and text. `filters` name attributes that
    the queries carry too and that must be equal. `bounded` chooses the plan that leaves out documents by
    score bounds: a few jobs more, and far fewer sums to shuffle where queries hold frequent terms."""
    segments = committed(spark, path)
    if not segments:
        raise ValueError(f"no committed segment under {path}")
    if bounded and (filters or min_coverage > 0):
        raise ValueError("bounds hold for queries without filters and min_coverage only")
    size = read_index(spark, path, "size", key).select(F.struct("docs", "words")).scalar()
    mean = F.try_divide(size["words"], size["docs"])
    wanted = queries.select(query_key, *filters, F.array_distinct(tokens(F.col(query_text))).alias("_terms"))
    wanted = wanted.select(query_key, *filters, F.size("_terms").alias("_asked"),
                           F.explode("_terms").alias("term"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(next(iter(segments.values())))).cast("int").alias("bucket")
    terms = stored(wanted.select("term").distinct().select(bucket, "term"), "terms")
    terms = F.broadcast(terms) if terms.count() <= SENT_TERMS else terms
    known = read_index(spark, path, "terms", key).join(terms.select("term"), "term", "left_semi")
    df = F.col("doc_freq")
    idf = F.log(1 + (size["docs"] - df + 0.5) / (df + 0.5))
    weights = wanted.join(known.withColumn("_idf", idf), "term").select(
        query_key, *filters, "_asked", "term", "_idf", "doc_freq", bucket)
    postings = _postings(spark, path, key, sorted(segments), filters, terms).select(
        key, "segment", *filters, "doc_length", "term", "tf", "bucket")
    if not bounded:
        scored = _summed(_met(postings, weights, key, filters), query_key, key, mean)
    else:
        scored = _bounded_scores(postings, weights, k, query_key, key, mean)
    scored = scored.select(query_key, key, "segment", F.round("_sum", 4).alias("score"),
                           F.round(F.col("_hits") / F.col("_asked"), 4).alias("coverage"))
    kept = scored.filter((F.col("score") > min_score) & (F.col("coverage") >= min_coverage))
    best = _top(kept, query_key, key, k)
    texts = _living(spark, path, key, sorted(segments)).select(key, "segment", *attributes, text)
    return best.join(texts, [key, "segment"]).drop("segment")


def _met(postings: DataFrame, weights: DataFrame, key: str, filters: Sequence[str] = ()) -> DataFrame:
    """Postings with the queries that ask for them. A term of very many documents is spread: its postings
    take a salt from their key, and its queries are copied to each salt."""
    if filters:
        return postings.join(weights, ["bucket", "term", *filters])
    parts = F.ceil(F.col("doc_freq") / TASK_POSTINGS).cast("int")
    hot = weights.where(F.col("doc_freq") > TASK_POSTINGS).select("term", parts.alias("_parts")).distinct()
    salted = postings.join(hot, "term", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    asked = weights.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))))
    return salted.join(asked, ["bucket", "term", "_salt"])


def _gain(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _summed(pairs: DataFrame, query_key: str, key: str, mean: Column) -> DataFrame:
    return pairs.groupBy(query_key, key, "segment").agg(
        F.sum(F.col("_idf") * _gain(F.col("tf"), F.col("doc_length"), mean)).alias("_sum"),
        F.count("*").alias("_hits"), F.max("_asked").alias("_asked"))


def _bounded_scores(postings: DataFrame, weights: DataFrame, k: int, query_key: str, key: str,
                    mean: Column) -> DataFrame:
    """Sums of the documents that are among the best k of a query in their block, or may tie with them."""
    spark = postings.sparkSession
    asked = stored(weights.select(query_key, "_asked", "term", "_idf", "doc_freq"), "weights")
    held, terms = asked.agg(F.count("*"), F.sum("doc_freq")).first()[0], asked.select(
        "term", "doc_freq").distinct().agg(F.coalesce(F.sum("doc_freq"), F.lit(0))).first()[0]
    blocks, query_blocks = max(1, -(-terms // BLOCK_POSTINGS)), max(1, -(-held // BLOCK_TERMS))

    def deal(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    documents = postings.select(
        deal(key, blocks).alias("_block"), every(query_blocks).alias("_query_block"), key, "segment", "term",
        _gain(F.col("tf"), F.col("doc_length"), mean).alias("_gain"))
    queries = asked.select(
        every(blocks).alias("_block"), deal(query_key, query_blocks).alias("_query_block"), query_key, "term",
        "_asked", "_idf")
    schema = T.StructType([asked.schema[query_key], postings.schema[key], postings.schema["segment"],
                           T.StructField("_sum", T.DoubleType()), T.StructField("_hits", T.LongType()),
                           T.StructField("_asked", T.IntegerType())])
    ship(spark)
    cell = ["_block", "_query_block"]
    best = documents.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(
        _block_best(k, LEAD * k, query_key, key, schema.names), schema)
    return stored(best, "sums")


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each different value, NULL being one."""
    return pc.dictionary_encode(column, null_encoding="encode").combine_chunks().indices.to_numpy()


class _Block:
    """The postings of a block of documents by term. Repeated postings of a term and document are one,
    with the gains and the number of all."""

    def __init__(self, postings: pa.Table, key: str):
        names = postings["term"].combine_chunks().dictionary_encode()
        self.terms, term = names.dictionary, names.indices.to_numpy()
        _, self.row, document = np.unique(
            np.stack([_codes(postings[key]), postings["segment"].to_numpy()]), axis=1, return_index=True,
            return_inverse=True)
        self.documents = len(self.row)
        place, inverse = np.unique(term.astype(np.int64) * self.documents + document.ravel(), return_inverse=True)
        self.document = place % self.documents
        self.gain = np.bincount(inverse, postings["_gain"].to_numpy())
        self.times = np.bincount(inverse)
        self.ends = np.searchsorted(place, np.arange(len(self.terms) + 1) * self.documents)
        self.most = np.maximum.reduceat(self.gain, self.ends[:-1]) if len(self.gain) else self.gain

    def of(self, term: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `some` documents have a term, and their postings."""
        begin, end = self.ends[term], self.ends[term + 1]
        at = begin + np.searchsorted(self.document[begin:end], some)
        found = np.flatnonzero((at < end) & (self.document[np.minimum(at, end - 1)] == some))
        return found, at[found]

    def best(self, terms: np.ndarray, idf: np.ndarray, k: int, lead: int,
             sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, sums and hits of a query whose terms come in the order of the most they add."""
        sums.fill(0)
        rest = np.cumsum((idf * self.most[terms])[::-1])[::-1]
        held, floor, n = 0, None, 0
        while n < len(terms):
            if floor is None and held >= lead:
                floor = _floor(sums, k)
            if floor is not None and rest[n] < floor:
                break
            begin, end = self.ends[terms[n]], self.ends[terms[n] + 1]
            sums[self.document[begin:end]] += idf[n] * self.gain[begin:end]
            held, n = held + end - begin, n + 1
        left = rest[n] if n < len(terms) else 0.0
        some = np.flatnonzero(sums > max(0.0, (_floor(sums, k) if floor is None else floor) - left))
        total = sums[some]
        for i in range(n, len(terms)):
            found, at = self.of(terms[i], some)
            total[found] += idf[i] * self.gain[at]
        chosen = total >= _floor(total, k)
        some, total = some[chosen], total[chosen]
        hits = np.zeros(len(some), np.int64)
        for term in terms:
            found, at = self.of(term, some)
            hits[found] += self.times[at]
        return some, total, hits


def _floor(sums: np.ndarray, k: int) -> float:
    """What the k-th highest sum, once rounded, is not below."""
    return float(np.partition(sums, -k)[-k]) - _SLACK if len(sums) >= k else 0.0


def _block_best(k: int, lead: int, query_key: str, key: str, names: list[str]) -> Callable:
    """The best k of each query among the documents of a block."""
    def best(postings: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        block = _Block(postings, key)
        term = pc.index_in(queries["term"].combine_chunks(), block.terms)
        queries, term = queries.filter(term.is_valid()), term.drop_null().to_numpy()
        query = _codes(queries[query_key])
        idf = queries["_idf"].to_numpy()
        order = np.lexsort((-idf * block.most[term], query))
        ends = np.flatnonzero(np.diff(query[order], prepend=-1, append=-1))
        sums = np.zeros(block.documents)
        for begin, end in zip(ends, ends[1:]):
            at = order[begin:end]
            some, total, hits = block.best(term[at], idf[at], k, lead, sums)
            found.append((np.full(len(some), at[0]), block.row[some], total, hits))
        asked, row, total, hits = (np.concatenate(c) for c in zip(*found))
        return pa.Table.from_arrays([
            queries[query_key].take(pa.array(asked)), postings[key].take(pa.array(row)),
            postings["segment"].take(pa.array(row)), pa.array(total), pa.array(hits),
            queries["_asked"].take(pa.array(asked))], names)
    return best


def distinctive_terms(spark: SparkSession, path: str, key: str, asked: Column, n: int = 12,
                      query_key: str = "qid", query_text: str = "question") -> DataFrame:
    """For each living document that meets `asked` a query of its `n` terms of highest tf * idf over the
    whole text: what to ask for documents like it."""
    size = read_index(spark, path, "size", key).select(F.struct("docs", "words")).scalar()
    df = F.col("doc_freq")
    idf = F.log(1 + (size["docs"] - df + 0.5) / (df + 0.5))
    rows = read_index(spark, path, "documents", key).filter(asked).select(key, F.inline("terms"))
    known = read_index(spark, path, "terms", key).select("term", idf.alias("_idf"))
    weighed = rows.join(known, "term").select(
        F.col(key).alias(query_key), "term", F.round(F.col("tf") * F.col("_idf"), 6).alias("_weight"))
    place = Window.partitionBy(query_key).orderBy(F.desc("_weight"), "term")
    best = weighed.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= n)
    return best.groupBy(query_key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("_place", "term"))), lambda t: t["term"]), " ").alias(query_text))
