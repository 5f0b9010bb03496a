"""Text and vector retrieval: attribute filters first, then a score, then the best k.

Scores are rounded to four places and ties go to the smaller key, so a ranking does not depend on
the order in which partial sums meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from panel360.functions import tokens
from panel360.functions.arrow import map_arrow

# Results per tool.
POLICY_K, NOTES_K, LOOKUP_K = 8, 6, 5
K1, B = 1.2, 0.75
RRF_OFFSET = 60
BLOCK = 4096
# So many different terms, some megabytes, are sent to the tasks that read postings; more are shuffled.
SENT_TERMS = 200_000


def postings(corpus: DataFrame, key: str, text: str, attributes: Sequence[str] = ()) -> DataFrame:
    """Inverted index: term, document key, filter attributes, document length, term frequency.
    Repeats inside a document are counted before the shuffle."""
    terms = corpus.select(key, *attributes, tokens(F.col(text)).alias("_terms"))
    return (terms.select(key, *attributes, F.size("_terms").alias("doc_length"),
                         F.explode("_terms").alias("term"))
            .groupBy(key, *attributes, "doc_length", "term").agg(F.count("*").alias("tf")))


def term_stats(index: DataFrame) -> DataFrame:
    """Documents and occurrences per term of an index."""
    return index.groupBy("term").agg(F.count("*").alias("doc_freq"),
                                     F.sum("tf").alias("occurrences"))


def corpus_terms(corpus: DataFrame, text: str) -> DataFrame:
    """The same straight from texts, with one shuffle: a text's sorted terms show where each occurs
    first, and both numbers are counted before the shuffle."""
    rows = corpus.select(F.inline(F.array(F.struct(F.array_sort(tokens(F.col(text))).alias("_terms")))))
    terms = F.transform("_terms", lambda t, i: F.struct(
        t.alias("term"), (~t.eqNullSafe(F.get("_terms", i - 1))).alias("_first")))
    return rows.select(F.inline(terms)).groupBy("term").agg(
        F.count_if("_first").alias("doc_freq"), F.count("*").alias("occurrences"))


def _top(scored: DataFrame, query_key: str, key: str, k: int, *ties: Column) -> DataFrame:
    place = Window.partitionBy(query_key).orderBy(F.desc("score"), *ties, F.asc(key))
    return scored.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def _bounded(queries: DataFrame, max_queries: int) -> DataFrame:
    """The queries, or an error when there are more than `max_queries` of them."""
    n = queries.select(F.count("*")).scalar()
    few = F.when(n <= max_queries, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"more than {max_queries} queries")).cast("boolean"))
    return queries.filter(few)


def text_scores(corpus: DataFrame, queries: DataFrame, key: str, text: str,
                query_key: str = "qid", query_text: str = "question",
                filters: Sequence[str] = (), carry: Sequence[str] = (),
                max_queries: int | None = None, salts: int | None = None) -> DataFrame:
    """BM25 score and term coverage of every (query, document) pair that shares a term.

    `filters` name columns present on both sides; a document is scored only where they are equal.
    `carry` names columns of the document to keep.

    Occurrences are counted per document before they are shuffled. With `max_queries` the query
    side is checked against that bound and broadcast. Only query terms leave the scan, unless they are more
    than can be sent to the tasks. Without `max_queries` nothing is moved by term alone: the counts meet the queries on (term, filters), or on (term,
    salt) where there is no filter, so that a term found in most documents is spread over all salts,
    as many as the session's shuffle partitions unless given. For searches over and over, or by very
    many queries, store an index (`write_index`) and use `search_index`.
    """
    if max_queries is not None:
        queries = _bounded(queries, max_queries)
    wanted = queries.select(query_key, *filters,
                            F.array_distinct(tokens(F.col(query_text))).alias("_terms"))
    wanted = wanted.select(query_key, *filters, F.size("_terms").alias("_asked"),
                           F.explode("_terms").alias("term"))
    docs = corpus.select(key, *filters, *carry, tokens(F.col(text)).alias("_terms"))
    # One term more, the empty one, stands for the document itself: it gives the number of documents
    # and their length from the same counts, so that the corpus is read and cut up once.
    found = docs.select(key, *filters, *carry, F.size("_terms").alias("doc_length"),
                        F.explode(F.concat("_terms", F.array(F.lit("")))).alias("term"))
    asked = wanted.select("term").union(wanted.sparkSession.sql("SELECT '' AS term")).distinct()
    if max_queries is not None or asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS:
        found = found.join(F.broadcast(asked), "term", "left_semi")
    hits = (found.groupBy(key, *filters, *carry, "doc_length", "term")
            .agg(F.count("*").alias("tf")))
    # Both uses of `hits` below keep the columns of the third, so that all share one shuffle.
    same = F.count_if(F.col("tf") > 0)
    size = hits.filter("term = ''").select(F.struct(
        same.alias("docs"), F.avg("doc_length").alias("mean_length"))).scalar()
    n_docs, mean_length = size["docs"], size["mean_length"]
    doc_freq = hits.groupBy("term").agg(same.alias("_df"))
    df = F.col("_df")
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    if max_queries is not None:
        weights = wanted.join(doc_freq, "term").withColumn("_idf", idf)
        pairs = hits.join(F.broadcast(weights), ["term", *filters])
    else:
        # Few terms may be shared by very many queries, and by very many documents: either large
        # side takes a salt from its own key, and the table of terms is copied once per salt.
        salts = salts or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        weights = (wanted.withColumn("_salt", F.pmod(F.hash(query_key), F.lit(salts)))
                   .join(doc_freq.withColumn("_salt", every), ["term", "_salt"]).drop("_salt")
                   .withColumn("_idf", idf))
        if filters:
            pairs = hits.join(weights, ["term", *filters])
        else:
            pairs = (hits.withColumn("_salt", F.pmod(F.hash(key), F.lit(salts)))
                     .join(weights.withColumn("_salt", every), ["term", "_salt"]))
    return _scores(pairs, query_key, key, carry, mean_length)


def _scores(pairs: DataFrame, query_key: str, key: str, carry: Sequence[str],
            mean_length: Column) -> DataFrame:
    tf = F.col("tf")
    gain = F.col("_idf") * tf * (K1 + 1) / (
        tf + K1 * (1 - B + B * F.col("doc_length") / mean_length))
    return pairs.groupBy(query_key, key, *carry).agg(
        F.round(F.sum(gain), 4).alias("score"),
        F.round(F.count("*") / F.max("_asked"), 4).alias("coverage"))


def text_search(corpus: DataFrame, queries: DataFrame, k: int, key: str, text: str,
                query_key: str = "qid", query_text: str = "question",
                filters: Sequence[str] = (), min_score: float = 0.0,
                min_coverage: float = 0.0, max_queries: int | None = None) -> DataFrame:
    """Top k per query: query key, document key, score, coverage, rank. Hits not above `min_score`,
    or holding less than `min_coverage` of the query's distinct terms, are dropped, so a question
    the corpus does not cover has no rows."""
    scored = text_scores(corpus, queries, key, text, query_key, query_text, filters,
                         max_queries=max_queries)
    kept = scored.filter((F.col("score") > min_score) & (F.col("coverage") >= min_coverage))
    return _top(kept, query_key, key, k)


def no_evidence(queries: DataFrame, results: DataFrame, query_key: str = "qid") -> DataFrame:
    """The queries without a single hit."""
    return queries.join(results.select(query_key), query_key, "left_anti")


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def with_norm(df: DataFrame, vector: str) -> DataFrame:
    """The vector in double precision and its length, computed once per row."""
    df = df.withColumn(vector, F.col(vector).cast("array<double>"))
    return df.withColumn("_norm", F.sqrt(_dot(F.col(vector), F.col(vector))))


def _cosine(vector: str, query_vector: str) -> Column:
    lengths = F.col("_norm") * F.col("_query_norm")
    return F.round(F.try_divide(_dot(F.col(vector), F.col(query_vector)), lengths), 4)


def vector_search(corpus: DataFrame, queries: DataFrame, k: int, key: str, vector: str,
                  filters: Sequence[str], query_key: str = "qid",
                  query_vector: str = "query_vector") -> DataFrame:
    """Cosine top k per query for any number of queries, each admitting the documents whose
    `filters` equal its own (one patient's notes, say). Exact: every admitted document is scored,
    and each task keeps its own best k before the final ranking is shuffled."""
    if not filters:
        raise ValueError("a filter column is required; vector_scan searches without one")
    asked = with_norm(queries.select(query_key, query_vector, *filters), query_vector)
    docs = with_norm(corpus.select(key, vector, *filters), vector)
    pairs = docs.join(asked.withColumnRenamed("_norm", "_query_norm"), list(filters))
    return _top(pairs.select(query_key, key, _cosine(vector, query_vector).alias("score")),
                query_key, key, k)


def vector_scan(corpus: DataFrame, queries: DataFrame, k: int, key: str, vector: str,
                query_key: str = "qid", query_vector: str = "query_vector",
                filters: Sequence[str] = (), max_queries: int = 1000) -> DataFrame:
    """Cosine top k per query for a bounded set of queries, in one pass over the corpus.

    The queries, checked against `max_queries`, go to every task, which multiplies them with a block of
    vectors at a time and hands on the k best of each query and block. The corpus is neither joined
    nor shuffled, and no pair beyond those k leaves a task. Vectors of other lengths than a query's,
    null and zero vectors have no cosine and are not found.
    """
    asked = queries.select(query_key, F.col(query_vector).cast("array<double>"), *filters).limit(
        max_queries + 1).collect()
    if len(asked) > max_queries:
        raise ValueError(f"more than {max_queries} query vectors")
    schema = T.StructType([queries.schema[query_key], corpus.schema[key],
                           T.StructField("score", T.DoubleType())])
    by_length: dict[int, list[int]] = {}
    for i, row in enumerate(asked):
        if row[1]:
            by_length.setdefault(len(row[1]), []).append(i)
    sent = corpus.sparkSession.sparkContext.broadcast(
        [(n, at, _unit(np.array([asked[i][1] for i in at], float))) for n, at in by_length.items()])
    wanted = [tuple(row)[2:] for row in asked]
    names, name_type = [row[0] for row in asked], to_arrow_type(queries.schema[query_key].dataType)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                found = [hit for n, held, matrix in sent.value
                         for hit in _best_of(batch, n, held, matrix, wanted, k)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[q] for q, _, _ in found], name_type),
                    batch.column(0).take(pa.array([i for _, i, _ in found], pa.int64())),
                    pa.array([s for _, _, s in found], pa.float64())], schema.names)

    rows = corpus.select(key, F.col(vector).cast("array<double>"), *filters)
    found = map_arrow(rows, best, schema).withColumn("score", F.round("score", 4))
    return _top(found, query_key, key, k)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; a zero vector becomes NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _best_of(batch: pa.RecordBatch, n: int, held: list[int], matrix: np.ndarray, wanted: list[tuple],
             k: int) -> Iterator[tuple[int, int, float]]:
    """(query, row, score) of the k best rows of a block for each query, with all that may tie with
    the last of them once scores are rounded."""
    vectors = batch.column(1)
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy() == n)
    if not len(rows):
        return
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    scores = matrix @ _unit(flat.astype(float).reshape(-1, n)).T
    filters = [batch.column(c).take(pa.array(rows)) for c in range(2, batch.num_columns)]
    for q, row in zip(held, scores):
        admitted = np.isfinite(row)
        for column, value in zip(filters, wanted[q]):
            same = pc.equal(column, pa.scalar(value, column.type))
            admitted &= pc.fill_null(same, False).to_numpy(zero_copy_only=False)
        row = np.where(admitted, row, -np.inf)
        edge = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        for i in np.flatnonzero(admitted & (row >= edge - 1e-4)):
            yield q, int(rows[i]), float(row[i])


def fuse(rankings: Sequence[DataFrame], k: int, key: str, query_key: str = "qid") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists. The lists are added up per (query, document), so a
    document found by one list only keeps its share without an outer join."""
    shares = [r.select(query_key, key, (F.lit(1.0) / (RRF_OFFSET + F.col("rank"))).alias("share"))
              for r in rankings]
    both = shares[0]
    for more in shares[1:]:
        both = both.unionByName(more)
    summed = both.groupBy(query_key, key).agg(F.round(F.sum("share"), 6).alias("score"))
    return _top(summed, query_key, key, k)


def lookup_blob(p360: DataFrame) -> DataFrame:
    """What a patient can be found by; NULL in any part makes the blob NULL."""
    return p360.select(
        "patient_id", "full_name", "attributed_clinic", "line_of_business",
        F.concat("patient_id", F.lit(" "), "full_name", F.lit(" "), "attributed_clinic",
                 F.lit(" "), "line_of_business", F.lit(" age "), "age_years", F.lit(" "), "sex")
        .alias("search_blob"))


def patient_lookup(p360: DataFrame, phrases: DataFrame, k: int = LOOKUP_K,
                   query_key: str = "qid", query_text: str = "phrase",
                   max_queries: int | None = None) -> DataFrame:
    """Free text to patient ids. Equal text scores are ordered by the edit distance between the
    phrase and the name."""
    found = text_scores(lookup_blob(p360), phrases, "patient_id", "search_blob", query_key,
                        query_text, carry=("full_name", "attributed_clinic", "line_of_business"),
                        max_queries=max_queries)
    named = (found.join(phrases.select(query_key, query_text), query_key)
             .withColumn("distance", F.levenshtein(F.lower(query_text), F.lower("full_name"))))
    return _top(named, query_key, "patient_id", k, F.asc("distance"))
