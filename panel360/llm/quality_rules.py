"""Quality rules: counts over each text and a hashed n-gram log-likelihood ratio (native).

Lower-cased words and pairs of neighbouring words are hashed into `BUCKETS`. Two multinomials, one over
the trusted texts and one over all texts, both smoothed by `SMOOTHING` per bucket, give every bucket a
log ratio. A text's verdict is the mean ratio of its n-grams, so that length does not count, against a
fixed threshold: at or above it the text is kept.

Everything is DataFrame functions. A text is split once and each word hashed once; pairs and three-word
windows are hashed from those numbers, and only windows of equal hash are compared by their words. The
n-gram counts leave each task as one row per bucket, and the ratios, `BUCKETS` numbers, come back as a
scalar subquery. Trusted ids, which grow with the corpus, are not broadcast: the texts are shuffled once to
meet them, by id, and build no sort.

Defined results: null and empty texts have no words, fail the base rules and score 0; an id that is
trusted more than once counts once; rows with null id are never trusted, and spread over the join's
tasks; repeated rows are each counted and judged; an empty table gives no rows; with no trusted text all
ratios come from the smoothing alone, which favours no n-gram over its own rarity. Other columns are
kept, columns of the added names replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panel360.llm.common import fresh, let, once, stored, without

BUCKETS, SMOOTHING, THRESHOLD = 1 << 14, 1.0, -0.1
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_SPACE = r"[\x20\x09-\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "")


def _next(hashes: Column) -> Column:
    """A hash for each element but the last and its successor."""
    rest = F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0)))
    here = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.zip_with(here, rest, lambda a, b: F.xxhash64(a, b))


def hashed(df: DataFrame, words: str, single: str, pairs: str) -> DataFrame:
    """`df` with the hash of each lower-cased word and of each pair of neighbours."""
    df = once(df, {single: F.transform(words, lambda w: F.xxhash64(F.lower(w)))})
    return once(df, {pairs: _next(F.col(single))})


def bucket(value: Column) -> Column:
    return value.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")  # BUCKETS is a power of two


def repeated_words(words: Column, windows: Column) -> Column:
    """Words inside three-word windows that occur twice or more, from the words and a hash of each
    window. Windows of equal hash are sorted by their words, and equal neighbours count."""
    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, 32).bitwiseOR(i.cast("long"))))
        maybe = let(placed, lambda p: F.filter(p, lambda e, k: _beside(
            F.shiftright(e, 32), F.shiftright(F.get(p, k - 1), 32), F.shiftright(F.get(p, k + 1), 32))))
        at = F.transform(maybe, lambda e: e.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
        runs = F.sort_array(F.transform(at, lambda i: F.struct(
            F.slice(words, i + 1, F.lit(3)).alias("w"), i.alias("i"))))
        again = let(runs, lambda r: F.filter(r, lambda e, k: _beside(
            e["w"], F.get(r, k - 1)["w"], F.get(r, k + 1)["w"])))
        places = F.sort_array(F.transform(again, lambda e: e["i"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))),
            F.lit(0), lambda a, n: a + n))

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered(windows))


def _beside(value: Column, before: Column, behind: Column) -> Column:
    return (value == before).eqNullSafe(True) | (value == behind).eqNullSafe(True)


def _counted(rows: DataFrame, text: str, words: str, pairs: str) -> DataFrame:
    """`rows` with the five counts and base_failed, from the text, its words and their pairs' hashes."""
    windows = fresh(rows, "windows")
    rows = once(rows, {windows: _next(F.col(pairs))})
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    values = {
        "n_words": F.size(words), "word_chars": F.length(F.concat_ws("", words)),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")),
        "n_dup_lines": let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))),
        "n_repeat_words": repeated_words(F.col(words), F.col(windows))}
    rows = once(rows, {n: v.cast("long") for n, v in values.items()}).drop(windows)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """One row: ratios, an array of the log ratio of each bucket. `trusted` holds ids in `key`."""
    ids = trusted.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().select(
        "key", F.lit(0).cast("long").alias("spread"), F.lit(1).alias("good"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).withColumn(
        "spread", F.when(F.col("key").isNull(), F.xxhash64("body")).otherwise(F.lit(0)))
    rows = rows.join(ids.hint("shuffle_hash"), ["key", "spread"], "left").select("good", "body")
    rows = once(rows, {"words": words_of(F.coalesce("body", F.lit("")))}).drop("body")
    rows = hashed(rows, "words", "single", "pairs").drop("words")
    counts = (rows.select("good", F.explode(F.concat("single", "pairs")).alias("hash"))
              .groupBy(bucket(F.col("hash")).alias("b"))
              .agg(F.count("good").alias("good"), F.count(F.lit(1)).alias("n")))
    every = docs.sparkSession.range(BUCKETS).join(counts, F.col("id") == F.col("b"), "left").select(
        "id", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("n", F.lit(0)).alias("n"))
    table = every.agg(F.sort_array(F.collect_list(F.struct("id", "good", "n"))).alias("t"),
                      F.sum("good").alias("all_good"), F.sum("n").alias("all_n"))
    extra = SMOOTHING * BUCKETS
    return stored(table.select(F.transform("t", lambda e: (
        F.log((e["good"] + SMOOTHING) / (F.col("all_good") + extra))
        - F.log((e["n"] + SMOOTHING) / (F.col("all_n") + extra)))).alias("ratios")), "log-ratios")


def judge(docs: DataFrame, ratios: DataFrame, text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the counts, base_failed, llr (mean log ratio) and kept."""
    rows = without(docs, [*COUNTS, "base_failed", "llr", "kept"])
    words, single, pairs, table, mean = (fresh(rows, n) for n in ("words", "single", "pairs", "table", "mean"))
    rows = once(rows, {words: words_of(F.coalesce(F.col(text), F.lit("")))})
    rows = _counted(hashed(rows, words, single, pairs), text, words, pairs).drop(words)
    # Used in one place only, so that the subquery's value is read there and not copied to each row.
    rows = rows.withColumn(table, ratios.select("ratios").scalar())
    total = F.aggregate(F.concat(single, pairs), F.lit(0.0),
                        lambda a, h: a + F.get(F.col(table), bucket(h)))
    grams = F.size(single) + F.size(pairs)
    rows = rows.withColumn(mean, total / F.greatest(grams, F.lit(1))).drop(table, single, pairs)
    rows = once(rows, {"llr": F.col(mean)}).drop(mean)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
