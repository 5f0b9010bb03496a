"""Lookup of people by partial or misspelt names.

A word of a phrase matches a word of a name that starts with it, or that is `allowed_edits` away from it at
most. Of all people, those who match as many words of the phrase as anyone does are found; of these the
best `k` by the penalty of their matches (0 for the same word, 1 for a beginning, 1 and the edits for
another), then by the edit distance of phrase and name, then by key.

The index has each different word of all names once, with its beginnings and the people who bear it. Words
within d edits have a rest in common, what is left of each without some d letters: these rests are looked
up, so that words of few signs, numbers in sequence for instance, bring no more candidates where there are
more of them. A word of n letters has some n * n / 2 rests; words beyond `LONG` letters are found by trigrams
instead (with two blanks before and behind). They share all but 3 d trigrams, so they share one of the
3 d + 1 rarest of each: only those are looked up. The edit distance decides.

People are not looked up by words that all of them bear. A phrase's matched words are taken from the
rarest on: if someone of a rarer word matches r words, whoever does as well must bear one of the n - r + 1
rarest, and only those words' people are compared.

Defined results: null and empty names are found by nothing, null and empty phrases find nobody; a word
that a phrase repeats counts once; people who share a key are one, under their words together and the
smallest name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panel360.functions import tokens
from panel360.sources.scratch import stored

# Letters from which a word may have one and two edits.
ONE_EDIT, TWO_EDITS = 4, 8
# Letters up to which an asked word is looked up by its rests.
LONG = 24
TASK_WORDS = 20_000
_GRAM, _PAD = 3, "  "


def allowed_edits(word: Column) -> Column:
    n = F.length(word)
    return F.when(n >= TWO_EDITS, 2).when(n >= ONE_EDIT, 1).otherwise(0)


def _rests(words: DataFrame, word: str, edits: Column) -> DataFrame:
    """word, rest: the word, and what is left of it without one letter or, with two `edits`, without two."""
    n = F.length(word)

    def without(text: Column, i: Column) -> Column:
        return F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))

    places = F.sequence(F.lit(1), n)
    one = F.transform(places, lambda i: without(F.col(word), i))
    # The second letter comes behind the first; beyond the end it is none.
    two = F.flatten(F.transform(places, lambda i: F.transform(
        F.sequence(i, n), lambda j: without(without(F.col(word), i), j))))
    rests = F.concat(F.array(word), F.when(edits > 1, two).otherwise(one))
    return words.select(word, F.explode(F.array_distinct(rests)).alias("rest"))


def _grams(words: DataFrame, word: str) -> DataFrame:
    """word, gram: each trigram; the second and later of the same in a word carry their number."""
    padded = F.concat(F.lit(_PAD), F.col(word), F.lit(_PAD))
    cut = words.select(word, F.explode(F.transform(
        F.sequence(F.lit(1), F.length(padded) - _GRAM + 1), lambda i: F.substr(padded, i, F.lit(_GRAM)))).alias("_cut"))
    place = Window.partitionBy(word, "_cut").orderBy("_cut")
    return cut.select(word, F.concat_ws("/", "_cut", F.row_number().over(place)).alias("gram"))


def _rarest(grams: DataFrame, counts: DataFrame, word: str, most: Column) -> DataFrame:
    """word, gram: the `most` rarest trigrams of each word."""
    place = Window.partitionBy(word).orderBy("_n", "gram")
    known = grams.join(counts, "gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return known.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= most).select(
        word, "gram")


def write_names(people: DataFrame, path: str, key: str = "patient_id", name: str = "full_name") -> None:
    """Store the index: `people` (key, name, words), `bearers` (word, key), `words` (word and number of
    bearers), `beginnings`, `rests`, and of long words `counts` of trigrams and the rarest `grams` of each."""
    spark = people.sparkSession
    (people.groupBy(key).agg(F.min(name).alias(name), F.array_distinct(F.flatten(F.collect_set(
        tokens(F.col(name))))).alias("words")).write.parquet(f"{path}/people"))
    bearers = spark.read.parquet(f"{path}/people").select(key, F.explode("words").alias("word"))
    bearers.repartitionByRange("word", key).sortWithinPartitions("word").write.parquet(f"{path}/bearers")
    spark.read.parquet(f"{path}/bearers").groupBy("word").agg(F.count("*").alias("bearers")).write.parquet(
        f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    beginnings = words.select("word", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word")), lambda n: F.left("word", n))).alias("beginning"))
    beginnings.repartitionByRange("beginning", "word").sortWithinPartitions("beginning").write.parquet(
        f"{path}/beginnings")
    # An asked word may have two letters more or less.
    n = F.length("word")
    edits = F.when(n + 2 >= TWO_EDITS, 2).otherwise(1)
    short = words.repartition(max(1, words.count() // TASK_WORDS)).filter((n + 1 >= ONE_EDIT) & (n <= LONG + 2))
    _rests(short, "word", edits).write.parquet(f"{path}/rests")
    grams = _grams(words.filter(n > LONG - 2), "word")
    grams.groupBy("gram").agg(F.count("*").alias("_n")).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    _rarest(grams, counts, "word", F.lit(3 * 2 + 1)).repartitionByRange("gram", "word").sortWithinPartitions(
        "gram").write.parquet(f"{path}/grams")


def word_matches(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """asked, word, penalty: the words of names that each asked word (column `asked`) matches."""
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    words = asked.select("asked").distinct()
    begun = table("beginnings").join(words, F.col("beginning") == F.col("asked")).select(
        "asked", "word", F.when(F.col("asked") == F.col("word"), 0).otherwise(1).alias("penalty"))
    edits = allowed_edits(F.col("asked"))
    long = F.length("asked") > LONG
    probes = _rarest(_grams(words.filter((edits > 0) & long), "asked"), table("counts"), "asked", 3 * edits + 1)
    rests = _rests(words.filter((edits > 0) & ~long), "asked", edits)
    near = table("grams").join(probes, "gram").select("asked", "word").union(
        table("rests").join(rests, "rest").select("asked", "word")).filter(
        F.abs(F.length("asked") - F.length("word")) <= edits)
    far = F.levenshtein("asked", "word", 2)  # -1 beyond
    near = near.withColumn("_far", far).filter((F.col("_far") > 0) & (F.col("_far") <= edits)).select(
        "asked", "word", (F.col("_far") + 1).alias("penalty"))
    return begun.union(near).groupBy("asked", "word").agg(F.min("penalty").alias("penalty"))


def find_names(spark: SparkSession, path: str, phrases: DataFrame, k: int, key: str = "patient_id",
               name: str = "full_name", query_key: str = "qid", query_text: str = "phrase") -> DataFrame:
    """Top k per phrase: query key, key, name, matched (words of the phrase), penalty, distance, rank."""
    asked = phrases.select(query_key, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("asked"))
    matches = stored(word_matches(spark, path, asked), "word-matches")
    words = spark.read.parquet(f"{path}/words")
    borne = matches.join(words, "word").groupBy("asked").agg(F.sum("bearers").alias("_borne"))
    order = Window.partitionBy(query_key).orderBy("_borne", "asked")
    wanted = stored(asked.join(borne, "asked").withColumn("_place", F.row_number().over(order)), "wanted")
    bearers, people = spark.read.parquet(f"{path}/bearers"), spark.read.parquet(f"{path}/people")

    def compared(words: DataFrame) -> DataFrame:
        """Whoever bears a match of one of the words, with the matches of all words of the phrase."""
        some = words.join(matches, "asked").join(bearers, "word").select(query_key, key).distinct()
        own = some.join(people, key).select(query_key, key, F.explode("words").alias("word"))
        all_words = wanted.select(query_key, "asked").join(matches, "asked")
        return (own.join(all_words, [query_key, "word"]).groupBy(query_key, key, "asked")
                .agg(F.min("penalty").alias("_penalty")).groupBy(query_key, key)
                .agg(F.count("*").cast("int").alias("matched"), F.sum("_penalty").alias("penalty")))

    first = stored(compared(wanted.filter("_place = 1")), "compared")
    reached = first.groupBy(query_key).agg(F.max("matched").alias("_reached"))
    counted = wanted.groupBy(query_key).agg(F.count("*").alias("_n")).join(reached, query_key)
    more = wanted.join(counted, query_key).filter(
        (F.col("_n") - F.col("_reached") + 1 > 1) & (F.col("_place") <= F.col("_n") - F.col("_reached") + 1))
    # Those of the rarest word alone are compared already.
    rest = compared(more.select(query_key, "asked")).join(first.select(query_key, key), [query_key, key], "left_anti")
    every = stored(first.union(rest), "compared")
    best = every.join(every.groupBy(query_key).agg(F.max("matched").alias("matched")), [query_key, "matched"])
    named = best.join(people.select(key, name), key).join(phrases.select(query_key, query_text), query_key)
    placed = named.withColumn("distance", F.levenshtein(F.lower(query_text), F.lower(name)))
    rank = Window.partitionBy(query_key).orderBy("penalty", "distance", key)
    return placed.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(
        query_key, key, name, "matched", "penalty", "distance", "rank")
