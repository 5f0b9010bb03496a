"""URL filters: rules first, then logistic regression on hashed character n-grams (native).

Host and path of a URL give n-grams of `GRAMS` characters, host and path apart, hashed into
`BUCKETS`; a URL's features are its counts over the square root of their number. Training is batch
gradient descent over a small labelled table, in one row of arrays: the table's size is checked
against `MAX_LABELLED`, so that row is bounded whatever is scored. Scoring is row by row, without a
shuffle; the weights, `BUCKETS` + 1 numbers, come as a scalar subquery.

A rule is a host and a path, like `example.net/en/`. It fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's; the longest that fits wins, the first of
equally long ones. Rules are written by the caller and checked against `MAX_RULES`.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and gets
the model's bias; ports and user names belong to the host; repeated rows are each judged; an empty
table gives no rows, an empty labelled table judges by a score of 0.5, which allows. Labelled rows
with null URL count as empty, with null label they are left out. Other columns are kept, columns of the
added names replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panel360.llm.common import fresh, let, once, stored, without

GRAMS, BUCKETS = (3, 4), 4096
EPOCHS, RATE, DECAY = 200, 32.0, 1e-4
MAX_LABELLED, MAX_RULES = 2000, 1000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words of the hosts of the labelled table: to block, to allow, and syllables of invented names to allow.
BLOCKED = ("casinos", "gambling", "jackpots", "slots", "poker", "betting", "wagers", "winner", "winnings",
           "prizes", "lottery", "freebies", "freegift", "pharmacy", "pill", "tablets", "viagra", "cheapest",
           "discounts", "adults", "porno", "sexcam", "xxx", "spamming", "spammer", "malware", "phishing",
           "warez", "cracked", "adtracking", "clickads", "tracker", "popups", "payday")
ALLOWED = ("news", "wiki", "docs", "library", "museum", "school", "health", "weather", "science", "garden",
           "travel", "forum", "cooking", "kitchen", "history", "music", "theatre", "stories", "village", "river",
           "building", "cycling", "letters", "harbour", "colleges", "station", "evening", "orchards", "students",
           "galleries", "sailing", "parents", "hiking", "cities")
SYLLABLES = ("the", "th", "er", "on", "an", "tion", "ing", "re", "in", "nd", "es", "en", "ed", "or", "st", "ti",
             "ar", "al", "le", "ble", "ha", "he", "nt", "ou", "ea", "to", "ly", "sh", "wh", "me", "ra", "lo", "ve",
             "ka")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, label (1: block). Hosts are two words, with or without a hyphen, or
    names of two and three syllables; subdomains, suffixes and paths go round in the same way for both
    labels, so that nothing but the host's name tells them apart."""
    def words(values: tuple[str, ...]) -> str:
        return f"array({', '.join(repr(v) for v in values)})"

    def hosts(values: tuple[str, ...], label: int, steps: int, third: str = "''") -> str:
        n = len(values)
        return (f"SELECT concat(word, if(step % 2 = 0 AND {third} = '', '-', ''), "
                f"get(words, (i + 5 * step) % {n}), {third}) AS host, i * {steps} + step AS n, {label} AS label "
                f"FROM (SELECT {words(values)} AS words) LATERAL VIEW posexplode(words) p AS i, word "
                f"LATERAL VIEW explode(sequence(1, {steps})) s AS step")

    return spark.sql(f"""
        SELECT concat(get(array('http://', 'https://'), n % 2), get(array('', 'www.', 'm.', 'blog.'), n % 4), host,
                      get(array('.example.com', '.example.org', '.example.net'), n % 3),
                      get(array('/', '/en/{{}}.html', '/de/{{}}', '/fr/{{}}/', '/es/{{}}#top'), n % 5)) AS url, label
        FROM ({hosts(BLOCKED, 1, 12)} UNION ALL {hosts(ALLOWED, 0, 6)}
              UNION ALL {hosts(SYLLABLES, 0, 4, "get(words, i % 4)")})""".replace("{}", "7")).distinct()


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, *_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def features(host: Column, path: Column) -> Column:
    """Buckets of all n-grams, repeats included."""
    def of(space: str, text: Column, n: int) -> Column:
        grams = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")),
                                     F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(grams, lambda g: F.pmod(F.xxhash64(F.lit(space), g),
                                                   F.lit(BUCKETS)).cast("int"))

    return F.concat(*[of(space, text, n) for space, text in (("host", host), ("path", path))
                      for n in GRAMS])


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def train(labelled: DataFrame, url: str = "url", label: str = "label", epochs: int = EPOCHS,
          rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """One row: weights, an array of BUCKETS numbers and the bias behind them."""
    rows = labelled.where(F.col(label).isNotNull()).select(
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        F.col(label).cast("double").alias("y"))
    n = rows.limit(MAX_LABELLED + 1).count()
    if n > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    if not n:
        return labelled.sparkSession.sql(f"SELECT array_repeat(0D, {BUCKETS + 1}) AS weights")
    table = rows.agg(F.sort_array(F.collect_list(F.struct("url", "y"))).alias("all"))
    table = stored(table.select(F.transform("all", lambda r, i: F.struct(
        i.alias("id"), r["y"].alias("y"), features(host_of(r["url"]), path_of(r["url"])).alias("f")))
        .alias("all")), "labelled-urls")
    cells = (table.select(F.inline("all")).select("id", F.size("f").alias("n"), F.explode("f").alias("b"))
             .groupBy("id", "b").agg((F.count(F.lit(1)) / F.sqrt(F.first("n"))).alias("v")))
    by_row = cells.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("x"))
    by_row = table.select(F.inline("all")).join(by_row, "id", "left").agg(F.sort_array(F.collect_list(
        F.struct("id", "y", F.coalesce("x", F.array().cast("array<struct<b:int,v:double>>"))
                 .alias("x")))).alias("rows"))
    by_bucket = cells.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("x"))
    by_bucket = labelled.sparkSession.range(BUCKETS).join(
        by_bucket, F.col("id") == F.col("b"), "left").agg(F.sort_array(F.collect_list(F.struct(
            "id", F.coalesce("x", F.array().cast("array<struct<id:int,v:double>>")).alias("x"))))
        .alias("columns"))
    # The two rows become one.
    arrays = stored(by_row.unionByName(by_bucket, allowMissingColumns=True).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("rows", "columns")]), "url-training")

    def step(w: Column, _: Column) -> Column:
        missed = F.transform("rows", lambda r: _sigmoid(F.get(w, F.lit(BUCKETS)) + F.aggregate(
            r["x"], F.lit(0.0), lambda a, c: a + F.get(w, c["b"]) * c["v"])) - r["y"])
        return let(missed, lambda m: F.concat(
            F.transform("columns", lambda c, j: F.get(w, j) - F.lit(rate) * (F.aggregate(
                c["x"], F.lit(0.0), lambda a, e: a + F.get(m, e["id"]) * e["v"]) / n
                + F.lit(decay) * F.get(w, j))),
            F.array(F.get(w, F.lit(BUCKETS)) - F.lit(rate) * F.aggregate(
                m, F.lit(0.0), lambda a, e: a + e) / n)))

    return stored(arrays.select(F.aggregate(
        F.sequence(F.lit(1), F.lit(epochs)), F.array_repeat(F.lit(0.0), BUCKETS + 1), step)
        .alias("weights")), "url-weights")


def _winning(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest rule that fits, as (rule, verdict), else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    result = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, on, start in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(start)
        result = F.when(fits, F.struct(F.lit(on + start).alias("rule"),
                                       F.lit(verdict).alias("verdict"))).otherwise(result)
    return result


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], weights: DataFrame,
          url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, score (probability to block) and verdict. A rule is
    (verdict, host, path)."""
    rows = without(pages, ["host", "path", "rule", "score", "verdict"])
    rows = once(rows, {"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    f, won, w, score = (fresh(rows, n) for n in ("f", "won", "w", "value"))
    rows = once(rows, {f: features(F.col("host"), F.col("path")),
                       won: _winning(rules, F.col("host"), F.col("path"))})
    # The last weight is the bias: it joins the sum as one more feature, not divided by the norm. The
    # subquery is used in one place only, so that its value is read there and not copied to each row.
    norm = 1 / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double"))
    every = F.concat(F.transform(f, lambda b: F.struct(b.alias("b"), norm.alias("v"))),
                     F.array(F.struct(F.lit(BUCKETS).alias("b"), F.lit(1.0).alias("v"))))
    rows = rows.withColumn(w, weights.select("weights").scalar())
    rows = rows.withColumn(score, F.aggregate(
        every, F.lit(0.0), lambda a, c: a + F.get(F.col(w), c["b"]) * c["v"], _sigmoid)).drop(w, f)
    rows = once(rows, {"score": F.col(score)}).drop(score)
    verdict = F.coalesce(F.col(won)["verdict"], F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return rows.select("*", F.col(won)["rule"].alias("rule"), verdict.alias("verdict")).drop(won)
