"""Counts and verdicts against a plain computation."""

import math
import random
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from panel360.llm import quality_rules as rules

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def pair_hash(a, b):
    seed = 42
    for value in (a, b):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", value), seed)
    return signed(seed)


def grams(text):
    single = [signed(xxhash.xxh64_intdigest(w.lower().encode(), 42)) for w in SPLIT.findall(text or "")]
    return [h % rules.BUCKETS for h in single + [pair_hash(a, b) for a, b in zip(single, single[1:])]]


def counts(text):
    words = SPLIT.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [s for s in (text or "").split("\n") if SPLIT.search(s)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in rules.SYMBOLS),
            len(lines) - len(set(lines)), len(covered))


def test_counts_and_verdicts(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "a", "a\x85b c", "x y z x y z", "a a a a", "l\nl\n l\n\n\nl\n", "#$%&|<>*",
             "é 😀\x0b\x0c\r", "a b c " * 400]
    texts += [" ".join(rng.choices(["the", "The", "an", "of", "x%", "z|", "\n"], k=rng.randint(0, 120)))
              for _ in range(60)]
    rows = [(i if i != 12 else None, t, f"w{i}", "k") for i, t in enumerate(texts)] + [(20, texts[20], "r", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, kept string")
    good = [*range(11, 40), 20, None]
    trusted = spark.createDataFrame([(i,) for i in good], "doc_id long")
    ratios = rules.log_ratios(docs, trusted)
    held = ratios.first()[0]
    raw, trust = Counter(), Counter()
    for key, text, *_ in rows:
        raw.update(grams(text))
        if key is not None and key in good:
            trust.update(grams(text))
    extra = rules.SMOOTHING * rules.BUCKETS
    for b in set(raw) | {0}:
        want = math.log((trust[b] + 1) / (sum(trust.values()) + extra)) - math.log(
            (raw[b] + 1) / (sum(raw.values()) + extra))
        assert abs(held[b] - want) < 1e-9
    got = rules.judge(docs, ratios, threshold=0.0).collect()
    assert len(got) == len(rows)
    for r in got:
        n = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r.text
        found = grams(r.text)
        mean = sum(held[g] for g in found) / max(1, len(found))
        assert abs(r.llr - mean) < 1e-9
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed and r.llr >= 0) and r.words.startswith(("w", "r"))
    filtered = rules.judge(docs, ratios, threshold=0.0).where("kept").count()
    assert filtered == sum(r.kept for r in got)


def test_long_text(spark):
    rng = random.Random(3)
    vocabulary = [f"W{i}" for i in range(300)]
    long = "\n".join(" ".join(rng.choices(vocabulary, k=9)) for _ in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "A a " * 200_000), (3, "x" * 3_000_000)],
                                 "doc_id long, text string")
    ratios = rules.log_ratios(docs, docs.limit(1).select("doc_id"))
    for r in rules.judge(docs, ratios).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text)


def test_windows_of_equal_hash_are_told_apart(spark):
    """Though all windows have one hash, only those whose words repeat count."""
    rng = random.Random(6)
    for _ in range(20):
        words = rng.choices("aAbc", k=rng.randint(3, 40))
        df = spark.createDataFrame([(words,)], "words array<string>")
        windows = F.transform(F.slice("words", F.lit(1), F.lit(len(words) - 2)), lambda w: F.lit(7).cast("long"))
        got = df.select(rules.repeated_words(F.col("words"), windows)).first()[0]
        assert got == counts(" ".join(words))[-1]


def test_rows_with_null_id_spread_over_tasks(spark):
    docs = spark.createDataFrame([(None, f"a{i}") for i in range(400)] + [(1, "b")], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = rules.log_ratios(docs, trusted).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert held == rules.log_ratios(docs, trusted).first()[0]
    assert held[grams("b")[0]] > held[grams("a1")[0]]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    ratios = rules.log_ratios(empty, empty)
    assert set(ratios.first()[0]) == {0.0}
    assert rules.judge(empty, ratios).collect() == []
