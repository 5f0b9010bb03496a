"""The classifier: held-out accuracy, scoring against the plain formula, edge cases."""

import zlib

import numpy as np
import pytest

from panel360.llm import quality_model as q
from panel360.llm.queries import op10_quality_classifier, table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small():
    good = [f"the cat number {i} sat on a mat and looked at bird {i}" for i in range(60)]
    bad = [f"ca$$$ num%%% {i}### sat&&& ***" for i in range(30)] + ["buy buy buy buy"] * 30
    return q.train(good + bad, [1] * 60 + [0] * 60)


def test_held_out_accuracy(spark):
    rows = op10_quality_classifier(spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").collect()
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 100 and {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == r.quality for r in unseen]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_scores_are_means_over_words(small):
    texts = ["the cat sat", "num%%% ###", "a a a b", "x" * 500, "", None]
    got = q.Scorer(small).score_all(texts * 2)
    for text, score in zip(texts * 2, got):
        words = (text or "").lower().split()
        words += [q._AGAIN] * sum(a == b for a, b in zip(words, words[1:]))
        values = [small.values[q.word_buckets([w])[0]].mean() for w in words]
        odds = small.bias + (np.mean(values) if values else 0.0)
        assert abs(score - 1 / (1 + np.exp(-odds))) < 1e-5
    assert got[0] > 0.5 > got[1]


def test_word_buckets_do_not_depend_on_neighbours():
    words = ["a", "straße", "😀", "ab" * 50]
    buckets, sizes = q.word_buckets(words)
    parts = np.split(buckets, np.cumsum(sizes)[:-1])
    for word, part in zip(words, parts):
        assert part.tolist() == q.word_buckets([word])[0].tolist()
        n = len(word) + 2
        assert len(part) == 1 + max(0, n - 2) + max(0, n - 3)


def test_training_reads_no_held_out_row(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] * 2 + [(None, 1), (3, 7), (4, None)],
                                   "doc_id long, quality int")
    sample = q.training_sample(docs, labels, "doc_id", "text", "quality")
    allowed = {f"t{i}" for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert sorted(t for t, _ in sample) == sorted(allowed)
    few = q.training_sample(docs, labels, "doc_id", "text", "quality", max_rows=20, max_bytes=30)
    assert 0 < len(few) <= 20 and sum(len(t) for t, _ in few) <= 30


def test_defined_results(spark, small):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "the cat " * 50000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    got = q.score(df, small).collect()
    bias = 1 / (1 + np.exp(-small.bias))
    assert len(got) == 4 and len(got[0]) == 4
    assert all(abs(r.score - bias) < 1e-9 for r in got if not r.text)
    assert q.score(df.limit(0), small).collect() == []
    untrained = q.train([], [])
    assert [r.score for r in q.score(df, untrained).collect()] == [0.5] * 4
    assert q.train(["a", "b"], [1, 1]).bias == 0.0


def test_long_text_is_passed_over(spark):
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    hashes = {r.id: r.h for r in spark.range(60).selectExpr("id", "xxhash64(id) h").collect()}
    by_id = min(kept, key=hashes.get)
    long = [f"{i} " * 2000 for i in range(100)]
    schema = "doc_id long, text string"
    found = spark.createDataFrame(list(enumerate(long)), schema).selectExpr("doc_id", "xxhash64(text) h")
    by_text = long[min(found.collect(), key=lambda r: r.h).doc_id]
    for at, body in ((by_id, long[0]), (kept[-1], by_text)):
        docs = spark.createDataFrame([(i, body if i == at else f"t{i}") for i in range(60)], schema)
        sample = q.training_sample(docs, labels, "doc_id", "text", "quality", max_bytes=1000)
        assert sorted(t for t, _ in sample) == sorted(f"t{i}" for i in kept if i != at)
        few = q.training_sample(docs, labels, "doc_id", "text", "quality", max_rows=9, max_bytes=1000)
        assert len(few) == 9 and body not in [t for t, _ in few]
        assert q.fit(docs, labels).values.any()


def test_texts_that_fit_fill_the_sample_round_by_round(spark):
    docs = spark.createDataFrame([(i, "x" * (1 + i % 50)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    hashes = {r.id: r.h for r in spark.range(600).selectExpr("id", "xxhash64(id) h").collect()}
    want, left = [], 150
    for i in sorted((i for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1), key=hashes.get):
        if len(want) < 20 and 1 + i % 50 <= left:
            want.append(("x" * (1 + i % 50), i % 2))
            left -= 1 + i % 50
    got = q.training_sample(docs, labels, "doc_id", "text", "quality", max_rows=20, max_bytes=150)
    assert sorted(got) == sorted(want)


def test_repeated_rows_train_once_and_lost_labels_are_told(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"t{i}") for i in range(40)] + [(ids[0], f"t{ids[0]}")] * 500 + [(ids[0], "other")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert len(q.training_sample(docs, labels, "doc_id", "text", "quality", max_rows=30)) == min(30, len(ids))
    with pytest.raises(ValueError, match="leave out a label"):
        q.training_sample(docs, labels, "doc_id", "text", "quality", max_bytes=1)
    with pytest.warns(UserWarning, match="0.5"):
        assert q.training_sample(docs.limit(0), labels, "doc_id", "text", "quality") == []


def test_bounds_of_the_sample():
    assert (q.MAX_ROWS, q.MAX_BYTES) == (4000, 32_000_000)
