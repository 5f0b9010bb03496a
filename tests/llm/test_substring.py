"""Substring dedup against a plain computation over all windows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from panel360.llm import substring
from panel360.llm.substring import Automaton

SCHEMA = "doc_id long, text string, lang string, KEPT string, n_words string"


def plain(rows, span):
    """For each row its words and the places that go."""
    words = [(text or "").encode().split() for _, text in rows]
    first = {}
    for (key, _), w in zip(rows, words):
        for i in range(len(w) - span + 1) if key is not None else ():
            run = tuple(w[i:i + span])
            first[run] = min(first.get(run, key), key)
    out = []
    for (key, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - span + 1) if key is not None
                and first[tuple(w[i:i + span])] < key for k in range(span)}
        out.append((len(w), sorted(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def check(spark, rows, span, gram):
    table = [(k, t, f"l{i}", "k", "n") for i, (k, t) in enumerate(rows)]
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    got = {r["lang"]: r for r in substring.dedup(docs, span=span, gram=gram).collect()}
    assert len(got) == len(rows)
    for i, (n, gone, kept) in enumerate(plain(rows, span)):
        r = got[f"l{i}"]
        places = [p for s in r["removed"] for p in range(s["start"], s["end"])]
        assert (r["n_words"], places, r["kept"]) == (n, gone, kept), (i, rows[i])
        assert r["doc_id"] == rows[i][0] and r["text"] == rows[i][1]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


def corpus(rng):
    vocabulary = ["a", "b", "é😀", "A", "c\x85d", "-"]
    passages = [rng.choices(vocabulary, k=rng.randint(8, 40)) for _ in range(6)]
    rows = [(None, None), (0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "a " * 300), (5, "a\x0b" * 200)]
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choices(vocabulary, k=rng.randint(0, 12))
            passage = rng.choice(passages)
            at = rng.randint(0, len(passage))
            words += passage[at:] if rng.random() < 0.5 else passage[:at]
        key = rng.choice([None, 7, *range(10, 70)])
        rows.append((key, rng.choice([" ", "\n", " \r\n"]).join(words)))
    return rows + [(k, t) for k, t in rows[10:20]] + [(90, rows[12][1]), (91, rows[12][1])]


@pytest.mark.parametrize("span,gram,seed", [(8, 3, 1), (8, 8, 2), (5, 1, 3)])
def test_against_all_windows(spark, span, gram, seed):
    check(spark, corpus(random.Random(seed)), span, gram)


def test_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_KEYS", 5)
    monkeypatch.setattr(substring, "BLOCK_KEYS", 4)
    check(spark, corpus(random.Random(5)), 8, 3)


def test_owner_without_the_window(spark, monkeypatch):
    """The smallest id shares a key but not the window, so the others meet in a later round; and keys
    that bring together windows that differ, round after round, lose none."""
    same = "p q r s t u v w"
    rows = [(1, "x1 x2 " + same[4:11] + " x3 x4 x5"), (2, "y1 " + same + " y2"), (3, "z1 " + same + " z2"),
            (4, same + " " + same)]
    check(spark, rows, 8, 2)
    rounds, inner = [], substring._round

    def weak(left, span, gram, seed):
        rounds.append(seed)
        return inner(left, span, span if seed > 2 else 1, 0)

    monkeypatch.setattr(substring, "_round", weak)
    check(spark, rows, 8, 2)
    check(spark, corpus(random.Random(6)), 8, 2)
    assert max(rounds) > 2


def test_several_automata_of_a_shard(monkeypatch):
    monkeypatch.setattr(substring, "AUTOMATON_WORDS", 9)
    rng = random.Random(11)
    texts = [" ".join(rng.choices("abc", k=rng.randint(4, 40))) for _ in range(4)]
    held = {tuple(t.split()[i:i + 4]) for t in texts for i in range(len(t.split()) - 3)}
    queries = [" ".join(rng.choices("abcd", k=30)) for _ in range(5)]
    rows = [(1, 0, 0, None, None, 0, t) for t in texts] + [
        (1, 0, 1, i, 5, 100, q) for i, q in enumerate(queries)]
    names = ["shard", "block", "kind", "id", "mark", "place", "body"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    run = substring._match(4, ["id", "mark", "place", "n", "body"])
    got = [r for b in run(iter([batch])) for r in b.to_pylist()]
    for i, query in enumerate(queries):
        words = query.split()
        match = [tuple(words[k:k + 4]) in held for k in range(27)]
        for r in (r for r in got if r["id"] == i):
            starts = range(r["place"] - 100, r["place"] - 100 + r["n"] - 3)
            assert all(match[k] == (r["body"] is None) for k in starts)
            if r["body"] is not None:
                assert r["body"].split() == words[starts[0]:starts[0] + r["n"]]
        assert sum(r["n"] - 3 for r in got if r["id"] == i) == 27


def test_long_text_and_its_copy(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["new"] * 60 + words[1000:350_000])), (3, "x" * 3_000_000)]
    docs = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.dedup(docs).collect()}
    assert got[1]["removed"] == [] and got[3]["kept"] == rows[2][1]
    assert [tuple(s) for s in got[2]["removed"]] == [(60, 349_060)]
    assert got[2]["kept"] == " ".join(["new"] * 60)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup(empty).collect() == []
    assert substring.dedup(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()[0][
        "kept"] == ""


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(200):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 12))] for _ in range(3)]
        held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        automaton = Automaton()
        for text in texts:
            automaton.add(text)
        query = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(15)]
        want = [max((n for n in range(i + 2) if tuple(query[i + 1 - n:i + 1]) in held), default=0)
                for i in range(len(query))]
        assert automaton.statistics(query) == want


def test_window_keys_across_blocks(monkeypatch):
    rng = random.Random(4)
    words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(500)]
    whole = substring.window_keys(words, 8, 3, substring._Values(0))
    monkeypatch.setattr(substring, "_powers", [t[:40] for t in substring._power_tables()])
    assert np.array_equal(substring.window_keys(words, 8, 3, substring._Values(0)), whole)
    assert len(substring.window_keys(words[:7], 8, 3, substring._Values(0))) == 0
