"""Name lookup against a comparison with everybody."""

from __future__ import annotations

import random
import re

from panel360.operators import names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(text):
    return list(dict.fromkeys(re.findall(r"[^\W_]+", (text or "").lower())))


def penalty(asked, word):
    if word.startswith(asked):
        return int(asked != word)
    allowed = 2 if len(asked) >= 8 else 1 if len(asked) >= 4 else 0
    far = edits(asked, word)
    return far + 1 if far <= allowed else None


def plain(people, phrases, k):
    out = []
    held = {}
    for key, name in people:
        if name is not None:
            held[key] = (min(held[key][0], name), held[key][1] + words(name)) if key in held else (name, words(name))
    for qid, phrase in phrases:
        found = []
        for key, (name, own) in held.items():
            hits = [min(p) for w in words(phrase) if (p := [x for t in own if (x := penalty(w, t)) is not None])]
            if hits:
                found.append((len(hits), sum(hits), edits(phrase.lower(), name.lower()), key, name))
        top = max((f[0] for f in found), default=0)
        best = sorted((f[1:] for f in found if f[0] == top))[:k]
        out += [(qid, key, name, top, p, d, n + 1) for n, (p, d, key, name) in enumerate(best)]
    return sorted(out)


def check(spark, tmp_path, people, phrases, k=3):
    path = str(tmp_path / f"names-{len(people)}-{len(phrases)}")
    names.write_names(spark.createDataFrame(people, "patient_id string, full_name string"), path)
    asked = spark.createDataFrame(phrases, "qid string, phrase string")
    got = [tuple(r) for r in names.find_names(spark, path, asked, k).collect()]
    assert sorted(got) == plain(people, phrases, k)
    return got


def test_partial_and_misspelt(spark, tmp_path):
    people = [("P1", "Ann Smith"), ("P2", "Anna Smithson"), ("P3", "Bo Müller"), ("P4", "Smilla Jensen"),
              ("P5", None), ("P6", ""), ("P7", "Christopher O'Neil")]
    phrases = [("prefix", "Smi"), ("umlaut", "Mller"), ("wrong", "Smeth ann"), ("two", "Cristophar"),
               ("short", "Xo"), ("nobody", "zzzzz"), ("null", None), ("empty", " - "), ("initial", "b")]
    got = check(spark, tmp_path, people, phrases)
    first = {r[0]: r[1] for r in got if r[-1] == 1}
    assert first == {"prefix": "P1", "umlaut": "P3", "wrong": "P1", "two": "P7", "initial": "P3"}


def test_against_everybody(spark, tmp_path):
    rng = random.Random(3)
    syllables = ["an", "na", "mar", "ia", "lo", "pez", "é", "son", "ber", "000", "12"]

    def word():
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    people = [(f"P{rng.randint(0, 150)}", f"Common {word()} {word()}") for _ in range(160)]
    phrases = []
    for i in range(60):
        name = list(rng.choice(people)[1])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(name))
            name[at:at + 1] = rng.choice([[], ["x"], [name[at], "a"]])
            name = name or ["q"]
        phrases.append((f"q{i}", "".join(name)[:rng.choice([4, 9, 40])]))
    check(spark, tmp_path, people, phrases)


def test_a_word_that_all_bear_is_not_looked_up(spark, tmp_path, monkeypatch):
    people = [(f"P{i:04d}", f"Customer Nr{i * 7919 % 10**6:06d}") for i in range(300)]
    counts, inner = {}, names.stored

    def seen(df, name):
        out = inner(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(names, "stored", seen)
    got = check(spark, tmp_path, people, [("q", "custoner nr974037")], k=1)
    assert got[0][1] == "P0123" and counts["compared"] < 60


def test_empty_tables(spark, tmp_path):
    check(spark, tmp_path, [], [("q", "ann")])
    check(spark, tmp_path, [("P1", "ann")], [])


def test_numbers_in_sequence_bring_few_candidates(spark, tmp_path):
    """Words of the same few signs: rests in common grow with an asked word's neighbours, not with the table."""
    people = [(f"P{i:05d}", f"{i:09d}") for i in range(3000)]
    path = str(tmp_path / "names")
    names.write_names(spark.createDataFrame(people, "patient_id string, full_name string"), path)
    asked = spark.createDataFrame([("0000012x4",)], "asked string")
    rests = names._rests(asked, "asked", names.F.lit(2))
    met = spark.read.parquet(f"{path}/rests").join(rests, "rest").select("word").distinct().count()
    assert 100 < met < 1000
    assert sorted((r.word, r.penalty) for r in names.word_matches(spark, path, asked).collect()) == sorted(
        (w, p) for _, w in people if (p := penalty("0000012x4", w)) is not None)


def test_long_words_are_found_by_trigrams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(names, "LONG", 9)
    people = [(f"P{i}", w) for i, w in enumerate((
        "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl", "xabcdefghijklm", "abcd"))]
    check(spark, tmp_path, people, [("s", "abcdxfghi"), ("l", "abcdxfghijk"), ("m", "abcdefghiy"), ("t", "abxd")], k=7)
