"""Scans against exact containment over every stretch."""

import math
import random

from panel360.llm import licenses
from panel360.llm.decontaminate import Words


def brute(text, templates=licenses.TEMPLATES):
    """{(license, template length): shingle share} over all stretches."""
    def split(t):
        laid = Words([t.encode()])
        return [laid.run(i, 1) for i in range(len(laid.start))]
    words, found = split(text), {}
    for name, template in templates:
        t = split(template)
        n = min(5, len(t))
        if not n:
            continue
        wanted = {tuple(t[i:i + n]) for i in range(len(t) - n + 1)}
        length, best = math.ceil(1.5 * len(t)), 0
        for a in range(max(1, len(words) - length + 1)):
            part = words[a:a + length]
            best = max(best, len(wanted & {tuple(part[i:i + n]) for i in range(len(part) - n + 1)}))
        if best >= math.ceil(0.8 * len(wanted)):
            found[name, best / len(wanted)] = found.get((name, best / len(wanted)), 0) + 1
    return found


def texts():
    rng = random.Random(12)
    out = ["", "nothing here", "Released under the MIT License", "released UNDER the mit license now"]
    for _, template in licenses.TEMPLATES:
        words = template.split()
        for dropped in (0, 0.03, 0.06, 0.15):
            changed = [rng.choice(["x", w + " extra"]) if rng.random() < dropped else w for w in words]
            noise = [rng.choice(["lorem", "ipsum", "the", "software"]) for _ in range(rng.randint(0, 200))]
            out.append(" ".join(noise + changed + noise[:7]))
    return out


def test_scanner_finds_every_contained_template():
    scanner, found = licenses.Scanner(licenses.TEMPLATES), 0
    for text in texts():
        got = {}
        for f in scanner.scan([text.encode()])[0]:
            got[f["license"], f["containment"]] = got.get((f["license"], f["containment"]), 0) + 1
        assert got == brute(text), text
        found += len(got)
    assert found > 25


def test_band_settings():
    for n, held in licenses.Scanner(licenses.TEMPLATES).classes.items():
        shingles = n - held["size"] + 1
        low = 0.8 * shingles / (held["window"] - held["size"] + 1 + 0.2 * shingles)
        rows = held["rows"]
        assert 1 - (1 - low ** rows) ** (licenses.HASHES // rows) >= licenses.CHANCE


def test_table(spark):
    line = "Licensed under the Apache License, Version 2.0."
    rows = [(1, None, "x"), (2, "", "x"), (3, line, "x"), (3, line, "x"), (4, "pad " * 100000 + line, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Licenses string")
    got = sorted((r.doc_id, [(f.license, f.start) for f in r.licenses])
                 for r in licenses.scan_licenses(df).collect())
    assert got == [(1, []), (2, []), (3, [("Apache-2.0", 0)]), (3, [("Apache-2.0", 0)]),
                   (4, [("Apache-2.0", 100000)])]
    assert licenses.scan_licenses(df.limit(0)).collect() == []
    twice = licenses.scan_licenses(df, templates=(("A", line), ("B", line), ("C", "")))
    assert [f.license for f in twice.where("doc_id = 3").first().licenses] == ["A", "B"]


def test_each_time_a_notice_occurs():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES:
        n = len(Words([template.encode()]).start)
        for times in (2, 3, 7):
            for gap in ("", "lorem ipsum " * 3, "and more text " * 200):
                step = n + len(gap.split())
                got = [(f["start"], f["end"]) for f in scanner.scan([f"{template} {gap}".encode() * times])[0]
                       if f["license"] == name and f["end"] - f["start"] == n]
                assert got == [(i * step, i * step + n) for i in range(times)], (name, times, gap)


def test_damaged_notice_beside_a_whole_one():
    words = licenses.TEMPLATES[1][1].split()
    damaged = [*words[:12], "x", *words[12:]]
    scanner = licenses.Scanner(licenses.TEMPLATES[1:2])
    got = scanner.scan([" ".join([*damaged, *words, *damaged]).encode()])[0]
    n = len(Words([" ".join(words).encode()]).start)
    assert [(f["start"], f["end"]) for f in got] == [(0, n + 1), (n + 1, 2 * n + 1), (2 * n + 1, 3 * n + 2)]
    assert got[0]["containment"] < 1 == got[1]["containment"]


def test_a_notice_very_many_times():
    line = licenses.TEMPLATES[0][1]
    assert len(licenses.Scanner(licenses.TEMPLATES).scan([f"{line} ".encode() * 2000])[0]) == 2000


def test_reserved_rights():
    got = licenses.Scanner(licenses.TEMPLATES).scan([b"A text.\nAll Rights Reserved.", b"all rights are reserved"])
    assert [[(f["license"], f["start"], f["end"]) for f in found] for found in got] == [
        [("LicenseRef-All-Rights-Reserved", 2, 5)], []]
