"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

A template is found in a text if some stretch of at most `STRETCH` times its words holds at least
`CONTAINMENT` of its different shingles of five words (a shorter template is one shingle). Windows of
stretch plus stride words, a stride apart, cover every stretch whole, which bounds from below the
Jaccard similarity of such a window and the template. For each template length the bands have
the most rows with which that similarity collides with probability `CHANCE` or more. Collisions
are candidates; containment is then counted on the shingles themselves, so nothing is reported that
does not hold. A window without any template's shingle cannot collide and gets no signature.
A notice that a text holds several times is returned each time.

Templates are written by the caller and checked against `MAX_TEMPLATES`; texts are scanned row by
row, without a shuffle.

Defined results: null and empty texts have no words and no licenses; templates without words match
nothing; equal templates under two names are both reported; repeated rows are each returned; an empty
table gives no rows. Other columns are kept, columns of the added names replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panel360.functions.arrow import map_arrow
from panel360.llm.common import slices, without
from panel360.llm.decontaminate import Words

SHINGLE, CONTAINMENT, STRETCH = 5, 0.8, 1.5
HASHES, CHANCE, MAX_TEMPLATES = 128, 0.9999, 1000
_COST = 1 << 32
#: Notices as published with the licenses, under their SPDX identifiers. The last is a
#: notice that grants no license; it has no such identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, "
            "merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain "
                   "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the "
                "terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."))


class Template:
    def __init__(self, name: str, text: str):
        words = Words([text.encode()])
        self.name, self.n_words = name, len(words.start)
        self.size = min(SHINGLE, self.n_words)  # words of a shingle
        runs = range(self.n_words - self.size + 1) if self.n_words else ()
        self.shingles = {words.run(i, self.size) for i in runs}
        self.stretch = math.ceil(STRETCH * self.n_words)
        self.needed = math.ceil(CONTAINMENT * len(self.shingles))
        self.hashes = np.unique(words.grams(self.size)[0]) if self.n_words else np.empty(0, np.uint64)

    def stretches(self, places: list[tuple[int, bytes]]) -> list[tuple[int, int, int]]:
        """The stretches without common words that hold the most different shingles together, each
        counted for itself (of equals the fewest, then the first): their number, and the places of
        the first word and behind the last. `places`: its shingles in a text, in order."""
        at = np.array([p for p, _ in places], np.int64)
        before = (at + self.size).searchsorted(at, side="right")  # places whose words end before this
        lowest = at.searchsorted(at + self.size - self.stretch)
        held, last = np.zeros(len(at), np.int64), {}  # different shingles from each place till now
        most, taken = np.zeros(len(at) + 1, np.int64), [None] * (len(at) + 1)
        for j, (_, shingle) in enumerate(places):
            most[j + 1], low = most[j], lowest[j]
            held[max(low, last.get(shingle, -1) + 1):j + 1] += 1
            last[shingle] = j
            inside = held[low:j + 1]
            if inside[0] >= self.needed:
                # A stretch costs less than one shingle, so that fewer stretches win among equals.
                total = np.where(inside >= self.needed,
                                 most[before[low:j + 1]] + inside * _COST - 1, -1)
                best = int(total.argmax())
                if total[best] > most[j]:
                    most[j + 1], taken[j + 1] = total[best], (low + best, int(inside[best]))
        found, j = [], len(at)
        while j:
            if taken[j] is None:
                j -= 1
            else:
                first, number = taken[j]
                found.append((number, int(at[first]), int(at[j - 1]) + self.size))
                j = int(before[first])
        return found[::-1]


class Scanner:
    """Templates by length, their band settings and band keys."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        rng = np.random.default_rng(11)
        self.factor = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
        self.templates = [t for t in (Template(*t) for t in templates) if t.n_words]
        self.classes: dict[int, dict] = {}
        for i, t in enumerate(self.templates):
            held = self.classes.setdefault(t.n_words, {
                "size": t.size, "stride": max(1, t.n_words // 2), "keys": {}, "members": []})
            held["members"].append(i)
        for n, held in self.classes.items():
            held["window"] = self.templates[held["members"][0]].stretch + held["stride"]
            held["rows"] = min(self._rows(len(self.templates[i].shingles), held)
                               for i in held["members"])
            for i in held["members"]:
                for key in self._keys(self.templates[i].hashes, held["rows"]):
                    held["keys"].setdefault(key, []).append(i)
        self.all = {s: np.unique(np.concatenate([t.hashes for t in self.templates if t.size == s]))
                    for s in {t.size for t in self.templates}}

    @staticmethod
    def _rows(shingles: int, held: dict) -> int:
        most = held["window"] - held["size"] + 1 + (1 - CONTAINMENT) * shingles
        jaccard = CONTAINMENT * shingles / most
        return max((r for r in (1, 2, 4, 8) if 1 - (1 - jaccard ** r) ** (HASHES // r) >= CHANCE),
                   default=1)

    def _keys(self, hashes: np.ndarray, rows: int) -> Iterator[tuple[int, bytes]]:
        """Band keys of a set of shingles."""
        signature = (hashes[:, None] * self.factor + self.shift).min(axis=0)
        for band in range(HASHES // rows):
            yield band, signature[band * rows:(band + 1) * rows].tobytes()

    def scan(self, texts: list[bytes]) -> list[list[dict]]:
        """For each text the templates found: license, containment, start and end (word places)."""
        words, out = Words(texts), [[] for _ in texts]
        first = np.cumsum(words.count) - words.count
        for size, wanted in self.all.items():
            value, whole = words.grams(size)
            at = np.minimum(wanted.searchsorted(value), len(wanted) - 1)
            hits = np.flatnonzero(whole & (wanted[at] == value)) if len(value) else np.empty(0, int)
            for text, places in _grouped(words.text, hits):
                low, n = int(first[text]), int(words.count[text])
                found: set[int] = set()
                for held in (h for h in self.classes.values() if h["size"] == size):
                    found |= self._candidates(held, value[low:low + n - size + 1], places - low)
                named = [(p - low, words.run(p, size)) for p in places.tolist()]
                for i in sorted(found):
                    t = self.templates[i]
                    for number, start, end in t.stretches([x for x in named if x[1] in t.shingles]):
                        out[text].append({"license": t.name, "start": start, "end": end,
                                          "containment": number / len(t.shingles)})
        for found in out:
            found.sort(key=lambda f: (f["start"], f["license"], f["end"]))
        return out

    def _candidates(self, held: dict, value: np.ndarray, hits: np.ndarray) -> set[int]:
        """Templates that share a band with a window around a hit."""
        width, stride, found = held["window"] - held["size"] + 1, held["stride"], set()
        last = max(0, -(-(len(value) - width) // stride))
        windows = {w for h in hits.tolist()
                   for w in range(max(0, -(-(h - width + 1) // stride)), min(last, h // stride) + 1)}
        for w in windows:
            for key in self._keys(np.unique(value[w * stride:w * stride + width]), held["rows"]):
                found.update(held["keys"].get(key, ()))
        return found


def _grouped(texts: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(hits):
        edges = np.flatnonzero(np.diff(texts[hits])) + 1
        for places in np.split(hits, edges):
            yield int(texts[places[0]]), places


def scan_licenses(docs: DataFrame, text: str = "text",
                  templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """`docs` with licenses: (license, containment, start, end) of each template found."""
    rows = without(docs, ["licenses"])
    found = T.ArrayType(T.StructType([
        T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema, at = T.StructType([*rows.schema.fields, T.StructField("licenses", found)]), \
        rows.columns.index(text)
    arrow = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()),
                                ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for whole in batches:
            for batch in slices(whole, at):
                made = scanner.scan([(t or "").encode() for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], schema.names)

    return map_arrow(rows, run, schema)
