"""License scan: MinHash bands over overlapping windows, then exact containment.

Texts are lower-cased words of letters and digits; shingles are five words (a template with fewer words is one shingle of them all).
Templates fall into classes by length.  A class has a stride S no shorter than what its templates may span and windows of
two strides, so any place of a template lies whole in one window.  A window of 2S shingles
that holds 0.8 of a template of m has a Jaccard similarity of at least 0.8m/(2S+0.2m); bands of one hash each
are as many as make the chance to miss it at most MISS.  Windows that share a band with a template are
verified: some run of at most 1/0.8 of the template's length must hold 0.8 or more of its distinct shingles.

Minima are kept per stride and joined in pairs, so overlapping windows cost nothing extra.
All text is scanned; memory follows a chunk of about 1 MB (or the one longest text).

Defined cases: null or empty text has no license; repeated rows are scanned each; a text with several licenses or wordings has a row
for each template, of equal ones (ties) each too; extra columns are ignored; a very long text is one chunk of its own; an empty table
gives no rows; a template without words is an error."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import as_bytes, per_table, small_batches
from locusweave.llm.words import chunks, mix, window_hashes, word_hashes

WIDTH = 5
CONTAINMENT = 0.8
MISS = 1e-4

# License notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation"
    ),
    "AGPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "SPDX-tag": "SPDX-License-Identifier:",
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
}

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def _words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all docs, number per doc)."""
    h, _, count = word_hashes([d.translate(_PLAIN) for d in docs])
    return h, count


def _shingles(h: np.ndarray, count: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all docs, number per doc) from their words."""
    every = window_hashes(h, width)
    keep = np.ones(len(h), bool)
    ends = np.cumsum(count)
    for e, n in zip(ends.tolist(), count.tolist()):
        keep[max(e - n, e - width + 1) : e] = False
    return every[keep[: len(every)]], np.maximum(count - width + 1, 0)


def densest(place: np.ndarray, which: np.ndarray, span: int) -> tuple[int, int]:
    """(most distinct values of which within a run of span places, the place where the first such run begins); places rise."""
    best, at, low = 0, 0, 0
    held: dict[int, int] = {}
    for high, (p, w) in enumerate(zip(place.tolist(), which.tolist())):
        held[w] = held.get(w, 0) + 1
        while place[low] <= p - span:
            gone = int(which[low])
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            low += 1
        if len(held) > best:
            best, at = len(held), int(place[low])
    return best, at


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.sets: list[np.ndarray] = []
        self.span: list[int] = []  # shingles that a place of the template may take
        self.short: dict[int, list[int]] = {}  # templates with fewer words than a shingle, by their number
        self.classes: dict[int, list[int]] = {}
        for i, name in enumerate(self.names):
            h, count = _words([templates[name].encode()])
            if not len(h):
                raise ValueError(f"template {name!r} has no words")
            width = min(WIDTH, len(h))
            found = _shingles(h, count, width)[0]
            self.sets.append(np.unique(found))
            self.span.append(math.ceil(len(found) / CONTAINMENT))
            if width < WIDTH:
                self.short.setdefault(width, []).append(i)
            else:
                self.classes.setdefault(8 * 4 ** max(0, math.ceil(math.log(self.span[i] / 8, 4))), []).append(i)
        self.bands = {}
        for stride, some in self.classes.items():
            least = min(CONTAINMENT * len(self.sets[i]) / (2 * stride + (1 - CONTAINMENT) * len(self.sets[i])) for i in some)
            self.bands[stride] = math.ceil(math.log(MISS) / math.log(1 - least))

    @staticmethod
    def _salt(band: int) -> np.uint64:
        return mix(np.array([band], np.uint64), 5)[0] | np.uint64(1)

    def scan(self, docs: list[bytes]) -> list[tuple[int, int, int, int, float]]:
        """(doc, template, first shingle, windows, containment) of each document and template found."""
        found: dict[tuple[int, int], list] = {}
        for first, some in chunks(docs):
            h, words = _words(some)
            for width, members in self.short.items():
                sh, count = _shingles(h, words, width)
                ends = np.cumsum(count)
                for i in members:
                    at = np.flatnonzero(sh == self.sets[i][0])
                    doc = np.searchsorted(ends, at, "right")
                    for d, p in zip(doc.tolist(), (at - (ends - count)[doc]).tolist()):
                        found.setdefault((first + d, i), [p, 0, 1.0])[1] += 1
            sh, count = _shingles(h, words)
            ends = np.cumsum(count)
            for stride, members in self.classes.items():
                blocks = -(-count // stride)
                block_end = np.cumsum(blocks)
                if not block_end[-1]:
                    continue
                doc = np.repeat(np.arange(len(some)), blocks)
                at = (ends - count)[doc] + (np.arange(block_end[-1]) - (block_end - blocks)[doc]) * stride
                lone = np.append(doc[1:] != doc[:-1], True)
                hit: set[tuple[int, int]] = set()
                for band in range(self.bands[stride]):
                    salt = self._salt(band)
                    least = np.minimum.reduceat(sh * salt, at)
                    pair = np.where(lone, least, np.minimum(least, np.append(least[1:], 0)))
                    for i in members:
                        for b in np.flatnonzero(pair == (self.sets[i] * salt).min()):
                            hit.add((int(b), i))
                for b, i in sorted(hit):
                    stop = min(int(at[b]) + 2 * stride, int(ends[doc[b]]))
                    window = sh[at[b] : stop]
                    which = np.minimum(np.searchsorted(self.sets[i], window), len(self.sets[i]) - 1)
                    place = np.flatnonzero(self.sets[i][which] == window)
                    most, begin = densest(place, which[place], self.span[i])
                    if most >= CONTAINMENT * len(self.sets[i]) - 1e-9:
                        where, held = int(at[b] + begin - (ends - count)[doc[b]]), most / len(self.sets[i])
                        row = found.setdefault((first + int(doc[b]), i), [where, 0, 0.0])
                        row[0], row[1], row[2] = min(row[0], where), row[1] + 1, max(row[2], held)
        return [(d, i, *row) for (d, i), row in sorted(found.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license found: id_col, license, first_word, n_windows, containment."""
    kind = dict(docs.dtypes)[id_col]
    scanner = Scanner(templates)

    def run(table: pa.Table) -> pa.Table:
        rows = scanner.scan(as_bytes(table["_text"]))
        return pa.table({
            id_col: table["_id"].take(pa.array([r[0] for r in rows], pa.int64())), "license": pa.array([scanner.names[r[1]] for r in rows], pa.string()),
            "first_word": pa.array([r[2] for r in rows], pa.int64()), "n_windows": pa.array([r[3] for r in rows], pa.int64()),
            "containment": pa.array([r[4] for r in rows], pa.float64()),
        })

    return small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        per_table(run), f"`{id_col}` {kind}, license string, first_word bigint, n_windows bigint, containment double"
    )
