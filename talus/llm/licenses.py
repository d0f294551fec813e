"""License scan: winnowed fingerprints in an inverted index, then local alignment.

A text's words are lower-cased runs of letters and digits. Of every ``WINDOW`` consecutive ``GRAM``-word hashes of a template the least is kept
(winnowing), with its place. The kept ones form an inverted index, which is a fixed set of templates and so a broadcast of bounded size. Hashes of
a text that are in the index vote for a template. A local alignment (match 2, any other word -1) of the whole template with the text around
its votes gives the matched words, and with them coverage (matched words of the template / its words) and span. It is banded: only places of the
template and the text that are within twice the template's words of a vote's diagonal are compared. An alignment with a score above 0 leaves out fewer words than that, so
none that holds a vote is lost, and it goes over whatever is put in or left out, as long as what matches on either side is worth more. All hashes of the text are looked up, so any
shared run of GRAM + WINDOW - 1 words of a template is found.

Cases: null and empty texts report nothing; a text that holds several copies of a template reports each; a template inside a longer one (of equal span) is
left out unless it covers more; repeated rows give repeated results; null ids are carried; texts of any length are scanned whole; templates
of fewer than GRAM words are looked up by all of their words; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from talus.llm._store import small_batches
from talus.llm._text import PUNCT, Words, buffers, grams, slices

GRAM, WINDOW = 3, 2

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
    "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
    "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_APACHE_HEADER = (
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
    'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
    "governing permissions and limitations under the License."
)
_GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission."
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at https://mozilla.org/MPL/2.0/."
)
_UNLICENSE = "This is free and unencumbered software released into the public domain."
#: Public licence texts and notices, by name.
TEMPLATES: dict[str, str] = {
    "MIT": _MIT_GRANT,
    "MIT-notice": "Released under the MIT License.",
    "ISC": _ISC_GRANT,
    "BSD-2-Clause": _BSD_TERMS,
    "Apache-2.0": _APACHE_HEADER,
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": _GPL_HEADER,
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Unlicense": _UNLICENSE,
    "BSD-3-Clause": _BSD_TERMS + _BSD_NAMES,
    "MPL-2.0": _MPL_HEADER,
    "LGPL-3.0": _GPL_HEADER.replace("GNU General", "GNU Lesser General"),
    "AGPL-3.0": _GPL_HEADER.replace("GNU General", "GNU Affero General"),
}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window, the rightmost of equal ones."""
    if len(hashes) <= window:
        return np.array([int(np.flatnonzero(hashes == hashes.min())[-1])]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


class Index:
    """Fingerprints of the templates, sorted by hash."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        data, offsets = buffers(pa.array(list(templates.values()), pa.string()))
        w = Words(data, offsets, PUNCT)
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(self.names))]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, x in enumerate(self.words):
            k = min(GRAM, len(x))
            g = grams(x, k) if k else x
            found.setdefault(k, []).extend((int(g[p]), i, p) for p in winnow(g, WINDOW).tolist())
        #: By the length of the run: hashes in order, and their templates and places.
        self.tables = {k: (np.array([f[0] for f in rows], np.uint64), np.array([f[1:] for f in rows], np.int64)) for k, rows in ((k, sorted(v)) for k, v in found.items() if k and v)}


def band(n: int, m: int, diagonals: np.ndarray) -> np.ndarray:
    """By diagonal (place in a text of n words less place in a template of m, plus m): whether it is less than 2 m from one of ``diagonals``."""
    step = np.zeros(n + m + 2, np.int64)
    np.add.at(step, np.clip(diagonals + m - 2 * m + 1, 0, n + m + 1), 1)
    np.add.at(step, np.clip(diagonals + m + 2 * m, 0, n + m + 1), -1)
    return np.cumsum(step) > 0


def align(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local alignment (match 2, else -1) of the template with the text in the band of the diagonals: for each end in ``text`` the best score, its
    matched words and its first word."""
    n, m_ = len(text), len(template)
    inside = band(n, m_, diagonals)
    at = np.arange(n)
    score, matched, first = np.zeros(n, np.int64), np.zeros(n, np.int64), at.copy()
    best = score.copy(), matched.copy(), first.copy()
    for q, x in enumerate(template):
        same = text == x
        s, m, f = (np.concatenate([z[:1] * 0, z[:-1]]) for z in (score, matched, first))
        fresh = s <= 0
        s, m, f = np.where(same, s + 2, s - 1), m + same, np.where(fresh, at, f)
        m[fresh] = same[fresh]
        up = score - 1 > s
        s, m, f = np.where(up, score - 1, s), np.where(up, matched, m), np.where(up, first, f)
        # words of the text left out: the best of all places before, less one for each word between
        ahead = s + at
        top = np.maximum.accumulate(ahead)
        new = np.concatenate([np.ones(1, bool), ahead[1:] > top[:-1]])
        source = np.maximum.accumulate(np.where(new, at, 0))
        source = np.where(ahead == top, at, source)
        near = inside[m_ - q : m_ - q + n]
        score, matched, first = np.where(near, np.maximum(top - at, 0), 0), np.where(near, m[source], 0), np.where(near, f[source], at)
        better = score > best[0]
        for b, z in zip(best, (score, matched, first), strict=True):
            b[better] = z[better]
    return best


class Spans:
    """Spans of one template in one text, none over another, by their start."""

    def __init__(self):
        self.starts, self.ends = [], []

    def overlap(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def cover(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] >= b

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def copies(template: np.ndarray, text: np.ndarray, votes: np.ndarray, places: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(matched words, first word, end) of each copy of the template in ``text``; ``votes`` and ``places``: where shared fingerprints are in the text and in the template."""
    reach, need = 3 * len(template), max(1, least * len(template))  # a score above 0 spans at most three times the matched words
    known = np.isin(text, template)
    cut = np.flatnonzero(np.diff(votes) > 2 * reach) + 1
    todo = [(max(0, int(v[0]) - reach), min(len(text), int(v[-1]) + reach)) for v in np.split(votes, cut)]
    found = []
    while todo:
        a, b = todo.pop()
        i, j = np.searchsorted(votes, [a, b])
        count = np.concatenate([[0], np.cumsum(known[a:b])])
        if i == j or (count[reach:] - count[: len(count) - reach] if len(count) > reach else count[-1:]).max() < need:
            continue
        score, m, first = align(template, text[a:b], np.unique(votes[i:j] - places[i:j]) - a)
        ends = np.flatnonzero((m >= need) & (score > 0))
        spans = Spans()
        for e in ends[np.lexsort((ends, -score[ends]))].tolist():
            if not spans.overlap(int(first[e]), e + 1):
                spans.add(int(first[e]), e + 1)
                found.append((int(m[e]), a + int(first[e]), a + e + 1))
        if spans.starts:  # what lies between may hold copies whose best alignment ran into another one
            todo += [(a + x, a + y) for x, y in zip([0, *spans.ends], [*spans.starts, b - a], strict=True) if y - x >= need]
    return found


def scan(index: Index, words: np.ndarray, text: np.ndarray, first: np.ndarray, least: float) -> list[tuple[int, int, int, int, int]]:
    """(text, template, matched words, first word, end) of every match with coverage of ``least`` or more."""
    votes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, (hashes, template) in index.tables.items():
        g = grams(words, k)
        lo, hi = np.searchsorted(hashes, g, "left"), np.searchsorted(hashes, g, "right")
        at = np.flatnonzero((hi > lo) & (text[: len(g)] == text[k - 1 :]))
        for p in at.tolist():
            for name, place in template[lo[p] : hi[p]].tolist():
                votes.setdefault((int(text[p]), name), []).append((p, place))
    found = []
    for (doc, name), pairs in votes.items():
        a, b = int(first[doc]), int(first[doc + 1])
        at, places = np.array(pairs).T
        found += [(doc, name, m, a + x, a + y) for m, x, y in copies(index.words[name], words[a:b], at - a, places, least)]
    found.sort(key=lambda f: (f[0], -f[2], f[3], f[1]))
    kept: list[tuple[int, int, int, int, int]] = []
    spans: dict[int, Spans] = {}
    for k, f in enumerate(found):
        if k and found[k - 1][0] != f[0]:
            spans = {}
        own = spans.setdefault(f[1], Spans())
        if not own.overlap(f[3], f[4]) and not any(o.cover(f[3], f[4]) for o in spans.values()):
            own.add(f[3], f[4])
            kept.append(f)
    return sorted(kept)


def _scan(index: Index, least: float):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for lo, hi in slices(offsets):
                w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], PUNCT)
                rows = scan(index, w.hash, w.text, w.first, least)
                base = offsets[lo : hi + 1] - offsets[lo]
                yield pa.record_batch(
                    [
                        pa.array([ids[lo + r[0]] for r in rows], pa.int64()),
                        pa.array([index.names[r[1]] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[2] / len(index.words[r[1]]) for r in rows], pa.float64()),
                        pa.array([int(w.start[r[3]] - base[r[0]]) for r in rows], pa.int64()),
                        pa.array([int(w.end[r[4] - 1] - base[r[0]]) for r in rows], pa.int64()),
                    ],
                    ["doc_id", "license", "matched_words", "coverage", "first_byte", "end_byte"],
                )

    return run


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = 0.8) -> DataFrame:
    """One row for each match: doc_id, license, matched_words, coverage, first_byte, end_byte (of the UTF-8 text)."""
    small_batches(docs.sparkSession)
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").where("text IS NOT NULL")
    return texts.mapInArrow(
        _scan(Index(templates or TEMPLATES), least_coverage),
        "doc_id long, license string, matched_words long, coverage double, first_byte long, end_byte long",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_license_scan": op2_license_scan}
