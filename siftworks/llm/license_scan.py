"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts are words of letters and digits, A-Z as a-z. Of every ``WINDOW`` neighbouring runs of
``GRAM`` words the one with the smallest hash is a fingerprint, so a text that shares
``WINDOW + GRAM - 1`` words in a row with a template shares a fingerprint. Fingerprints of
templates are an inverted index. Shared fingerprints on nearby diagonals (place in the text less place in
the template) are one occurrence; it is aligned with the template in a band around them,
the most matching words in order being the best alignment.

A few changed words leave a short template no run in common with a text. Templates of up to ``SHORT`` words are
therefore also looked for wherever a stretch of text holds enough of their words, in any order: every stretch of a template's
length and twice what it may gain is aligned if it can reach the asked coverage.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm.words import _letters, hashed_runs, ngram_hashes, slices, text_bytes

GRAM, WINDOW = 3, 2
LEAST_COVERAGE = 0.75
BAND_SHARE = 4  # a template of n words may gain or lose n / 4
SHORT = 64
LOT = 2000
_SIEVE = 18

# Public notices and licence texts as their stewards word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        'distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}


def template_table(spark, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``(name, text)`` of templates."""
    return spark.createDataFrame(sorted(templates.items()), "name string, text string")


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte spans and row borders of all words; the bytes and their row borders."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    inside, value = _letters()
    raw, rows = text_bytes(column)
    hashes, start, end = hashed_runs(raw, rows, kind, value, inside)
    return hashes, start, end, np.searchsorted(start, rows), raw, rows


def winnowed(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of each window, the last of equals; all windows of a shorter list are one."""
    if not len(grams):
        return np.zeros(0, np.int64)
    size = min(window, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, size)[:, ::-1]
    return np.unique(np.arange(len(views)) + size - 1 - views.argmin(axis=1))


def aligned(template: np.ndarray, text: np.ndarray, low: int, band: int) -> list[int]:
    """Places in ``text`` of the words of a best alignment: the longest common subsequence within the band.

    A template's word ``i`` may meet places ``low + i`` to ``low + i + band`` only.
    """
    width = band + 1
    score = np.zeros((len(template) + 1, width + 1), np.int32)
    place = low + np.arange(width)
    for i in range(len(template)):
        at = place + i
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == template[i]
        # column c of this row is one place further than column c of the row before
        diagonal, above = score[i, :width], score[i, 1:]
        score[i + 1, 1:] = 0
        score[i + 1, :width] = np.maximum.accumulate(np.maximum(diagonal + same, above))
        score[i + 1, width] = score[i + 1, width - 1]
    found, i, c = [], len(template), width - 1
    while i > 0 and c >= 0:
        here = score[i, c]
        at = low + i - 1 + c
        if here == score[i - 1, min(c + 1, width)]:
            i, c = i - 1, min(c + 1, width)
            c = min(c, width - 1)
        elif c > 0 and here == score[i, c - 1]:
            c -= 1
        else:
            if here > score[i - 1, c]:
                found.append(at)
            i -= 1
    return found[::-1]


def tight(match: list[int]) -> list[int]:
    """The alignment without words at its ends that stand further off than there are of them."""
    while True:
        gaps = np.diff(match)
        ahead = np.flatnonzero(gaps - 1 > np.arange(1, len(match)))
        behind = np.flatnonzero(gaps - 1 > np.arange(len(match) - 1, 0, -1))
        if len(ahead):
            match = match[int(ahead[-1]) + 1 :]
        elif len(behind):
            match = match[: int(behind[0]) + 1]
        else:
            return match


class _Templates:
    def __init__(self, named: list[tuple[str, str]]):
        hashes, _, _, borders, _, _ = _words(pa.array([t for _, t in named], pa.string()))
        self.names = [n for n, _ in named]
        self.words = [hashes[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            grams = ngram_hashes(words, GRAM)
            for place in winnowed(grams).tolist():
                self.index[int(grams[place])].append((k, place))
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[np.array(list(self.index), np.uint64) >> np.uint64(64 - _SIEVE)] = True
        # short templates by each of their words: sorted pairs of a word and a template that holds it
        pairs = [(w, k) for k, words in enumerate(self.words) if len(words) <= SHORT for w in set(words.tolist())]
        pairs.sort()
        self.keys, self.holders = np.array([w for w, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64)
        self.word_sieve = np.zeros(1 << _SIEVE, bool)
        self.word_sieve[self.keys >> np.uint64(64 - _SIEVE)] = True

    def find(self, words: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
        """``(template, words matched, first place, last place)`` of every occurrence in a text's words."""
        found = self._by_runs(words, least)
        return found + self._by_words(words, least, found)

    def _by_words(self, words: np.ndarray, least: float, known: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Occurrences of short templates beside the known ones, which need no run of words in common."""
        places = np.flatnonzero(self.word_sieve[words >> np.uint64(64 - _SIEVE)])
        lo, hi = (np.searchsorted(self.keys, words[places], side) for side in ("left", "right"))
        size = hi - lo
        holders = self.holders[np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)]
        places = np.repeat(places, size)
        need = np.array([max(1, ceil(least * len(w) - 1e-9)) for w in self.words], np.int64)
        found = []
        for k in np.flatnonzero(np.bincount(holders, minlength=len(need)) >= need).tolist():
            taken = sorted((first, last) for j, _, first, last in known if j == k)
            ends = [0, *(last + 1 for _, last in taken)], [*(first for first, _ in taken), len(words)]
            own = places[holders == k]
            free = [(a, b) for a, b in zip(*ends, strict=True) if a < b]
            while free:
                a, b = free.pop()
                match = self._best(k, words, own[np.searchsorted(own, a) : np.searchsorted(own, b)], int(need[k]), b)
                if match:
                    found.append((k, len(match), match[0], match[-1]))
                    free += [(a, match[0]), (match[-1] + 1, b)]
        return found

    def _best(self, k: int, words: np.ndarray, own: np.ndarray, need: int, end: int) -> list[int]:
        """The best of the first stretch with an occurrence and those that begin within it, or nothing."""
        template, best = self.words[k], []
        slack = max(2, len(template) // BAND_SHARE)
        width = len(template) + 2 * slack
        for at in own[: max(0, len(own) - need + 1)][own[need - 1 :] - own[: max(0, len(own) - need + 1)] < width].tolist():
            if best and at > best[-1]:
                break
            text = words[at : min(at + width, end)]
            if np.isin(template, text).sum() < need:
                continue
            every = aligned(template, text, -len(template), len(template) + width)
            close = tight(every)  # words behind changed ones stay where the coverage needs them
            match = [at + x for x in (close if len(close) >= need else every)]
            if len(match) >= need and (not best or (-len(match), match[-1] - match[0]) < (-len(best), best[-1] - best[0])):
                best = match
        return best

    def _by_runs(self, words: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
        """Occurrences that share a fingerprint with their template."""
        grams = ngram_hashes(words, GRAM)
        if not self.sieve[grams >> np.uint64(64 - _SIEVE)].any():
            return []
        hits = defaultdict(list)
        for place in winnowed(grams).tolist():
            for k, own in self.index.get(int(grams[place]), ()):
                hits[k].append((place - own, place))
        found = []
        for k, places in hits.items():
            template, places = self.words[k], sorted(places)
            diagonals = np.array([d for d, _ in places])
            slack = max(2, len(template) // BAND_SHARE)
            for group in np.split(diagonals, np.flatnonzero(np.diff(diagonals) > slack) + 1):
                low, high = int(group[0]) - slack, int(group[-1]) + slack
                match = tight(aligned(template, words, low, high - low))
                if len(match) >= least * len(template):
                    found.append((k, len(match), match[0], match[-1]))
        return found


def scan_licenses(
    docs: DataFrame, templates: DataFrame, least: float = LEAST_COVERAGE, lot: int = LOT
) -> DataFrame:
    """``(doc_id, template, coverage, n_matched, n_words, start, end)``: occurrences of templates in whole texts.

    ``coverage`` is the share of the template's words matched in order; ``start`` and
    ``end`` are code points around the matched words. ``docs (doc_id, text)`` and ``templates (name, text)`` may have other
    columns, which are ignored. Null and empty texts match nothing, nor do wordless templates. Occurrences
    of one template found by words alone do not overlap its others. Null ids are kept, repeated rows repeat their
    matches, one text may match several templates at one place. Empty tables give an empty result. Templates are broadcast in lots
    of bounded number, each with a pass of its own over the texts.
    """
    schema = "doc_id long, template string, coverage double, n_matched long, n_words long, start long, end long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "text IS NOT NULL"
    )
    parts, named = [], []

    def one_pass(named: list[tuple[str, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(named)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Templates(shared.value)
            for whole in batches:
                for batch in slices(whole, "text"):
                    hashes, start, end, borders, raw, row = _words(batch.column("text"))
                    ids, found = batch.column("doc_id").to_pylist(), []
                    for i, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
                        for k, matched, first, last in known.find(hashes[a:b], least):
                            lo, hi = start[a + first], end[a + last]
                            before = int(((raw[row[i] : lo] & 0xC0) != 0x80).sum())
                            inner = int(((raw[lo:hi] & 0xC0) != 0x80).sum())
                            size = len(known.words[k])
                            found.append((ids[i], known.names[k], matched / size, matched, size, before, before + inner))
                    columns = list(zip(*found, strict=True)) if found else [[]] * 7
                    names = ("doc_id", "template", "coverage", "n_matched", "n_words", "start", "end")
                    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.record_batch({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

        return rows.mapInArrow(run, schema)

    for row in templates.select("name", "text").where("name IS NOT NULL AND text IS NOT NULL").distinct().toLocalIterator():
        named.append((row["name"], row["text"]))
        if len(named) == lot:
            parts.append(one_pass(named))
            named = []
    if named:
        parts.append(one_pass(named))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
