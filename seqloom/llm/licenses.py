"""License texts in documents: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import text_of

GRAM = 3
WINNOW = 3
BAND = 12
COVERAGE = 0.75
_WORD = re.compile(r"\w+")

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: License id and template: short notices, file headers, and whole texts of short licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _GRANT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD-2-Clause", _BSD_2),
    ("ISC", _ISC),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", f"{_GRANT} {_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_THIRD}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("ISC", f"{_ISC} {_ISC_DISCLAIMER}"),
]


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    m = len(ids) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    ok = np.ones(m, bool)
    for k in range(n):
        own = ids[k : k + m]
        h = (h ^ own.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        ok &= own > 0
    h[~ok] = 0  # 0: a word that no template has
    return h


def winnow(h: np.ndarray, window: int = WINNOW) -> list[int]:
    """Positions of the least hash of every window, the last of equals."""
    if len(h) <= window:
        return [int(len(h) - 1 - np.argmin(h[::-1]))] if len(h) else []
    return sorted({int(k + window - 1 - np.argmin(h[k : k + window][::-1])) for k in range(len(h) - window + 1)})


def align(t: list[int], d: list[int], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Banded alignment of template t within d (ids, 0 matches nothing): template word i near d[i + shift].

    Returns (matched words, first matched place, one past the last), for the most matches less half the gaps and mismatches;
    of equals the one nearest the shift.
    """
    m, width = len(t), 2 * band + 1
    if shift >= 0 and d[shift : shift + m] == t:
        return m, shift, shift + m
    lo = shift - band  # of d at template word 0
    none = (-1e9, 0, -1, -1)
    row = [(0.0, 0, -1, -1)] * (width + 1)  # free start; score, matches, first, last
    for i in range(m):
        new = [none] * (width + 1)
        for k in range(width):
            j = i + lo + k
            score, n, first, last = row[k]
            if 0 <= j < len(d):
                if d[j] == t[i] and t[i]:
                    diag = (score + 1, n + 1, first if n else j, j + 1)
                else:
                    diag = (score - 0.5, n, first, last)
            else:
                diag = (score - 0.5, n, first, last)
            up = row[k + 1]  # a template word that d lacks
            one = max(diag, (up[0] - 0.5, *up[1:]), key=lambda x: (x[0], x[1]))
            if k:
                side = new[k - 1]  # a word of d that the template lacks
                if side[0] - 0.5 > one[0]:
                    one = (side[0] - 0.5, *side[1:])
            new[k] = one
        new[width] = none
        row = new
    best = max(row, key=lambda x: (x[0], x[1], -abs(x[2] - shift), -x[2]))
    return best[1], best[2], best[3]


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float = COVERAGE):
        self.coverage = coverage
        self.number: dict[str, int] = {}
        self.names, self.words, self.counts = [], [], []
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in templates:
            words = _WORD.findall(text.lower())
            if not words:
                continue
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            h = _grams(np.array(ids), min(GRAM, len(ids)))
            if len(ids) < GRAM:
                continue  # shorter than a fingerprint
            for at in winnow(h):
                index[int(h[at])].append((len(self.names), at))
            self.names.append(name)
            self.words.append(ids)
            self.counts.append(Counter(ids))
        self.index = dict(index)
        self.hashes = np.array(sorted(index), np.uint64)

    def _matches(self, todo: list[tuple[int, int]], d: list[int]) -> set[tuple]:
        """(template, matched words, coverage, first, end) of alignments near the shifts that cover enough."""
        found = set()
        for t, shift in todo:
            m = len(self.words[t])
            a, b = max(0, shift - BAND), min(len(d), shift + m + BAND)
            if b - a < self.coverage * m or (Counter(d[a:b]) & self.counts[t]).total() < self.coverage * m:
                continue  # too few of its words are there
            n, first, end = align(self.words[t], d[a:b], shift - a)
            if n and n / m >= self.coverage:
                found.add((t, n, n / m, a + first, a + end))
        return found

    @staticmethod
    def _beside(d: list[int], shift: int, m: int) -> bool:
        """Whether words near the shift are in a match (-1), but not all of its own span."""
        own = d[max(0, shift) : max(0, shift + m)]
        return own.count(-1) < len(own) and -1 in d[max(0, shift - BAND) : shift + m + BAND]

    def scan(self, text: str) -> list[tuple[str, int, int, float, int, int]]:
        """(license, template, matched words, coverage, start, end): end is one past the last character."""
        low = text.lower()
        if len(low) == len(text):
            words = _WORD.findall(low)
        else:
            words = [w.lower() for w in _WORD.findall(text)]
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        h = _grams(ids, GRAM)
        if not len(h) or not len(self.hashes):
            return []
        near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hits: dict[int, list[int]] = defaultdict(list)
        for p in np.flatnonzero((self.hashes[near] == h) & (h > 0)).tolist():
            for t, at in self.index[int(h[p])]:
                hits[t].append(p - at)
        if not hits:
            return []
        d = ids.tolist()
        todo = [(t, shift) for t, own in hits.items() for shift in sorted(set(own))]
        kept: list[tuple] = []
        starts: list[int] = []  # of those kept, in order; they don't overlap
        ends: list[int] = []
        while found := self._matches(todo, d):
            # of matches that overlap, the one with the most matched words stays
            before = len(kept)
            for x in sorted(found, key=lambda x: (-x[1], -x[2], x[3], x[0])):
                k = bisect_right(starts, x[3])
                if (k == 0 or ends[k - 1] <= x[3]) and (k == len(starts) or starts[k] >= x[4]):
                    starts.insert(k, x[3])
                    ends.insert(k, x[4])
                    kept.append(x)
            if len(kept) == before:
                break
            # a neighbour may lie in the band of a match: look again beside what is kept
            for x in kept[before:]:
                d[x[3] : x[4]] = [-1] * (x[4] - x[3])
            todo = [(t, s) for t, s in todo if self._beside(d, s, len(self.words[t]))]
        if not kept:
            return []
        spans = [m.span() for m in _WORD.finditer(text if len(low) != len(text) else low)]
        return [(self.names[t], t, n, c, spans[a][0], spans[b - 1][1]) for t, n, c, a, b in sorted(kept, key=lambda x: x[3])]


def licenses(docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE, name: str = "licenses") -> DataFrame:
    """docs with an array column `name` of (license, template, matched, coverage, start, end), in text order.

    Templates are matched by words, lower-cased, over whole texts; coverage is the share of
    a template's words that the best banded alignment matches. Of overlapping matches the
    longest stays; ties go to the better covered, the earlier, then to the template listed
    first. Null, empty or wordless texts have none. Templates under three words are left
    out. Very long texts are scanned whole. Repeated rows are judged alike; an empty table
    gives an empty result. A column called `name` is replaced, all others pass through.
    """
    held: list[Scanner] = []
    templates = TEMPLATES if templates is None else templates

    @F.pandas_udf("array<struct<license: string, template: int, matched: int, coverage: double, start: int, end: int>>")
    def scan(texts):
        import pandas as pd

        if not held:
            held.append(Scanner(templates, coverage))
        names = ("license", "template", "matched", "coverage", "start", "end")
        return pd.Series([[dict(zip(names, x)) for x in held[0].scan(t)] for t in texts])

    return docs.withColumn(name, scan(text_of(text_col)))
