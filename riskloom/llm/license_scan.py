"""Licence scans by patience alignment with known notices.

Text and notices are compared as lower-case words. Where a run of three words of a notice turns up,
the stretch of text around it is aligned with the notice: words that occur once on either side are
anchors, the longest run of anchors that rise on both sides is kept, and the gaps between them
are aligned in the same way. The share of the notice's words that found a partner is its coverage.
A notice of up to ``Scan.short`` words has to be there in full, a longer one to ``Scan.coverage``.

Notices of a family differ by what they add (a third clause, *Lesser*, *Affero*, *SA*), so several may cover
one stretch. Where findings overlap, the one with the best contrast stays: its aligned words less the notice's
words that are missing and less the words inside the stretch that it does not explain, where ``MARKS`` weigh more. ``detail`` is the version that the
text states, or the expression of an SPDX line; null if there is none.

An automaton passes over each text first. It looks for words of which every text that covers some
notice far enough must hold one, so that it skips no finding. Equal contrast goes to the earlier start, then to the
first name. Positions are code points of the whole text.

Null and empty texts have no findings. Texts of any length are read whole, in time in proportion
to their length; several notices, or one several times, give a row each. Repeated rows are
scanned each on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.frames import column, per_batch, rows_of, texts_of

_WORD = re.compile(r"[^\W_]+")

# fixed values: public licence notices; version numbers of the short forms are left out
NOTICES = {
    "rights-reserved": "All rights reserved",
    "mit-line": "Released under the MIT License",
    "apache-line": "Licensed under the Apache License, Version",
    "gpl-line": "licensed under the GNU General Public License, version",
    "lgpl-line": "licensed under the GNU Lesser General Public License, version",
    "agpl-line": "licensed under the GNU Affero General Public License, version",
    "cc-by-nc-line": "Licensed under CC BY-NC",
    "cc-by-line": "Licensed under CC BY",
    "cc-by-sa-line": "Licensed under CC BY-SA",
    "cc-by-nd-line": "Licensed under CC BY-ND",
    "cc-by-nc-sa-line": "Licensed under CC BY-NC-SA",
    "cc-by-nc-nd-line": "Licensed under CC BY-NC-ND",
    "spdx-line": "SPDX-License-Identifier",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "lgpl-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
General Public License for more details.""",
    "agpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
General Public License for more details.""",
    "epl-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public
License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
}
#: words that tell members of a family apart, and how many others one of them weighs
MARKS, MARK_WEIGHT = frozenset({"affero", "lesser", "neither", "endorse"}), 8
#: a version inside a notice, and what may follow its last word
_VERSION = re.compile(r"\b(?:version|v\.?) {0,3}([0-9]+(?:\.[0-9]+){0,3})", re.I)
_VERSION_NEXT = re.compile(r"[ ,:]{0,4}(?:(?:version|v\.?) {0,3})?([0-9]+(?:\.[0-9]+){0,3})", re.I)
_EXPRESSION = re.compile(r": {0,9}([A-Za-z0-9.+()-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+()-]+)*)")


@dataclass(frozen=True)
class Scan:
    coverage: float = 0.8
    short: int = 12
    run: int = 3

    def wanted(self, words: int) -> int:
        """How many of a notice's words have to be aligned."""
        return words if words <= self.short else int(-(-words * self.coverage // 1))


def rising(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of ``pairs``, sorted by the first number, whose second numbers rise."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile:
            before[k] = last[pile - 1]
        tops[pile : pile + 1] = [b]
        last[pile : pile + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising on both sides, by patience alignment."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        left, right = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        once = {w: k for k, w in enumerate(b[blo:bhi], blo) if right[w] == 1 and left[w] == 1}
        anchors = rising([(k, once[w]) for k, w in enumerate(a[alo:ahi], alo) if w in once])
        if anchors:
            found += anchors
            for (x, y), (x2, y2) in zip([(alo - 1, blo - 1), *anchors], [*anchors, (ahi, bhi)]):
                open_.append((x + 1, x2, y + 1, y2))
    return sorted(found)


class _Notices:
    def __init__(self, scan: Scan):
        self.scan = scan
        self.words = {name: [w.lower() for w in _WORD.findall(text)] for name, text in NOTICES.items()}
        self.runs: dict[tuple, list[tuple[str, int]]] = {}
        self.needed = ahocorasick.Automaton()
        for name, words in self.words.items():
            for k in range(len(words) - scan.run + 1):
                self.runs.setdefault(tuple(words[k : k + scan.run]), []).append((name, k))
            # words that make up more of the notice than may be missing: one of them must be there
            spare, counts = len(words) - scan.wanted(len(words)), Counter(words)
            for w in sorted(counts, key=lambda w: (-len(w), w)):
                self.needed.add_word(w, w)
                spare -= counts[w]
                if spare < 0:
                    break
        self.needed.make_automaton()

    def find(self, text: str) -> list[tuple[str, float, int, int, int, str | None]]:
        """(notice, coverage, start, end, aligned words, detail), by start."""
        if next(self.needed.iter(text.lower()), None) is None:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[s:e].lower() for s, e in spans]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, run in enumerate(zip(*(words[i:] for i in range(self.scan.run)))):
            for name, at in self.runs.get(run, ()):
                seeds.setdefault(name, []).append((k, at))
        found = []
        for name, places in seeds.items():
            notice, done = self.words[name], 0
            size, slack = len(notice), len(notice) // 3 + 2 if len(notice) > self.scan.short else 0
            for k, at in places:
                low, high = max(done, k - at - slack), k + size - at + slack
                if k < done:
                    continue
                pairs = align(words[low:high], notice)
                if len(pairs) >= self.scan.wanted(size):
                    first, last = low + pairs[0][0], low + pairs[-1][0]
                    shared = weight(notice[j] for _, j in pairs)
                    contrast = 3 * shared - weight(notice) - weight(words[first : last + 1])
                    found.append((contrast, spans[first][0], spans[last][1], name, len(pairs)))
                    done = last + 1
        return [(name, n / len(self.words[name]), start, end, n, detail(name, text, start, end))
                for start, end, name, n in apart(found)]


def weight(words: Iterable[str]) -> int:
    return sum(MARK_WEIGHT if w in MARKS else 1 for w in words)


def apart(found: Sequence[tuple[int, int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, name, words) of those (contrast, start, end, name, words) that overlap no better one, by start."""
    kept: list[tuple[int, int, str, int]] = []
    for _, start, end, name, n in sorted(found, key=lambda f: (-f[0], f[1], f[3])):
        at = bisect_left(kept, (start,))
        # kept ones do not overlap each other: only the neighbours can reach in
        if (at and kept[at - 1][1] > start) or (at < len(kept) and kept[at][0] < end):
            continue
        insort(kept, (start, end, name, n))
    return kept


def detail(name: str, text: str, start: int, end: int) -> str | None:
    """The version stated in or after a finding; of an SPDX line the expression."""
    if name == "spdx-line":
        found = _EXPRESSION.match(text, end)
    else:
        found = _VERSION.search(text, start, end) or _VERSION_NEXT.match(text, end)
    return found[1] if found else None


@lru_cache(maxsize=4)
def notices(scan: Scan = Scan()) -> _Notices:
    return _Notices(scan)


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()),
    ("start", pa.int64()), ("end", pa.int64()), ("aligned_words", pa.int64()),
    ("detail", pa.string()),
])


def find_licenses(docs: DataFrame, scan: Scan = Scan(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per finding: doc_id, license, coverage, start, end, aligned_words and detail."""

    def make():
        known = notices(scan)

        def columns(batch):
            rows = [
                (d, *f) for d, t in zip(rows_of(batch, "doc_id"), texts_of(batch, "text")) for f in known.find(t)
            ]
            return {name: [r[k] for r in rows] for k, name in enumerate(_SCHEMA.names)}
        return columns

    rows = docs.select(column(id_column).cast("long").alias("doc_id"), column(text).alias("text"))
    kinds = "doc_id long, license string, coverage double, start long, end long, aligned_words long, detail string"
    return rows.mapInArrow(per_batch(make, _SCHEMA), kinds)
