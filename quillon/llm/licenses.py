"""License scans: matching statistics against a generalised suffix automaton of license tokens, chained into template spans.

The tokens of all templates are in one suffix automaton. A document's tokens stream through it; at each place the
automaton holds the longest run of tokens, ending there, that some template has. Where such a run can't be extended it is
an anchor, with each place in each template where it stands. Anchors of a template that follow each other in the document
and in the template, with small gaps, are chained; a chain that covers enough of its template is a find. Where finds of
several templates overlap, the one with more matched tokens stays (the license text rather than a phrase in it).

The automaton depends on the templates only and is made once in each Python worker; documents are scanned one row at a
time, so the plan has no shuffle. Tokens that no template has end every match, so only runs of known tokens are walked.

Defined results: null and empty texts have no finds; repeated rows have the same finds each; null ids are passed on;
equal finds of two templates (ties) go to the one that is first in the list of templates; an empty table gives no rows;
further columns don't matter. A text may be of any length, all of it is scanned; offsets are those of the text as it is, also where its
lower case has another length. The short licenses are there as a whole; of the long ones (Apache, GPL, MPL) the notice is that files carry.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import quoted

#: Tokens of an anchor at least (a shorter template counts as a whole).
LEAST_MATCH = 3
#: Tokens between two anchors of a chain at most, in the document and in the template.
MOST_GAP = 12
#: The share of a template's tokens that a find must have.
COVERAGE = 0.8
TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
_MIT_WHOLE = _MIT + """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = _BSD + """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you
must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would
be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must
be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works
are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND
NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER
IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License
as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""

#: (license, template)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", "Released under the MIT License"), ("MIT", "Licensed under the MIT License"), ("MIT", "This project is licensed under the terms of the MIT license"),
    ("BSD-3-Clause", _BSD3), ("BSD-2-Clause", _BSD), ("BSD", "Released under the BSD License"), ("BSD", "Licensed under the BSD License"),
    ("ISC", _ISC), ("ISC", "Licensed under the ISC License"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("Apache-2.0", "Released under the Apache License 2.0"),
    *((f"{x}-{v}.0-or-later", _GPL.format(y, v)) for x, y in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")) for v in (2, 3)),
    *((f"{x}-{v}.0", f"licensed under the GNU {y}General Public License, version {v}") for x, y in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")) for v in (2, 3)),
    *((f"{x}-{v}.0", f"GNU {y}General Public License v{v}.0") for x, y in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")) for v in (2, 3)),
    ("MIT", _MIT_WHOLE), ("BSD-3-Clause", _BSD3 + _BSD_END), ("BSD-2-Clause", _BSD + _BSD_END), ("ISC", _ISC + _ISC_END), ("Zlib", _ZLIB), ("BSL-1.0", _BSL),
    ("MPL-2.0", _MPL), ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("Unlicense", _UNLICENSE),
    *((f"CC-{x}-{v}", f"Licensed under CC {x} {v}") for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("4.0", "3.0")),
    *((f"CC-{x}-4.0", f"This work is licensed under a Creative Commons {y} 4.0 International License") for x, y in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"))),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"), ("CC0-1.0", "Released under CC0 1.0"),
    ("Proprietary", "All rights reserved"),
)


def tokens(text: str) -> list[str]:
    low = text.lower()
    return TOKEN.findall(low) if len(low) == len(text) else [m[0].lower() for m in TOKEN.finditer(text)]


def places(text: str) -> list[tuple[int, int]]:
    """Where the tokens begin and end, in the text as it is: lower case can be longer."""
    return [m.span() for m in TOKEN.finditer(text)]


class Automaton:
    """The suffix automaton of several sequences of tokens, numbered from 1, with the places of each state."""

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        self.names = [name for name, _ in templates]
        texts = [tokens(text) for _, text in templates]
        self.sizes = [len(t) for t in texts]
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for k, words in enumerate(texts):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, self.ids.setdefault(w, len(self.ids) + 1), ends)
                ends[last].append((k, at))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            ends[self.link[v]] += ends[v]
        self.places = [sorted(set(x)) for x in ends]
        self.places[0] = []

    def _state(self, length: int, link: int, following: dict[int, int], ends: list) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int, ends: list) -> int:
        """A copy of q for the shorter contexts, which p and what it links to lead to from now on."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), ends)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int, ends: list) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another template has it
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q, ends)
        new, p = self._state(self.length[last] + 1, 0, {}, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q, ends)
        return new

    def statistics(self, ids: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For each token the state and the length of the longest match that ends with it."""
        v, n, following, link, length = 0, 0, self.next, self.link, self.length
        for c in ids:
            while c not in following[v]:
                v = link[v]
                if v < 0:
                    v, n = 0, 0
                    break
                n = length[v]
            else:
                v, n = following[v][c], n + 1
            yield v, n

    def anchors(self, ids: Sequence[int], begin: int, least: int) -> Iterator[tuple[int, int, int, int]]:
        """(template, place in it, place in the document, tokens) of the matches that can't be extended."""
        before, was = 0, 0
        for e, (v, n) in enumerate([*self.statistics(ids), (0, 0)], begin):
            if was and n != was + 1:
                for k, at in self.places[before]:
                    if was >= min(least, self.sizes[k]):
                        yield k, at - was + 1, e - was, was
            before, was = v, n

    def scan(self, words: list[str], least: int = LEAST_MATCH, gap: int = MOST_GAP, coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
        """(template, first token, token after the last, matched tokens) of the finds in a document, in order."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], dtype=np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
        shortest = min([least, *self.sizes])
        of: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= shortest:
                for k, t, d, n in self.anchors(ids[a:b].tolist(), a, least):
                    of.setdefault(k, []).append((d, t, n))
        finds = []
        for k, found in of.items():
            for matched, d0, d1 in chains(found, gap):
                if matched >= coverage * self.sizes[k]:
                    finds.append((-matched, -matched / self.sizes[k], k, d0, d1))
        taken: list[tuple[int, int]] = []  # in order, none overlaps another
        out = []
        for matched, _, k, a, b in sorted(finds):
            at = bisect_left(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                taken.insert(at, (a, b))
                out.append((k, a, b, -matched))
        return sorted(out, key=lambda f: f[1])


def chains(anchors: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(matched tokens, first token, token after the last) of the best chains of a template's anchors (d, t, n).

    The heaviest chain is taken first, then the heaviest of the anchors that it leaves.
    """
    anchors = sorted(anchors)
    longest = max(n for _, _, n in anchors)
    best: list[tuple[int, int, int]] = []  # weight, the anchor before, first token
    for i, (d, t, n) in enumerate(anchors):
        weight, before, first = n, -1, d
        for j in range(i - 1, -1, -1):
            dj, tj, nj = anchors[j]
            if d - dj > gap + longest:  # anchors are in order of their first token
                break
            # What two anchors share, in the document or in the template, counts once.
            over = max(0, dj + nj - d, tj + nj - t)
            if dj < d and tj < t and over < n and d - dj - nj <= gap and t - tj - nj <= gap and best[j][0] + n - over > weight:
                weight, before, first = best[j][0] + n - over, j, best[j][2]
        best.append((weight, before, first))
    used, out = set(), []
    for i in sorted(range(len(anchors)), key=lambda i: (-best[i][0], i)):
        path, j = [], i
        while j >= 0 and j not in used:
            path.append(j)
            j = best[j][1]
        if j < 0:
            used.update(path)
            out.append((best[i][0], best[i][2], anchors[i][0] + anchors[i][2]))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, least: int = LEAST_MATCH, gap: int = MOST_GAP, coverage: float = COVERAGE) -> DataFrame:
    """The license templates that documents have.

    ``doc_id``, ``license``, ``template`` (its number), ``first_token`` and ``last_token`` in the document, ``begin`` and ``end`` in
    characters, ``matched`` tokens and their share ``coverage`` of the template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        for b in batches:
            rows, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if not text:
                    continue
                finds = automaton.scan(tokens(text), least, gap, coverage)
                if finds:
                    at = places(text)
                    for k, a, e, n in finds:
                        rows.append(i)
                        out.append((automaton.names[k], k, a, e - 1, at[a][0], at[e - 1][1], n, n / automaton.sizes[k]))
            columns = zip(*out) if out else [[]] * 8
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            made = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *made], ["doc_id", "license", "template", "first_token", "last_token", "begin", "end", "matched", "coverage"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, license string, template int, first_token int, last_token int, begin int, end int, matched int, coverage double"
    )
