"""License scans: matching statistics of every text against a generalised suffix automaton of license tokens, then chaining.

A text is streamed through the automaton of all templates, which gives the longest match that ends at each token. Matches
that can't be extended and are long enough are chained: a chain keeps the order of its template and bridges short gaps.
A chain that covers enough of its template is a span of that license.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks, tokens
from quire.runtime import prepare

#: Tokens of the shortest match, of the widest gap within a chain, and the share of a template that has to be covered.
LEAST, GAP, COVERAGE = 4, 12, 0.7
#: The bound on the tokens of all templates, whose automaton every worker holds. More are refused.
MOST_TOKENS = 1_000_000

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution. "
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version "
    "3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE '
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Name and text; a license may have several templates, its notice in files and the lines that name it.
TEMPLATES: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. " + _WARRANTY,
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under '
        "the License.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GNU.format("General Public License")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License")),
    ("AGPL-3.0", _GNU.format("Affero General Public License")),
    ("BSD-2-Clause", _BSD),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", _BSD + _DISCLAIMER),
    ("BSD-3-Clause", _BSD + "3. " + _NAMES + _DISCLAIMER),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("0BSD", _ISC + ". " + _ISC_WARRANTY),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
        "act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS"),
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must "
        "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole "
        "or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
)


class Automaton:
    """Generalised suffix automaton of sequences of token numbers; ends has (sequence, index) of all occurrences of a state."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.ends = [-1], [0], [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c)
                self.ends[last].add((k, i))
        for v in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):
            self.ends[self.link[v]] |= self.ends[v]

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the words of q that are no longer than one token after p."""
        if self.size[p] + 1 == self.size[q]:
            return q
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def statistics(self, sequence: Iterable[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each token."""
        v, n = 0, 0
        for c in sequence:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.size[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            yield v, n


def chains(matches: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Covered tokens and matches of disjoint chains, best first; a match is its place in the text, that in the template, and its length.

    A match may follow another if it starts no earlier than that one ends, in both, and at most `gap` tokens later. Of two overlapping
    matches the later one is cut. Among equally good ones the chain that ends first in the text is taken. A chain that would go through a match of
    a better one begins behind it.
    """
    matches = sorted(matches)
    best, back = [m[2] for m in matches], [-1] * len(matches)
    longest = max((m[2] for m in matches), default=0)
    low = 0
    for i, (d, t, n) in enumerate(matches):
        while matches[low][0] + longest + gap < d:
            low += 1
        for j in range(low, i):
            e, u, m = matches[j]
            over = max(0, e + m - d, u + m - t)
            if n - over > 0 and d - e > 0 and t - u > 0 and d - (e + m) <= gap and t - (u + m) <= gap and best[j] + n - over > best[i]:
                best[i], back[i] = best[j] + n - over, j
    used: set[int] = set()
    out = []
    heap = [(-b, i) for i, b in enumerate(best)]
    heapify(heap)
    while heap:
        claimed, i = heappop(heap)
        chain, k = [], i
        while k >= 0 and k not in used:
            chain.append(k)
            k = back[k]
        if not chain:
            continue
        if k >= 0:  # the rest belongs to a better chain: what is left is a chain of its own, and worth less
            covered, back[chain[-1]] = matches[chain[-1]][2], -1
            for (d, t, n), (e, u, m) in zip((matches[k] for k in chain), (matches[k] for k in chain[1:])):
                covered += n - max(0, e + m - d, u + m - t)
            heappush(heap, (-covered, i))
            continue
        used.update(chain)
        out.append((-claimed, [matches[k] for k in reversed(chain)]))
    return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: int = LEAST, gap: int = GAP, coverage: float = COVERAGE):
        self.names, self.least, self.gap, self.coverage = [n for n, _ in templates], least, gap, coverage
        h, doc = tokens.word_hashes([t for _, t in templates])
        self.words, number = np.unique(h, return_inverse=True)
        self.sequences = [number[doc == k].tolist() for k in range(len(templates))]
        self.automaton = Automaton(self.sequences)
        self.filter = np.zeros(1 << 20, np.bool_)
        self.filter[(self.words >> np.uint64(44)).astype(np.int64)] = True

    def spans(self, places: np.ndarray, numbers: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Template, first and last token in the text, covered tokens of the licenses in one text; places are those of known tokens."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        cut = np.flatnonzero(np.diff(places) != 1) + 1
        for place, number in zip(np.split(places, cut), np.split(numbers, cut)):
            if len(place) < self.least:
                continue
            first = int(place[0])
            seen = [*self.automaton.statistics(number.tolist()), (0, 0)]
            for i, ((v, n), (_, after)) in enumerate(zip(seen, seen[1:])):
                if n >= self.least and after <= n:
                    for k, end in self.automaton.ends[v]:
                        found.setdefault(k, []).append((first + i - n + 1, end - n + 1, n))
        options = []
        for k, matches in found.items():
            for covered, chain in chains(matches, self.gap):
                if covered >= self.coverage * len(self.sequences[k]):
                    options.append((-covered, len(self.sequences[k]), chain[0][0], chain[-1][0] + chain[-1][2] - 1, k))
        taken: list[tuple[int, int, int, int]] = []
        for covered, _, start, end, k in sorted(options):
            if all(end < s or start > e for _, s, e, _ in taken):
                taken.append((k, start, end, -covered))
        return sorted(taken, key=lambda x: x[1])

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        h, doc = tokens.word_hashes(texts)
        some = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, h[some]), len(self.words) - 1)
        ok = self.words[at] == h[some]
        some, at = some[ok], at[ok]
        # only runs of known tokens that are long enough are streamed
        first, size = blocks.runs(np.cumsum(np.r_[0, (np.diff(some) != 1) | (np.diff(doc[some]) != 0)]) if len(some) else some)
        keep = np.repeat(size >= self.least, size)
        some, at = some[keep], at[keep]
        own = np.searchsorted(doc, np.arange(len(texts)))
        for s, n in zip(*blocks.runs(doc[some])):
            d = int(doc[some[s]])
            out[d] = self.spans(some[s : s + n] - own[d], at[s : s + n])
        return out


def _run(scanner: Scanner):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tokens.steps(batch.column(1).to_pylist()):
                rows = [(d + at, *span) for d, spans in enumerate(scanner.scan(texts)) for span in spans]
                if not rows:
                    continue
                row, template, start, end, covered = (np.array(c) for c in zip(*rows))
                size = np.array([len(scanner.sequences[k]) for k in template])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)), pa.array([scanner.names[k] for k in template]), pa.array(template.astype(np.int32)),
                        pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(covered.astype(np.int32)), pa.array(np.round(covered / size, 6)),
                    ],
                    names=["doc_id", "license", "template", "first_word", "last_word", "n_words", "coverage"],
                )

    return run


def templates_of(table: DataFrame) -> tuple[tuple[str, str], ...]:
    """The templates of a table with columns license and text, in order; null and repeated ones are left out. ValueError for over MOST_TOKENS tokens."""
    rows = table.where("license IS NOT NULL AND text IS NOT NULL").select("license", "text").distinct()
    n = rows.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    if n > MOST_TOKENS:
        raise ValueError(f"the templates have some {n} tokens; the bound is {MOST_TOKENS}")
    return tuple(sorted((r.license, r.text) for r in rows.collect()))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: int = LEAST, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, template, first_word, last_word, n_words, coverage: a row for every license span of every text.

    templates are names and texts, here or from a table by `templates_of`; whole license texts of thousands of words are fine.

    Words are runs of letters and numbers in lower case, counted from 0; n_words of the template are covered. Where spans of several
    templates overlap, the one that covers most words stays, then the shorter template, the earlier place, the earlier template. Null and
    empty texts have no spans, very long ones are read whole. Repeated rows give repeated spans, null ids are passed on; other columns are not read. An
    empty table gives no rows.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, license string, template int, first_word int, last_word int, n_words int, coverage double"
    return docs.select("doc_id", "text").mapInArrow(_run(Scanner(templates, least, gap, coverage)), schema)
