"""License scans by patience alignment.

A text and a template are compared as word lists. Words that stand exactly once in both are anchors; the longest
increasing run of their places is kept, and the gaps between kept anchors are aligned the same way, where words that were
not unique in the whole may be. Equal words next to anchors, at the ends of a gap, are added before it is searched. Coverage is the
share of the template's words that are aligned. The scan is one pass over whole texts without a shuffle; words that no
template holds are counted as places but never looked at.

A template is found wherever a stretch of the text of at most ``SPREAD`` times its length has ``LEAST`` of its words aligned. Stretches
start where one of the template's first words stands and are aligned with growing ends, as soon as their word counts allow it, so
anchors need to be unique within the stretch only and repeated and mixed notices are found each. Where words repeat, an alignment may
hold fewer words than the longest common subsequence: what is found is there, a notice right at the threshold may be missed (tests
measure how many). A license whose words another one holds (BSD-2-Clause in BSD-3-Clause) is found with it. The best coverage is that
of the alignment with the whole text or of a window; of equal ones, that of the template given first. Cases: null and empty texts have coverage 0 for all; repeated rows are each scanned; ties between
templates keep all that are found, in the order given; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of

LEAST, SPREAD = 0.8, 2.0
ENDS = 16  # a stretch is aligned anew when it has grown by this part of its template, at least a word
#: Notices and texts of well-known licenses.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k : k + 1], at[k : k + 1] = [v], [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def anchors(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Words that stand once in each of two stretches, thinned to the longest run that increases in both."""
    in_b: dict = {}
    for j in range(b0, b1):
        in_b[b[j]] = -1 if b[j] in in_b else j
    in_a: dict = {}
    for i in range(a0, a1):
        if in_b.get(a[i], -1) >= 0:
            in_a[a[i]] = -1 if a[i] in in_a else i
    both = sorted((i, in_b[w]) for w, i in in_a.items() if i >= 0)
    return [both[k] for k in increasing([j for _, j in both])]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j), increasing in both, with a[i] == b[j]: anchors first, then the gaps between them, where equal words next to an
    anchor are taken, then anchors again; without an anchor, equal words at either end. Gaps are kept on a list, so depth is no limit."""
    pairs, gaps = [], [(0, len(a), 0, len(b), False, False)]
    while gaps:
        a0, a1, b0, b1, left, right = gaps.pop()
        while left and a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while right and a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        kept = anchors(a, b, a0, a1, b0, b1)
        if not kept:
            if not (left and right) and (a[a0] == b[b0] or a[a1 - 1] == b[b1 - 1]):
                gaps.append((a0, a1, b0, b1, True, True))
            continue
        pairs += kept
        ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        for k, ((i0, j0), (i1, j1)) in enumerate(zip(ends, ends[1:])):
            gaps.append((i0 + 1, i1, j0 + 1, j1, left or k > 0, right or k < len(kept)))
    return sorted(pairs)


class Template:
    """A template's words, what is counted of them, and the words that an alignment of enough of them can begin and end with."""

    def __init__(self, name: str, words: list, least: float = LEAST):
        self.name, self.words, self.size = name, words, len(words)
        self.left = Counter(words)
        self.need = next((m for m in range(1, self.size + 1) if m / self.size >= least), self.size + 1)
        self.begin, self.end = set(words[: self.size - self.need + 1]), set(words[self.need - 1 :])
        self.step = max(1, self.size // ENDS)
        self.once = {w: j for j, w in enumerate(words) if self.left[w] == 1}

    def most(self, have: Counter) -> int:
        """Words that a text with these counts can hold at most."""
        return sum(min(c, have[w]) for w, c in self.left.items() if w in have)

    def may_hold(self, a: list) -> bool:
        """Whether enough of the template can stand in order: no more than all its repeated words and the longest run of the others."""
        tops: list[int] = []
        for w in a:
            if (j := self.once.get(w)) is not None:
                k = bisect_left(tops, j)
                tops[k : k + 1] = [j]
        return len(tops) + self.size - len(self.once) >= self.need


def templates_of(texts: dict[str, str], least: float = LEAST) -> list[Template]:
    return [Template(k, w, least) for k, v in texts.items() if (w := words_of(v))]


def _closest(a: list, i: int, j: int, t: Template) -> tuple[int, int] | None:
    """(places aligned, end) of the shortest stretch from i, of those tried up to j, that holds enough of the template."""
    hold, held, last = Counter(), 0, i
    for k in range(i, j):
        w = a[k]
        hold[w] += 1
        held += hold[w] <= t.left[w]
        if held >= t.need and w in t.end and (k + 1 - last >= t.step or k + 1 == j):
            last = k + 1
            if (got := len(align(a[i:last], t.words))) >= t.need:
                return got, last
    if held >= t.need and last < j and (got := len(align(a[i:j], t.words))) >= t.need:
        return got, j
    return None


def windows(some: list, at: list[int], t: Template, spread: float = SPREAD) -> list[tuple[int, int, int]]:
    """(aligned words, first and last word place) of every stretch, from left to right and apart, that holds the template."""
    place = [k for k, w in enumerate(some) if w in t.left]
    a, pos = [some[k] for k in place], [at[k] for k in place]
    out, j, held, hold = [], 0, 0, Counter()
    after = 0  # where the last window ended
    for i, w in enumerate(a):
        while j < len(a) and pos[j] - pos[i] < spread * t.size:
            hold[a[j]] += 1
            held += hold[a[j]] <= t.left[a[j]]
            j += 1
        if i >= after and held >= t.need and w in t.begin and t.may_hold(a[i:j]) and (met := _closest(a, i, j, t)):
            (got, end), start, known = met, i, None
            while known != (start, end):
                known = start, end
                # what the words still missing may add behind it, then the latest start that keeps as many
                for k in range(end, len(a)):
                    if got == t.size or pos[k] - pos[end - 1] > t.size - t.need or pos[k] - pos[start] >= spread * t.size:
                        break
                    if a[k] in t.end and (more := len(align(a[start : k + 1], t.words))) > got:
                        got, end = more, k + 1
                for k in range(start + 1, end - t.need + 1):
                    if a[k] in t.begin and (more := len(align(a[k:end], t.words))) >= got:
                        got, start = more, k
            pairs = align(a[start:end], t.words)
            out.append((got, pos[start + pairs[0][0]], pos[start + pairs[-1][0]]))
            after = end
        held -= hold[w] <= t.left[w]
        hold[w] -= 1
    return out


def scan_text(text: str | None, templates: list[Template], vocabulary: set, spread: float = SPREAD) -> tuple[str | None, float, list[tuple]]:
    """(template of the best coverage, that coverage, windows found), the windows as (template, coverage, aligned words, first and
    last word place). Coverage is that of the alignment of the whole text or of a window; templates whose words cannot do better
    than the best so far are not aligned."""
    words = words_of(text)
    at = [i for i, w in enumerate(words) if w in vocabulary]
    if not at:
        return None, 0.0, []
    some = [words[i] for i in at]
    have = Counter(some)
    most = [t.most(have) for t in templates]
    found = [(t.name, n / t.size, n, f, e) for t, m in zip(templates, most, strict=True) if m >= t.need for n, f, e in windows(some, at, t, spread)]
    best = [max((g[1] for g in found if g[0] == t.name), default=0.0) for t in templates]
    for k in sorted(range(len(templates)), key=lambda k: -most[k] / templates[k].size):
        t = templates[k]
        if most[k] and most[k] / t.size >= max(best) and best[k] < 1:
            best[k] = max(best[k], len(align([w for w in some if w in t.left], t.words)) / t.size)
    top = max(best)
    return (templates[best.index(top)].name, top, found) if top else (None, 0.0, found)


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, spread: float = SPREAD) -> DataFrame:
    """(doc_id, best_template, best_coverage, found array<struct<template, coverage, matched, first, last>>) of every row."""
    made = templates_of(templates, least)
    vocabulary = {w for t in made for w in t.left}

    def run(batches):
        for b in batches:
            best, cover, found = [], [], []
            for text in b["text"]:
                name, top, held = scan_text(text, made, vocabulary, spread)
                best.append(name), cover.append(float(top))
                found.append([dict(zip(("template", "coverage", "matched", "first", "last"), g, strict=True)) for g in held])
            yield pd.DataFrame({"doc_id": b["doc_id"], "best_template": best, "best_coverage": cover, "found": found})

    kind = "doc_id long, best_template string, best_coverage double, found array<struct<template: string, coverage: double, matched: int, first: int, last: int>>"
    return docs.select("doc_id", "text").mapInPandas(run, kind)


def op7_license(spark, sf_dir: str) -> DataFrame:
    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_distinct("found.template")  # a license that stands several times counts once
    return out.select("doc_id", "best_template", "best_coverage", F.array_join(names, "; ").alias("licenses"), F.size(names).cast("long").alias("n_licenses"))
