"""License scans by patience alignment.

Words (lower case) of the whole text are aligned with each template's: words that occur
once in both are anchors, the longest increasing subsequence of them is kept, and the gaps
between are aligned in the same way; where a gap has no anchor, equal words at its ends
match. Coverage is the share of the template's words that matched.

A template is aligned only in windows of the text that hold enough of its distinct words
to reach ``min_coverage``; a text that lacks too many of them is passed over, which loses
nothing. A window holds ``SPREAD`` times a template's words to either side of the word that
completes it (``SLACK`` more than its words for templates below ``SHORT`` words, whose words
occur by chance), so a copy that is thinned by other words beyond that is not found, or with
less coverage; after a window that fails, the next begins half a template further on. Each
template may be found many times in one text.

Scale: a map over the scan, no shuffle; templates are a fixed table of a few kilobytes.

Cases: a null or empty text holds no license; repeated rows are scanned each; ties in
coverage go to the longer template, then to the earlier in the table; an empty table gives no rows; further
columns are not carried along.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import common

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
MIN_COVERAGE = 0.8
SPREAD, SLACK, SHORT = 4.0, 1.25, 20
#: Public license statements and texts.
TEMPLATES: dict[str, str] = {
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "MIT-statement": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
        "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this "
        "entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in "
        "whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object "
        "code generated by a source language processor."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser "
        "General Public License for more details."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero "
        "General Public License for more details."
    ),
}
FOUND = "doc_id long, license string, coverage double, start long, end long, n_found int, found string"


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (i, j) of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(a[a0:a1], a0) if ca[w] == 1}
        pairs = [(j, where[w]) for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1 and w in where]
        anchors = longest_increasing(pairs)
        if not anchors:
            continue
        out += [(i, j) for j, i in anchors]
        edges = [(b0 - 1, a0 - 1), *anchors, (b1, a1)]
        todo += [(i + 1, i2, j + 1, j2) for (j, i), (j2, i2) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, by their first, with increasing seconds (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, x) in enumerate(pairs):
        pile = bisect_left(tops, x)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(x)
            at.append(k)
        else:
            tops[pile], at[pile] = x, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def prepared(templates: dict[str, str], min_coverage: float = MIN_COVERAGE) -> list[tuple[str, list[str], frozenset, int, list[str]]]:
    """name, words, distinct words, the fewest distinct words of a copy, and words of which a text with a copy holds one at least."""
    out = []
    for name, t in templates.items():
        words = WORD.findall(t.lower())
        distinct = frozenset(words)
        need = max(1, len(distinct) - (len(words) - math.ceil(min_coverage * len(words) - 1e-9)))
        rare = sorted(distinct, key=lambda w: (-len(w), w))[: len(distinct) - need + 1]
        out.append((name, words, distinct, need, rare))
    return out


def scan(text: str, templates: list[tuple], min_coverage: float = MIN_COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) of each place found, in code points, by template, then place."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length; keep offsets true
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    present = None
    out = []
    for name, words, distinct, need, rare in templates:
        if not any(w in low for w in rare):
            continue
        if present is None:
            spans = [m.span() for m in WORD.finditer(low)]
            present = [low[a:b] for a, b in spans]
            where: dict[str, list[int]] = {}
            for k, w in enumerate(present):
                where.setdefault(w, []).append(k)
        here = distinct & where.keys()
        if len(here) < need:
            continue
        size = int((SLACK if len(words) < SHORT else SPREAD) * len(words)) + 4
        places = sorted(k for w in here for k in where[w])
        count: Counter = Counter()
        lo = done = again = 0
        for hi, p in enumerate(places):
            count[present[p]] += 1
            while lo <= hi and (places[lo] <= p - size or places[lo] < done):
                count[present[places[lo]]] -= 1
                if not count[present[places[lo]]]:
                    del count[present[places[lo]]]
                lo += 1
            if p < max(done, again) or len(count) < need:
                continue
            a, b = places[lo], min(len(present), p + size)
            got = align(present[a:b], words)
            if len(got) >= min_coverage * len(words) - 1e-9:
                first, last = a + got[0][0], a + got[-1][0]
                out.append((name, len(got) / len(words), spans[first][0], spans[last][1]))
                done = last + 1
            else:
                again = p + len(words) // 2
    return out


def _scan(templates: dict[str, str], min_coverage: float):
    def run(batches):
        ready = prepared(templates, min_coverage)
        rank = {name: (-len(words), k) for k, (name, words, *_) in enumerate(ready)}
        for batch in common.slices(batches, 1024):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = scan(text, ready, min_coverage)
                best = min(found, key=lambda f: (-f[1], rank[f[0]], f[2]), default=(None, 0.0, None, None))
                out.append((doc, *best, len(found), ",".join(dict.fromkeys(f[0] for f in found))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "license", "coverage", "start", "end", "n_found", "found"]
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row a document: its best license (null if none), coverage, place, and all that were found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES, min_coverage), FOUND)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))
