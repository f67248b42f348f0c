"""License scans by patience alignment of notices and license texts against whole documents.

Words that are unique in both the template and the text are anchors; the longest increasing run of them is aligned, and
the gaps between anchors are aligned in the same way. Coverage is the share of the template's words that are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, find_words, row_blocks, word_hashes

#: Share of a template's words that must be aligned.
MIN_COVERAGE = 0.8

# Notices and license texts (public texts), and words too common to propose a place.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"] + (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")
TEMPLATES["BSD-4-Clause"] = TEMPLATES["BSD-2-Clause"] + (
    " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder."
    " 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")
TEMPLATES |= {
    "GPL-3.0-only-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-only-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
}
#: What tells a license from its neighbours: these runs of a template's words must be aligned without a gap.
REQUIRED = {
    "MIT-notice": ["MIT License"], "Apache-2.0-notice": ["Apache License", "2.0"], "GPL-3.0-notice": ["GNU General Public License", "version 3"],
    "CC-BY-NC-4.0-notice": ["CC BY-NC 4.0"], "CC-BY-4.0-notice": ["Creative Commons Attribution 4.0"], "BSD-3-Clause": ["endorse or promote products"],
    "Apache-2.0-header": ["Apache License"], "GPL-3.0-header": ["GNU General Public License", "version 3", "any later version"], "MPL-2.0-header": ["Mozilla Public License"],
    "BSD-4-Clause": ["All advertising materials mentioning", "endorse or promote products"], "GPL-3.0-only-header": ["GNU General Public License", "Free Software Foundation, version 3"],
    "GPL-2.0-header": ["GNU General Public License", "either version 2 of", "any later version"], "GPL-2.0-only-header": ["GNU General Public License version 2 as"],
    "LGPL-3.0-header": ["GNU Lesser General Public License", "version 3", "any later version"], "LGPL-2.1-header": ["GNU Lesser General Public License", "version 2.1", "any later version"],
    "CC-BY-SA-4.0-notice": ["Attribution-ShareAlike 4.0"], "CC0-1.0-notice": ["waived all copyright and related or neighboring rights"],
}
COMMON = "a an and are as at be by for from in is it of on or that the this to was were with you".split()

# Words are runs of ASCII letters, ASCII digits and bytes beyond ASCII.
PARTING = np.ones(256, bool)
PARTING[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def split_words(text: str) -> list[int]:
    """Hashes of the words of a text, lower-cased in A-Z."""
    data = LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    words = find_words(data, np.array([0, len(data)]), PARTING)
    return word_hashes(words).tolist()


def longest_rise(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(template: list[int], text: list[int]) -> list[tuple[int, int]]:
    """Aligned pairs (place in the template, place in the text), rising in both. Gaps wait on a stack, not in calls."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(template), 0, len(text))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(template[a:b]).items() if n == 1} & {w for w, n in Counter(text[c:d]).items() if n == 1}
        if not once:
            continue
        place = {w: j for j, w in enumerate(text[c:d], c) if w in once}
        anchors = [(i, place[w]) for i, w in enumerate(template[a:b], a) if w in once]
        anchors = [anchors[k] for k in longest_rise([j for _, j in anchors])]
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class _Template:
    def __init__(self, text: str, common: set[int], min_coverage: float, required: list[str] = []):  # noqa: B006
        self.words = split_words(text)
        runs = [split_words(x) for x in required]
        firsts = [(next((i for i in range(len(self.words)) if self.words[i:i + len(r)] == r), None), len(r)) for r in runs]
        self.runs = [(i, n) for i, n in firsts if i is not None]
        counts = Counter(self.words)
        self.place = {w: i for i, w in enumerate(self.words) if counts[w] == 1 and w not in common}
        n = len(self.words)
        self.needed = n - int(n * (1 - min_coverage) + 1e-9)
        # Of the seeds no more can be missing than words in all.
        self.least = max(1, len(self.place) - (n - self.needed))
        self.slack = max(4, n // 2)

    def named(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether all required runs are aligned without a gap."""
        at = dict(pairs)
        return all(i in at and all(at.get(i + k) == at[i] + k for k in range(n)) for i, n in self.runs)


def _places(found: list[tuple[int, int]], template: _Template) -> Iterator[tuple[int, int]]:
    """Regions that hold enough seeds: (place, word) of the text's seeds in order, those of one region start close together."""
    starts = sorted((at - template.place[w], w) for at, w in found)
    i = 0
    low = 0
    counts: Counter[int] = Counter()
    ready: tuple[int, int] | None = None
    for i, (s, w) in enumerate(starts):
        counts[w] += 1
        while starts[low][0] < s - template.slack:
            counts[starts[low][1]] -= 1
            if not counts[starts[low][1]]:
                del counts[starts[low][1]]
            low += 1
        if len(counts) >= template.least:
            a, b = starts[low][0] - template.slack, s + len(template.words) + template.slack
            if ready and starts[low][0] <= ready[1] - len(template.words) - template.slack:
                ready = (ready[0], b)
            else:
                if ready:
                    yield ready
                ready = (a, b)
    if ready:
        yield ready


def scan_words(words: list[int], seeds: list[tuple[int, int]], templates: list[tuple[str, _Template]], min_coverage: float) -> list[tuple[str, int, int, int, int]]:
    """(template, aligned words, template's words, first word, end word), non-overlapping: more aligned words win."""
    found = []
    for name, t in templates:
        mine = [(at, w) for at, w in seeds if w in t.place]
        if len({w for _, w in mine}) < t.least:
            continue
        for a, b in _places(mine, t):
            a = max(0, a)
            # A region with repeated notices is taken apart: what was aligned is cut off and the rest aligned again.
            rest = [(a, min(len(words), b))]
            while rest:
                lo, hi = rest.pop()
                pairs = align(t.words, words[lo:hi])
                if len(pairs) < t.needed or pairs[-1][1] - pairs[0][1] >= 2 * len(t.words) or not t.named(pairs):
                    # Words that the region repeats are no anchors; narrower windows hold them once, and no wide alignment.
                    if hi - lo > len(t.words) + t.slack:
                        step = max(1, len(t.words) // 2)
                        rest += [(x, min(hi, x + len(t.words) + t.slack // 2)) for x in range(lo, hi - t.needed + 1, step) if min(hi, x + len(t.words) + t.slack // 2) - x < hi - lo]
                    continue
                first, end = lo + pairs[0][1], lo + pairs[-1][1] + 1
                found.append((name, len(pairs), len(t.words), first, end))
                rest += [(x, y) for x, y in ((lo, first), (end, hi)) if y - x >= t.needed]
    kept: list[tuple[str, int, int, int, int]] = []
    for f in sorted(set(found), key=lambda f: (-f[1], f[1] - f[2], f[3], f[0])):
        if all(f[4] <= k[3] or f[3] >= k[4] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[3])


def _scan(templates: dict[str, str], min_coverage: float):
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_aligned", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = set(split_words(" ".join(COMMON)))
        known = [(name, _Template(text, common, min_coverage, REQUIRED.get(name, []))) for name, text in templates.items()]
        keys = np.sort(np.array(sorted({w for _, t in known for w in t.place}), np.uint64))
        if not len(keys):
            return
        for batch in batches:
            for part, data, offsets in row_blocks(batch, "text"):
                words = find_words(LOWER[data], offsets, PARTING)
                hashes = word_hashes(words)
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == hashes)
                if not len(hit):
                    continue
                rows = np.searchsorted(words.first, hit, side="right") - 1
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                out, ids = [], part.column(0).to_pylist()
                for row in np.unique(rows):
                    a, b = int(words.first[row]), int(words.first[row + 1])
                    mine = hit[rows == row]
                    base = points[offsets[row]]
                    for name, n, of, first, end in scan_words(hashes[a:b].tolist(), [(int(k) - a, int(hashes[k])) for k in mine], known, min_coverage):
                        out.append((ids[row], name, n / of, n, int(points[words.starts[a + first]] - base), int(points[words.ends[a + end - 1]] - base)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_aligned, start, end (code points) of each license notice or text found in ``docs``.

    A place is looked at if it holds so many of a template's rarer words that ``min_coverage`` can be reached at all, and
    reported if that share of the template's words is aligned, with the words of ``REQUIRED`` in one run each. Of overlapping finds the one with more aligned words stays.

    Cases: NULL and empty texts hold nothing; a notice that a document repeats is reported each time; repeated rows are
    reported for each row; NULL ids are reported as such; templates without words are never found; an empty table gives
    no rows. Other columns are not looked at. One pass over whole texts, no shuffle.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_scan(TEMPLATES if templates is None else templates, min_coverage), "doc_id long, license string, coverage double, n_aligned long, start long, end long")
