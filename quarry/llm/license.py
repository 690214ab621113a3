"""License scans: MinHash over overlapping windows retrieves templates, exact shingle containment verifies them.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased; shingles take five words. Templates of up to 16 words are sought in
windows of their own length at every word; longer ones, in classes by powers of two, in windows of one and a quarter times the class's
greatest length at every quarter of its least. Windows start and end with their text, whatever texts stand beside it. Each of 32 hash functions is a band of one row: a window that holds three quarters of a
template has a Jaccard similarity of at least 0.3 to it, so all 32 minima differ with probability below 0.7**32 = 1e-5. A retrieved
template is found where at least `percent` % of its distinct shingles stand in the window. Of licenses whose templates are half the same
(the versions of a family), only the ones with the largest share count in one place.

Templates are a parameter of bounded size, of five words at least each. A null or empty text has no match; very long texts are scanned
whole; of equally good windows of a license the first counts. Each text is judged alone, so repeated rows are judged alike; other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, slices
from .kernel import ALNUM, Words, member, mix

SHINGLE, HASHES, SHORT = 5, 32, 16
_U = np.uint64

#: Public license texts, notices and declarations.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_GPL = (
    "This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
)
_BSD_BINARY = " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", _GPL.format(colon=":", name="Affero General Public License", v=3)],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [_BSD + _BSD_BINARY + _BSD_END],
    "BSD-3-Clause": [_BSD, _BSD + _BSD_BINARY + _BSD_NAMES + _BSD_END],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2", _GPL.format(colon=";", name="General Public License", v=2)],
    "GPL-3.0": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        _GPL.format(colon=":", name="General Public License", v=3),
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "LGPL-2.1": [
        "licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3", _GPL.format(colon=":", name="Lesser General Public License", v=3)],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ],
}


class Templates:
    """Shingle sets of the templates and, for each class of window, the minima under each hash function."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names, self.sets, by_class = [], [], {}
        for name, variants in texts.items():
            for text in variants:
                raw = text.encode()
                w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM, lower=True)
                n = len(w.start)
                if n < SHINGLE:
                    raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
                low = n if n <= SHORT else 1 << (n.bit_length() - 1)
                kind = (n, 1) if n <= SHORT else ((2 * low) * 5 // 4, low // 4)
                by_class.setdefault(kind, []).append(len(self.names))
                self.names.append(name)
                self.sets.append(np.unique(w.grams(SHINGLE)[0]))
        #: template -> those of other licenses that hold half of its shingles
        self.kin = [{j for j, s in enumerate(self.sets) if self.names[j] != self.names[k] and 2 * len(np.intersect1d(s, own)) >= len(own)} for k, own in enumerate(self.sets)]
        #: (window in words, stride) -> for each band the sorted minima and their templates, in which windows are looked up
        self.classes = {}
        for kind, own in by_class.items():
            bands = []
            for seed in range(HASHES):
                low = np.array([(self.sets[t] * _ODD[seed] + _SEEDS[seed]).min() for t in own])
                o = np.argsort(low, kind="stable")
                table = np.zeros(1 << 16, bool)
                table[low & _U(0xFFFF)] = True
                bands.append((low[o], np.array(own)[o], table))
            self.classes[kind] = bands


#: Hash function k takes the shingles' hashes, which are mixed, times an odd number plus another.
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
_ODD = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) | _U(1)
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of width consecutive values at every start."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out, np.concatenate([out[step:], np.full(min(step, len(out)), _NONE, np.uint64)]))
        done += step
    return out


def _scan(t: Templates, w: Words, percent: int) -> list[list[tuple[str, float, int, int]]]:
    """For each text of a slice: (license, containment, first word, words) of the best window of each license found."""
    best: list[dict] = [{} for _ in range(len(w.first) - 1)]
    count = np.maximum(w.counts() - SHINGLE + 1, 0)  # shingles of each text
    live = np.flatnonzero(count)
    if not len(live):
        return [[] for _ in best]
    # the shingles of each text, then SHORT empty places, which are blocks of their own at every stride: a window has at most ten blocks
    # or twelve single shingles, so none reaches the next text
    g, count, first = w.grams(SHINGLE)[0], count[live], w.first[live]
    at = np.concatenate([[0], np.cumsum(count + SHORT)])
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(at[:-1], count) + within
    laid, empty = np.zeros(at[-1], np.uint64), np.ones(at[-1], bool)
    laid[place], empty[place] = g[np.repeat(first, count) + within], False
    blocks = {}  # stride -> starts of the blocks, counted from each text's first shingle
    for _, stride in t.classes:
        start = empty.copy()
        start[place[within % stride == 0]] = True
        blocks[stride] = np.flatnonzero(start)
    found: dict[tuple[int, int], set] = {}
    for h in range(HASHES):
        x = laid * _ODD[h] + _SEEDS[h]
        x[empty] = _NONE
        lows = {stride: np.minimum.reduceat(x, start) if stride > 1 else x for stride, start in blocks.items()}
        for (width, stride), bands in t.classes.items():
            m, (low, own, table) = _window_minima(lows[stride], -(-(width - SHINGLE + 1) // stride)), bands[h]
            p = np.flatnonzero(table[m & _U(0xFFFF)])  # by their last bits first
            p = p[member(m[p], low)]
            a, e = np.searchsorted(low, m[p]), np.searchsorted(low, m[p], "right")  # templates with equal minima stand side by side
            for q, x, y in zip(blocks[stride][p].tolist(), a.tolist(), e.tolist(), strict=True):
                for k in own[x:y].tolist():
                    found.setdefault((k, width), set()).add(q)
    for (k, width), starts in found.items():
        for s in starts:
            if empty[s]:
                continue
            j = int(np.searchsorted(at, s, side="right")) - 1
            a = int(first[j] + s - at[j])
            b = int(min(a + width, w.first[live[j] + 1]))
            own, into = np.unique(g[a : b - SHINGLE + 1]), best[live[j]]
            share = len(np.intersect1d(own, t.sets[k], assume_unique=True)) / len(t.sets[k])
            now = (share, -int(a - first[j]), b - a, -k)
            if 100 * share >= percent and now > into.get(t.names[k], (0.0,)):
                into[t.names[k]] = now
    return [_unlike(t, {name: (share, -start, n, -k) for name, (share, start, n, k) in d.items()}) for d in best]


def _unlike(t: Templates, found: dict) -> list[tuple[str, float, int, int]]:
    """The licenses found, by name, but for those of which a look-alike is found in the same place with more of its shingles."""

    def beaten(share, start, n, k):
        return any(s > share and x in t.kin[k] and a < start + n and start < a + m for s, a, m, x in found.values())

    return [(name, *m[:3]) for name, m in sorted(found.items()) if not beaten(*m)]


def licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, percent: int = 75) -> DataFrame:
    """doc_id and matches: array of (license, containment, first_word, n_words), one for each license found, by name."""
    table = Templates(templates or TEMPLATES)

    def scan(column):
        out = [r for _, _, buf, off in slices(column) for r in _scan(table, Words(buf, off, ALNUM, lower=True), percent)]
        kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        return [pa.array([[dict(zip(("license", "containment", "first_word", "n_words"), m, strict=True)) for m in r] for r in out], kind)]

    return map_text(docs.select("doc_id", "text"), scan, "matches array<struct<license:string,containment:double,first_word:bigint,n_words:bigint>>")
