"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Texts are cut into words (runs of ASCII letters, digits and non-ASCII bytes, lower-cased) and five-word
shingles. A template of n shingles belongs to the window class W, the least power of two not below n;
windows of 2W shingles start at every multiple of W, so some window holds any whole occurrence. Such a
window has Jaccard similarity of at least 0.8n / (2W + 0.2n) > 0.19 with a template that it contains to
0.8, and one of BANDS bands of one MinHash each then meets with probability 1 - 0.81**64 > 0.999998
(for the one-shingle class, 1 - 0.5**64). Every window that meets in a band is verified: the exact
share of the template's five-word shingles found from W before the window to W behind it, where words
inserted into a license may push its rest, must reach CONTAINMENT.

Templates are a parameter, TEMPLATES by default (short notices, headers and texts); those of under five words are one shingle.

Defined cases: null, empty and shorter texts match nothing; of several windows that match a template
the best counts, ties the first; repeated rows repeat their matches; a long text is hashed run by run of
whole words and searched in overlapping runs of windows; an empty table, or no template, gives an empty
result. Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, mix, pieces, powers, quoted, run_hashes, text_blocks, word_bounds

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
BANDS = 64
RUN_WORDS = 1 << 15

#: Notices and license texts by SPDX name, one per form that is looked for.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
OUTSIDE = np.ones(256, dtype=bool)
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    OUTSIDE[_low : _high + 1] = False
_random = np.random.default_rng(11)
FACTORS = _random.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)
STEP = 0xD6E8FEB86659FD93


def words(text: bytes) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k, factor in enumerate(powers(STEP, width)):
        out += hashes[k : k + len(out)] * factor
    return mix(out)


class Matcher:
    """The templates' shingles, and for each window class the MinHash values that retrieve them."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT) -> None:
        self.containment = containment
        self.names, self.shingles, self.width = [], [], []
        self.classes: dict[tuple[int, int], list[tuple[dict, np.ndarray]]] = {}
        found: dict[tuple[int, int], list[list[dict]]] = {}
        for name, text in sorted(templates.items()):
            own = words(text.encode())
            if not own:
                continue
            width = min(SHINGLE_WORDS, len(own))
            data = b" ".join(own)
            hashed = shingle_hashes(run_hashes(np.frombuffer(data, np.uint8), *word_bounds(np.frombuffer(data, np.uint8))), width)
            window = 1 << max(len(hashed) - 1, 0).bit_length()
            for band in range(BANDS):
                low = int(((hashed * FACTORS[band] + OFFSETS[band]) >> np.uint64(32)).min())
                found.setdefault((width, window), [{} for _ in range(BANDS)])[band].setdefault(low, []).append(len(self.names))
            self.names.append(name)
            self.width.append(width)
            self.shingles.append({tuple(own[k : k + width]) for k in range(len(own) - width + 1)})
        for key, bands in found.items():
            self.classes[key] = []
            for values in bands:
                flags = np.zeros(1 << 16, dtype=bool)
                flags[np.array(list(values), dtype=np.int64) >> 16] = True
                self.classes[key].append((values, flags))

    def candidates(self, hashes: np.ndarray, heads: np.ndarray, width: int) -> set[tuple[int, int, int, int]]:
        """(text, template, first shingle, end) of the windows that meet a template in a band. ``heads``: where each text's words start."""
        classes = {w: bands for (k, w), bands in self.classes.items() if k == width}
        shingles = shingle_hashes(hashes, width)
        count = np.maximum(np.diff(heads) - width + 1, 0)
        if not classes or not count.sum():
            return set()
        text = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        shingles = shingles[heads[:-1][text] + inside]
        out: set[tuple[int, int, int, int]] = set()
        base = {}
        for window in classes:
            first = np.flatnonzero(inside % window == 0)
            last = np.r_[text[first][1:] == text[first][:-1], False]
            base[window] = first, np.flatnonzero(last)
        for band in range(BANDS):
            values = ((shingles * FACTORS[band] + OFFSETS[band]) >> np.uint64(32)).astype(np.uint32)
            for window, bands in classes.items():
                first, paired = base[window]
                lows = np.minimum.reduceat(values, first) if window > 1 else values.copy()
                merged = lows.copy()
                merged[paired] = np.minimum(lows[paired], lows[paired + 1])
                wanted, flags = bands[band]
                for k in np.flatnonzero(flags[merged >> 16]):
                    for template in wanted.get(int(merged[k]), ()):
                        at = int(inside[first[k]])
                        out.add((int(text[first[k]]), template, at, at + 2 * window))
        return out

    def scan(self, texts: list[bytes]) -> list[tuple[int, str, float, int, int]]:
        """(text number, template, containment, first word, end word) of each text's best match of a template."""
        starts, ends, hashes, done = [], [], [], 0
        for run in [joined(texts)[0]] if len(texts) != 1 else pieces(texts[0]):
            buf = LOWER[np.frombuffer(run, dtype=np.uint8)]
            first, last = word_bounds(buf, OUTSIDE)
            hashes.append(run_hashes(buf, first, last))
            starts.append(first + done)
            ends.append(last + done)
            done += len(run)
        first, last, hashed = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        bounds = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        heads = np.searchsorted(first, bounds)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for width in sorted({k for k, _ in self.classes}):
            for text, template, at, end in sorted(self.windows(hashed, heads, width)):
                low, high = max(0, at - (end - at) // 2), min(end + (end - at) // 2 + width - 1, int(heads[text + 1] - heads[text]))
                own = [texts[text][a:b].lower() for a, b in zip((first[heads[text] + low : heads[text] + high] - bounds[text]).tolist(), (last[heads[text] + low : heads[text] + high] - bounds[text]).tolist(), strict=True)]
                where = [k for k in range(len(own) - width + 1) if tuple(own[k : k + width]) in self.shingles[template]]
                share = len({tuple(own[k : k + width]) for k in where}) / len(self.shingles[template])
                if share >= self.containment and share > best.get((text, template), (0.0,))[0]:
                    best[text, template] = share, low + where[0], low + where[-1] + width
        return [(text, self.names[template], *match) for (text, template), match in sorted(best.items())]

    def windows(self, hashes: np.ndarray, heads: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
        """The candidates of several texts at once, or of one in runs of RUN_WORDS that overlap by the widest window."""
        widest = max(w for _, w in self.classes)
        step = max(RUN_WORDS, widest)  # all are powers of two, so windows start at the same words
        if len(heads) != 2 or len(hashes) <= step:
            yield from self.candidates(hashes, heads, width)
            return
        for first in range(0, len(hashes), step):
            run = hashes[first : first + step + 2 * widest + width]
            for text, template, at, end in self.candidates(run, np.array([0, len(run)]), width):
                if at < step:
                    yield text, template, first + at, first + end


def license_matches(df: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment, first_word and end_word of every template found in every whole text."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, containment)
        for batch in batches:
            rows = [(at + r[0], *r[1:]) for at, _, texts in text_blocks(batch.column(1)) for r in matcher.scan(texts)]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], ["doc_id", "license", "containment", "first_word", "end_word"])

    narrow = df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, license string, containment double, first_word long, end_word long")
