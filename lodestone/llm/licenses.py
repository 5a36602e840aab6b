"""Licence scan: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and documents are read as lower-cased words. A template's word n-grams are hashed and
winnowed, the least hash of every window, into an inverted index of (fingerprint, template, place);
the windows guarantee that any ``GRAM + WINDOW - 1`` words in common share a fingerprint. A
document's n-grams are looked up in it; hits of one template that lie on about the same diagonal are
a candidate. The candidate's template is then aligned with the words around it, within ``BAND`` words
of the diagonal, or a quarter of the template if that is less, by the longest common subsequence, and reported with the share of the template that
is matched and the span of characters from the first to the last matched word, if that share is at
least ``COVERAGE``.

The index is as large as the templates, so it is broadcast; documents are read once, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import chunks, mix64, owner, text_of, tokens, utf8

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.7

#: Notices and opening passages of common licences.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-short": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "AGPL-3.0-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "LGPL-3.0-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "GPL-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-short": "Released under the BSD License.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "Proprietary-short": "All rights reserved.",
    "Proprietary": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lowered = data | ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    return tokens(lowered, offs)


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - n + 1 + j])
    return out


def winnow(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least value of each window, the last of equals; all values if there are fewer than a window."""
    if len(values) <= window:
        return np.array([len(values) - 1 - int(values[::-1].argmin())]) if len(values) else np.zeros(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(values, window)
    return np.unique(np.arange(len(seen)) + window - 1 - seen[:, ::-1].argmin(axis=1))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.hashes = list(templates), []
        keys, which, place = [], [], []
        for i, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), np.uint8)
            h = words(data, np.array([0, len(data)]))[2]
            self.hashes.append(h)
            g = grams(h)
            at = winnow(g)
            keys.append(g[at])
            which.append(np.full(len(at), i))
            place.append(at)
        keys, which, place = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((keys, np.uint64), (which, np.int64), (place, np.int64)))
        self.bands = np.array([max(1, min(BAND, len(h) // 4)) for h in self.hashes])
        order = np.argsort(keys, kind="stable")
        self.keys, self.which, self.place = keys[order], which[order], place[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def look_up(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in g, entry) of every fingerprint that occurs."""
        at = np.flatnonzero(self.maybe[(g >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, g[at], "left"), np.searchsorted(self.keys, g[at], "right")
        n = hi - lo
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.repeat(at, n), entry


def align(template: np.ndarray, texts: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the template matched in order, and the first and last matched place, for each row of texts.

    Column j + i of a row is compared with the template's word i for j = 0 .. 2 * band: the rows of
    texts begin ``band`` words before the diagonal. Longest common subsequence within the band; of
    equal lengths the latest start and then the earliest end, for the shortest span.
    """
    n, wide = len(texts), 2 * band + 1
    length = len(template)
    best = np.zeros((n, wide), np.int64)  # (matched, start) packed: more matches first, then the later start
    unit = np.int64(1) << 32
    end = np.full((n, wide), -1, np.int64)
    for i in range(length):
        # cell j stands for text place i + j: from the row before, the same place is j + 1 and the place before is j
        up, up_end = np.c_[best[:, 1:], np.zeros(n, np.int64)], np.c_[end[:, 1:], np.full(n, -1)]
        same = texts[:, i : i + wide] == template[i]
        place = i + np.arange(wide)
        started = best >= unit
        diagonal = np.where(same, best + unit + np.where(started, 0, place), -1)
        now, now_end = np.maximum(up, diagonal), np.where(diagonal > up, place, up_end)
        for j in range(1, wide):  # from the place before in this row
            left = now[:, j - 1] >= now[:, j]
            now[:, j] = np.where(left, now[:, j - 1], now[:, j])
            now_end[:, j] = np.where(left, now_end[:, j - 1], now_end[:, j])
        best, end = now, now_end
    top = best[:, -1]
    return top >> np.int64(32), top & (unit - 1), end[:, -1]


def candidates(index: Index, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, template, start place of the template in h) of each run of hits within the band of a diagonal."""
    at, entry = index.look_up(grams(h))
    ok = rows[at] == rows[at + GRAM - 1]
    at, entry = at[ok], entry[ok]
    row, which, start = rows[at], index.which[entry], at - index.place[entry]
    order = np.lexsort((start, which, row))
    row, which, start = row[order], which[order], start[order]
    if not len(row):
        return row, which, start
    band = index.bands[which]
    new = np.r_[True, (row[1:] != row[:-1]) | (which[1:] != which[:-1]) | (start[1:] - start[:-1] > band[1:])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    # a chain of near diagonals is cut where it has left the band of its first
    step = (start - start[first]) // (band + 1)
    new |= step != np.r_[-1, step[:-1]]
    return row[new], which[new], start[new]


def scan(index: Index, data: np.ndarray, offs: np.ndarray, coverage: float = COVERAGE) -> list[np.ndarray]:
    """Columns text, template, matched words, first and last byte of each match."""
    starts, ends, h = words(data, offs)
    rows = owner(offs, starts)
    row, which, start = candidates(index, h, rows)
    out = []
    seg = np.searchsorted(rows, np.arange(len(offs)))
    for t in np.unique(which):
        mine = np.flatnonzero(which == t)
        template, band = index.hashes[t], int(index.bands[t])
        for some in np.array_split(mine, -(-len(mine) * (len(template) + 2 * band) // 2_000_000)):
            place = start[some, None] - band + np.arange(len(template) + 2 * band)[None, :]
            lo, hi = seg[row[some]][:, None], seg[row[some] + 1][:, None]
            inside = (place >= lo) & (place < hi)
            texts = np.where(inside, h[place.clip(0, len(h) - 1)], np.uint64(0))
            matched, a, b = align(template, texts, band)
            good = matched >= max(1, coverage * len(template) - 1e-9)
            first, last = place[:, 0] + a, place[:, 0] + b
            out.append(np.stack([row[some], np.full(len(some), t), matched, starts[first.clip(0, len(h) - 1)], ends[last.clip(0, len(h) - 1)]])[:, good])
    if not out:
        return [np.zeros(0, np.int64)] * 5
    row, t, matched, lo, hi = np.concatenate(out, axis=1)
    # of overlapping matches the one of most words stays, then of most coverage, then the first
    share = matched / np.array([max(1, len(h)) for h in index.hashes])[t]
    order = np.lexsort((hi, lo, t, -share, -matched, row))
    keep, taken = [], {}
    for i in order:
        spans = taken.setdefault(row[i], [])
        if all(hi[i] <= x or lo[i] >= y for x, y in spans):
            spans.append((lo[i], hi[i]))
            keep.append(i)
    keep = np.array(keep, np.int64)
    keep = keep[np.lexsort((t[keep], lo[keep], row[keep]))]
    return [x[keep] for x in (row, t, matched, lo, hi)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, matched, start, end) of every match, by characters of the source text.

    Of overlapping matches the one of most words stays, of equals the one that covers more of its
    template, so that a passage has one licence. A template of fewer words than a fingerprint has is never found. Null
    and empty texts have no match. A null doc_id is reported as null, and equal rows as often as they
    occur. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    def run(batches):
        index = shared.value
        sizes = np.array([max(1, len(h)) for h in index.hashes])
        for b in batches:
            data, offs = utf8(b.column(1))
            for lo, _, part, cut in chunks(data, offs):
                row, t, matched, x, y = scan(index, part, cut, coverage)
                if len(row):
                    chars = np.r_[0, np.cumsum((part & 0xC0) != 0x80)]
                    base = chars[cut[row]]
                    cols = [b.column(0).take(pa.array(lo + row)), pa.array([index.names[i] for i in t]), pa.array(np.round(matched / sizes[t], 6)), pa.array(matched.astype(np.int32)), pa.array((chars[x] - base).astype(np.int32)), pa.array((chars[y] - base).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "license", "coverage", "matched", "start", "end"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return src.mapInArrow(run, "doc_id long, license string, coverage double, matched int, start int, end int")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan_licenses`` of all documents, with the defaults; its cases are stated there."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
