"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z folded: marks
around and inside them part words and say nothing. Shingles are five words; of templates
with fewer than ``SHORT`` words three (all, if fewer). For each number of shingles of a
template a text has overlapping windows, a stride apart and a stride longer than the
template, so every occurrence lies inside one. Windows and templates get ``BANDS`` bands of
``ROWS`` MinHash values; a template is retrieved if a band agrees. A window that holds 0.8
of a template's shingles has, by its length, a Jaccard similarity of at least 0.6 to it and
so collides with probability 1 - (1 - 0.6 ** ROWS) ** BANDS, above 0.999. A window that
holds no shingle of any template can't agree with one and isn't hashed. A retrieved
template is verified: at least 0.8 of its distinct shingles stand in the window.

Where a verified window's template begins follows from the places of its shingles, by
majority, ties to the first. Windows whose beginnings are less than half a template apart
show one notice, reported with the greatest containment; notices back to back are
reported each. A null or empty text has no windows. Repeated rows and ids are scanned each
for itself. Very long texts are scanned whole. An empty table gives no rows. Further
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from closeline.llm import texts

WORDS, FEW, SHORT = 5, 3, 10
BANDS = 20
ROWS = 2
CONTAINED = 0.8

_BYTES = np.arange(256)
_GAP = ~((_BYTES >= 128) | np.isin(_BYTES, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)))

# Notices as their publishers word them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "BSD redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "BSD-3-Clause third condition": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."),
    "LGPL notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    "MIT": "Released under the MIT License.",
    "MIT named": "Licensed under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}


def _stride(shingles: int) -> int:
    """Windows are this many less one longer than a template, and as far apart: at most a quarter of it."""
    return shingles // 4 + 1


def words(s: texts.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice and words per row."""
    starts, ends = texts.spans(s, _GAP)
    return texts.hashes(texts.FOLD[s.data], starts, ends), s.per_row(starts)


class Templates:
    """MinHash bands and shingles of the templates whose shingles have one number of words."""

    def __init__(self, templates: dict[str, str], length: int):
        self.length = length
        self.names, runs = [], []
        for name, text in templates.items():
            hashed, n = words(next(texts.slices(pa.array([text]))))
            if n[0] and (FEW if n[0] < SHORT else WORDS) == length:
                self.names.append(name)
                runs.append(texts.shingles(hashed, n, length)[0])
        self.a = texts.constants(31, BANDS * ROWS)
        found = [np.unique(run, return_index=True) for run in runs]
        self.sets, self.firsts = [x for x, _ in found], [at for _, at in found]
        self.any = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.sets]))
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.any >> np.uint64(48)).astype(np.int64)] = True
        self.sizes: dict[int, list[int]] = {}
        for i, x in enumerate(self.sets):
            self.sizes.setdefault(len(x), []).append(i)
        self.bands = [self.signature(x[None, :], np.ones((1, len(x)), bool))[0] for x in self.sets]

    def signature(self, windows: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Bands of each row of shingles; places that aren't there don't count."""
        out = np.zeros((len(windows), BANDS), np.uint64)
        for j in range(BANDS * ROWS):
            least = np.where(there, texts.mix(windows * self.a[j]), np.uint64(0xFFFFFFFFFFFFFFFF)).min(axis=1)
            out[:, j // ROWS] = texts.mix(out[:, j // ROWS] ^ least)
        return out

    def scan(self, found: np.ndarray, per: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(row, template, first word in the row, containment) in rows of shingles."""
        hit = np.flatnonzero(self.sieve[(found >> np.uint64(48)).astype(np.int64)])
        hit = hit[np.isin(found[hit], self.any)]
        base = np.cumsum(per) - per
        row = np.searchsorted(np.cumsum(per), hit, "right")
        out: list[tuple[int, int, int, float]] = []
        for size, members in self.sizes.items():
            stride = _stride(size)
            width = size + stride - 1
            # Windows start at multiples of the stride; those that cover a hit.
            last = (hit - base[row]) // stride
            pairs = {(r, k * stride) for r, z in zip(row.tolist(), last.tolist()) for k in range(max(0, z - width // stride), z + 1)}
            if not pairs:
                continue
            r, start = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
            at = start[:, None] + np.arange(width)
            there = at < per[r][:, None]
            windows = found[np.minimum(base[r][:, None] + at, len(found) - 1)]
            bands = self.signature(windows, there)
            for i in members:
                for w in np.flatnonzero((bands == self.bands[i]).any(axis=1)).tolist():
                    window = windows[w][there[w]]
                    at = np.minimum(np.searchsorted(self.sets[i], window), size - 1)
                    same = self.sets[i][at] == window
                    held = len(np.unique(at[same])) / size
                    if held >= CONTAINED:
                        begins, votes = np.unique(np.flatnonzero(same) + start[w] - self.firsts[i][at[same]], return_counts=True)
                        out.append((int(r[w]), i, int(begins[votes.argmax()]), float(held)))
        best: list[tuple[int, int, int, float]] = []
        for row_, i, begin, held in sorted(out):
            if best and best[-1][:2] == (row_, i) and 2 * (begin - best[-1][2]) < len(self.sets[i]):
                if held > best[-1][3]:
                    best[-1] = (row_, i, begin, held)
            else:
                best.append((row_, i, begin, held))
        return [(row_, i, max(0, begin), held) for row_, i, begin, held in best]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, first_word, containment): notices, by their first word, and how much of their template they hold."""
    chosen = TEMPLATES if templates is None else templates
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [x for x in (Templates(chosen, FEW), Templates(chosen, WORDS)) if x.names]
        for batch in batches:
            for s in texts.slices(batch.column(1)):
                hashed, n = words(s)
                rows = [(r, x.names[i], start, held) for x in known for r, i, start, held in x.scan(*texts.shingles(hashed, n, x.length))]
                if rows:
                    r, names, start, held = zip(*sorted(rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([s.first + x for x in r])), pa.array(names), pa.array(start, pa.int64()), pa.array(held)],
                        ["doc_id", "license", "first_word", "containment"])

    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, license string, first_word long, containment double")
