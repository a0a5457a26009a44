"""License scans: winnowed template fingerprints in an inverted index, then banded alignment of words.

Words are runs of letters and digits in lower case. Every GRAM words of a template are hashed and the least hash of
each WINDOW neighbours is kept; a text's hashes are winnowed alike, so a run of GRAM + WINDOW - 1 words in common is
always found. Hits near one diagonal are a candidate; a banded alignment of template and text there counts matched
words and gives the span. Reported are alignments that cover `coverage` of the template's words; a partial mention,
which covers less, takes nothing from a notice beside it.

Null and empty texts have no licenses, and a null id stays null; a document has a row for each place found, in order.
Of places that overlap, the one with the most matched words stays, of those the one that covers more of its template,
then the first, then the first license by name: so a notice isn't taken for a shorter sibling's. Rows that repeat are
scanned each, an empty table gives no rows, a text of any length is scanned whole. Other columns are not read, whatever
their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, packed_texts, rolling, text_slices, words_of

GRAM, WINDOW = 3, 2
#: Words by which an alignment may drift from its diagonal: at least so many, and this part of the template.
BAND, DRIFT = 6, 3
COVERAGE = 0.8

#: Notices by SPDX name (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

OUT = "doc_id long, license string, coverage double, n_matched long, start long, end long"
_MARKS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def _flat(text: bytes) -> bytes:
    """Lower case, with a space for each ASCII character that is no letter or digit; as long as before."""
    return text.lower().translate(_MARKS)


def _winnowed(hashes: np.ndarray) -> np.ndarray:
    """Positions of the least hash of each WINDOW neighbours."""
    if len(hashes) < WINDOW:
        return np.arange(len(hashes))
    view = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(view)) + view.argmin(axis=1))


def align(a: list, b: list, shift: int, band: int) -> tuple[int, int, int]:
    """Longest common subsequence of template a and text b near the diagonal b = a + shift: (matched, first, end) in b."""
    before: dict[int, tuple[int, int, int]] = {}
    best = (0, 0, 0)
    for i, x in enumerate(a):
        now: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(b), i + shift + band + 1)):
            top = max(before.get(j, (0, 0, 0)), now.get(j - 1, (0, 0, 0)), key=lambda c: (c[0], c[1]))
            if x == b[j]:
                n, first, _ = before.get(j - 1, (0, j, j))
                top = max(top, (n + 1, first if n else j, j + 1), key=lambda c: (c[0], c[1]))
            now[j] = top
            if top[0] > best[0] or top[0] == best[0] and top[2] - top[1] < best[2] - best[1]:
                best = top
        before = now
    return best


def places(a: list, words: list, shifts: set[int], coverage: float) -> list[tuple[int, int, int]]:
    """(matched, first, end) in words of alignments of template a that cover `coverage`, none overlapping another.

    Where alignments overlap, the one with the most matched words stays and another is aligned anew beside it.
    """
    need, ends, taken, band = Counter(a), [], [], max(BAND, len(a) // DRIFT)
    queue: list[tuple] = []

    def put(shift: int, lo: int, hi: int) -> None:
        part = words[lo:hi]
        # no alignment matches more words than the two have in common
        if sum(min(n, need[w]) for w, n in Counter(part).items() if w in need) < coverage * len(a):
            return
        n, i, j = align(a, part, shift - lo, band)
        if n and n / len(a) >= coverage:
            heapq.heappush(queue, (-n, j - i, lo + i, lo + j, shift, lo, hi))

    for shift in shifts:
        put(shift, max(0, shift - band), min(len(words), shift + len(a) + band))
    while queue:
        n, _, i, j, shift, lo, hi = heapq.heappop(queue)
        # the first place that ends after this one begins
        at = bisect.bisect_right(ends, i)
        if at == len(taken) or taken[at][1] >= j:
            ends.insert(at, j)
            taken.insert(at, (-n, i, j))
        else:
            if lo < taken[at][1]:
                put(shift, lo, taken[at][1])
            if taken[at][2] < hi:
                put(shift, taken[at][2], hi)
    return taken


class Index:
    """The templates' winnowed fingerprints to (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [_WORD.findall(_flat(templates[n].encode())) for n in self.names]
        self.at: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            buf, bounds = packed_texts([b" ".join(words)])
            h = rolling(words_of(buf, bounds)[2], GRAM)
            for p in _winnowed(h).tolist():
                self.at.setdefault(int(h[p]), []).append((t, p))
        self.known = np.array(sorted(self.at), np.uint64)

    def batch(self, texts: list[bytes], coverage: float = COVERAGE) -> list[list[tuple[int, int, float, int, int]]]:
        """Per text (template, matched words, share, start byte, end byte) of alignments that cover `coverage`."""
        flat = [_flat(t) for t in texts]
        buf, bounds = packed_texts(flat)
        starts, ends, hashes, first = words_of(buf, bounds)
        grams = rolling(hashes, GRAM)
        # a gram across two texts is never looked up
        row = np.searchsorted(first, np.arange(len(grams)), side="right") - 1
        inside = np.arange(len(grams)) + GRAM <= first[row + 1] if len(grams) else np.zeros(0, bool)
        hits = np.flatnonzero(np.isin(grams, self.known) & inside)
        out: list[list] = [[] for _ in texts]
        for k in np.unique(row[hits]).tolist():
            lo, hi = int(first[k]), int(first[k + 1])
            mine = hits[row[hits] == k]
            # the same choice that the templates' fingerprints went through, over the whole text
            chosen = set((_winnowed(grams[lo : max(lo, hi - GRAM + 1)]) + lo).tolist())
            spots: dict[int, list[tuple[int, int]]] = {}
            for p in mine.tolist():
                for t, q in self.at[int(grams[p])]:
                    if p in chosen or hi - lo < GRAM + WINDOW - 1 or len(self.words[t]) < GRAM + WINDOW:
                        spots.setdefault(t, []).append((p - lo, p - lo - q))
            words = [flat[k][a - bounds[k] : b - bounds[k]] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
            for t, found in spots.items():
                a = self.words[t]
                for n, i, j in places(a, words, {shift for _, shift in found}, coverage):
                    out[k].append((t, n, n / len(a), int(starts[lo + i] - bounds[k]), int(ends[lo + j - 1] - bounds[k])))
        return [_foremost(found) for found in out]


def _foremost(found: list) -> list:
    """The places that no overlapping place of another template surpasses in matched words, nor equals with more cover."""
    kept: list = []
    for x in sorted(found, key=lambda f: (-f[1], -f[2], f[3], f[0])):
        if all(x[3] >= y[4] or y[3] >= x[4] for y in kept):
            kept.append(x)
    return kept


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """OUT: one row per place where a template is covered."""
    index = Index(TEMPLATES if templates is None else templates)

    def run(it):
        for ids, texts in text_slices(it, 1 << 20):
            texts = [t or b"" for t in texts]
            rows = []
            for doc, text, found in zip(ids, texts, index.batch(texts, coverage)):
                for t, n, share, a, b in sorted(found, key=lambda f: (f[3], f[0])):
                    rows.append((doc, index.names[t], share, n, len(text[:a].decode()), len(text[:b].decode())))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "coverage", "n_matched", "start", "end"])

    return id_text(docs).mapInArrow(run, OUT)


def op4(spark, sf_dir):
    from .common import table

    return scan_licenses(table(spark, sf_dir, "documents"))
