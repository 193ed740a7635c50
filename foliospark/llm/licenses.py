"""License scans by patience alignment of whole texts with license templates.

Coverage is the share of the template's words that the text holds in the template's order,
with any number of other words between; a text holds a license if it covers `threshold`
of it. first_word and last_word say how far the words lie apart.

Words that occur once in a window of the text and once in the template are anchors; the
longest increasing subsequence of their places is kept, and the gaps between are aligned
in the same way, after their equal heads and tails. A gap without anchors is aligned by
longest common subsequence. The windows lie around the places of the template's words that
are rarest in the text; one that holds the whole template settles the text. All else is
settled by the longest common subsequence of the template and the whole text, computed on bit
vectors, since words may be inserted at any length and anchors may mislead: of the parts of
the text that cover most, the one that ends first, without what it can spare at its head.

Before that a text is passed over if even all of its words, in any order, could not cover
enough. So long texts without a license cost one vectorised pass.

Null, empty and wordless texts hold no license. Rows with null doc_id are scanned like
others. Repeated rows give repeated results; extra columns make no difference, and their names may clash.
Of parts of a text that cover alike the one that ends first counts. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.runtime import map_arrow, only
from foliospark.llm.textops import U, Words, blocks, utf8

SCHEMA = "doc_id long, license string, coverage double, matched_words int, first_word int, last_word int"

TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
}

def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
        back.append(at[pile - 1] if pile else -1)
    out: list[int] = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def bit_rows(a: Iterable[int], b: list[int]) -> Iterator[int]:
    """For each prefix of a: bit j is 0 where b[: j + 1] has a longer common subsequence with it than b[:j]."""
    full = (1 << len(b)) - 1
    at: dict[int, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    row = full
    for w in a:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def common_subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    rows = [(1 << len(b)) - 1, *bit_rows(a, b)]
    i, j = len(a), len(b)
    out = []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def most_covering(words: list[int], template: list[int]) -> tuple[int, int, int]:
    """(matched, first, last) of the longest common subsequence: the first to end, and of those the last to begin; matched 0 if none."""
    size = len(template)
    most, last = 0, -1
    for k, row in enumerate(bit_rows(words, template)):
        if size - row.bit_count() > most:
            most, last = size - row.bit_count(), k
    for k, row in enumerate(bit_rows(reversed(words[: last + 1]), template[::-1])):
        if size - row.bit_count() == most:
            return most, last - k, last
    return 0, -1, -1


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), rising in both."""
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
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w for w, n in in_b.items() if n == 1 and in_a.get(w) == 1}
        if not once:
            out += [(a0 + i, b0 + j) for i, j in common_subsequence(a[a0:a1], b[b0:b1])]
            continue
        place = {b[j]: j for j in range(b0, b1) if b[j] in once}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if a[i] in once]
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        out += kept
        ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:]) if r > p + 1 and s > q + 1]
    return sorted(out)


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), 0, 1).hashes


def best_window(words: np.ndarray, template: list[int], threshold: float, stretch: float = 1.25, spare: int = 3) -> tuple[int, int, int] | None:
    """(matched, first, last) of the part of the text that covers most; None if under the threshold."""
    size = len(template)
    needed = ceil(threshold * size - 1e-9)
    places = {w: np.flatnonzero(words == np.uint64(w)) for w in set(template)}
    held = np.sort(np.concatenate(list(places.values())))
    order = sorted(range(size), key=lambda q: (len(places[template[q]]), q))[: size - needed + 1]
    spans = set()
    for q in order:
        for p in places[template[q]].tolist():
            spans.add((max(0, p - ceil(q * stretch) - spare), min(len(words), p + ceil((size - q) * stretch) + spare)))
    for lo, hi in sorted(spans):
        if np.searchsorted(held, hi) - np.searchsorted(held, lo) < size:
            continue
        found = patience(words[lo:hi].tolist(), template)
        if len(found) == size:
            return size, lo + found[0][0], lo + found[-1][0]
    most, first, last = most_covering(words[held].tolist(), template)
    return (most, int(held[first]), int(held[last])) if most >= needed else None


def scan(df: DataFrame, threshold: float = 0.8, templates: dict[str, str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each text and license that it holds: coverage, words matched, and the places of the first and last, in words."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    names = sorted(templates or TEMPLATES)
    lists = [words_of((templates or TEMPLATES)[n]).tolist() for n in names]
    if not all(lists):
        raise ValueError("a template has no words")
    vocabulary = np.array(sorted({w for ws in lists for w in ws}), U)
    counts = np.array([[ws.count(int(v)) for v in vocabulary] for ws in lists])
    needed = np.array([ceil(threshold * len(ws) - 1e-9) for ws in lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.full(1 << 16, -1, np.int32)  # by the top 16 bits; words that share them go on in the sorted vocabulary
        for k in range(len(vocabulary) - 1, -1, -1):
            first[int(vocabulary[k]) >> 48] = k
        more = int(np.bincount((vocabulary >> U(48)).astype(np.int64)).max())
        for batch in batches:
            data, offsets, _ = utf8(batch.column(1))
            out = []
            for i, j in blocks(offsets):
                words = Words(data, offsets, i, j)
                at = first[(words.hashes >> U(48)).astype(np.int64)]
                word = np.full(len(at), -1)
                maybe = np.flatnonzero(at >= 0)
                for step in range(more):
                    k = np.minimum(at[maybe] + step, len(vocabulary) - 1)
                    same = vocabulary[k] == words.hashes[maybe]
                    word[maybe[same]] = k[same]
                known = np.flatnonzero(word >= 0)
                doc = np.searchsorted(words.bounds, known, "right") - 1
                seen = np.bincount(doc * len(vocabulary) + word[known], minlength=(j - i) * len(vocabulary)).reshape(j - i, -1)
                for t, name in enumerate(names):
                    for r in np.flatnonzero(np.minimum(seen, counts[t]).sum(axis=1) >= needed[t]):
                        found = best_window(words.hashes[words.bounds[r] : words.bounds[r + 1]], lists[t], threshold)
                        if found:
                            out.append((i + int(r), name, found[0] / len(lists[t]), *found))
            if out:
                row, name, share, matched, lo, hi = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()).take(pa.array(row)), pa.array(name), pa.array(share), pa.array(matched, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                    ["doc_id", "license", "coverage", "matched_words", "first_word", "last_word"],
                )

    return map_arrow(only(df, key=key, text=text).select(F.col("key").cast("long"), "text"), run, SCHEMA)
