"""License texts inside documents, by patience alignment against templates.

Words that are unique to both a template and a stretch of text are anchors; the longest
increasing run of anchors fixes the alignment and the gaps between them are aligned the same way.
Coverage is the share of a template's words that the alignment meets.

Each text is read in stretches of SPAN template lengths, laid every template length, so that any
occurrence as dense as MIN_DENSITY lies whole in one of them.  A stretch is aligned if it holds
enough of the template's words, each counted as often as the template has it: no alignment can
match more.  Where a stretch holds several copies, which leaves no word unique, the text from each
of the template's first words on is aligned by itself.  Of places that overlap the best one stays.

Defined results: null or wordless text holds no license; of equal coverages the longer template
wins, then the earlier place; every row stands alone, repeated rows repeat the result; a very long
text is read whole, shorter ones together by the chunk; an empty table gives an empty one;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _text as tx

MIN_COVERAGE = 0.8
#: Share of the words of the aligned stretch that must be the template's.
MIN_DENSITY = 0.6
#: Template lengths that a stretch needs to hold any occurrence so dense, wherever it begins.
SPAN = 1 + ceil(1 / MIN_DENSITY)
GAPS = tx.SPACE.copy()
GAPS[[b for b in range(128) if not chr(b).isalnum()]] = True

# Public notices and license texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run, by piles."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[at], piles[at] = v, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places, rising in both, of equal words that patience alignment joins."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a[i] == b[p]:
            out.append((i, p))
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            j, q = j - 1, q - 1
            out.append((j, q))
        if i >= j or p >= q:
            continue
        once: list[dict[int, int]] = []
        for words, lo, hi in ((a, i, j), (b, p, q)):
            at: dict[int, int] = {}
            for k in range(lo, hi):
                at[words[k]] = -1 if words[k] in at else k
            once.append({w: k for w, k in at.items() if k >= 0})
        shared = [(k, once[1][w]) for w, k in once[0].items() if w in once[1]]
        anchors = [shared[k] for k in rising([y for _, y in shared])]
        out += anchors
        edges = [(i - 1, p - 1), *anchors, (j, q)]
        if anchors:
            todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(out)


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return tx.words(data, np.array([0, len(data)]), lower=True, gaps=GAPS).hashes


class Matcher:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates, key=lambda k: (-len(_words(templates[k])), k))
        hashes = [_words(templates[k]) for k in self.names]
        self.vocab = np.unique(np.concatenate(hashes))
        self.ids = [np.searchsorted(self.vocab, h) for h in hashes]

    def chunk(self, data: np.ndarray, off: np.ndarray) -> list[list[tuple]]:
        """For each text: (coverage, template's number, matched words, first word, end word), best first."""
        w = tx.words(data, off, lower=True, gaps=GAPS)
        at = np.minimum(np.searchsorted(self.vocab, w.hashes), len(self.vocab) - 1)
        ids = np.where(self.vocab[at] == w.hashes, at, -1)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(w.ptr))
        found: list[list[tuple]] = [[] for _ in range(len(off) - 1)]
        for n, template in enumerate(self.ids):
            size, words = len(template), len(self.vocab) + 1
            often = np.bincount(template, minlength=words)
            hit = np.flatnonzero(often[ids])
            # stretches are numbered text by text; a word of block k lies in those that begin at blocks k - SPAN + 1 to k
            base = np.concatenate([[0], np.cumsum(np.diff(w.ptr) // size + SPAN)])
            last = base[doc[hit]] + (hit - w.ptr[doc[hit]]) // size
            key = np.concatenate([last + k for k in range(SPAN)]) * words + np.tile(ids[hit], SPAN)
            key, count = np.unique(key, return_counts=True)
            stretch, first = np.unique(key // words, return_index=True)
            bound = np.add.reduceat(np.minimum(count, often[key % words]), first) if len(key) else first
            places: dict[int, set[tuple]] = {}
            for s in stretch[bound >= MIN_COVERAGE * size].tolist():
                d = int(np.searchsorted(base, s, "right")) - 1
                begin = (s - int(base[d]) - SPAN + 1) * size
                lo, hi = int(w.ptr[d]) + max(0, begin), min(int(w.ptr[d + 1]), int(w.ptr[d]) + begin + SPAN * size)
                for place in self.places(template.tolist(), ids[lo:hi].tolist()):
                    places.setdefault(d, set()).add((-place[0], lo + place[1], lo + place[2]))
            for d, options in places.items():
                taken: list[tuple[int, int]] = []
                for matched, begin, end in sorted(options):
                    at = bisect_left(taken, (begin, begin))
                    if (at == 0 or taken[at - 1][1] <= begin) and (at == len(taken) or taken[at][0] >= end):
                        taken.insert(at, (begin, end))
                        found[d].append((-matched / size, n, -matched, begin - int(w.ptr[d]), end - int(w.ptr[d])))
        for rows in found:
            rows.sort(key=lambda r: (-r[0], r[1], r[3]))
        return found

    @staticmethod
    def places(template: list[int], text: list[int]) -> list[tuple[int, int, int]]:
        """(matched words, first word, end word) of the good alignments in a stretch."""

        def aligned(lo: int, hi: int) -> tuple[int, int, int] | None:
            pairs = align(template, text[lo:hi])
            if len(pairs) >= MIN_COVERAGE * len(template) and len(pairs) >= MIN_DENSITY * (pairs[-1][1] + 1 - pairs[0][1]):
                return len(pairs), lo + pairs[0][1], lo + pairs[-1][1] + 1

        if place := aligned(0, len(text)):
            return [place]
        most = int(len(template) / MIN_DENSITY) + 1
        out = []
        for word in dict.fromkeys(template[: len(template) - ceil(MIN_COVERAGE * len(template)) + 1]):
            at = [k for k, x in enumerate(text) if x == word]
            out += [aligned(i, min(j, i + most)) for i, j in zip(at, [*at[1:], len(text)])]
        return [place for place in out if place]


SCHEMA = "doc_id long, license_id string, coverage double, matched_words long, word_start long, word_end long, n_found long, licenses array<string>"


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates)
        for batch in batches:
            data, off = tx.buffers(batch.column(1))
            found = [r for i, j in tx.chunks(off) for r in matcher.chunk(data[off[i] : off[j]], off[i : j + 1] - off[i])]
            best = [r[0] if r else None for r in found]
            pick = lambda k, kind: pa.array([r[k] if r else None for r in best], kind)
            names = [matcher.names[r[1]] if r else None for r in best]
            every = [sorted({matcher.names[x[1]] for x in r}) for r in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array([r[0] if r else 0.0 for r in best], pa.float64()), pick(2, pa.int64()), pick(3, pa.int64()), pick(4, pa.int64()), pa.array([len(r) for r in found], pa.int64()), pa.array(every, pa.list_(pa.string()))],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of docs: its best license (null if none), coverage, place in words, and all licenses found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES), SCHEMA)
