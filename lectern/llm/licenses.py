"""Operator 2: license scans by Dice coefficient over word bigrams.

Texts are normalised (lower case, years and punctuation dropped, white space
folded) and compared with licence templates. A document is compared as a whole,
by line and by paragraph, and by runs of neighbouring units (lines, and the
sentences inside them), so that a notice inside a long text is found, also where
it is wrapped over the lines of a comment. Dice is
2 * shared / (a + b): for a threshold t only templates with a number of bigrams
between b * t / (2 - t) and b * (2 - t) / t can reach it, and of those only the
ones that share a bigram at all; the rest are never compared. Runs are formed only
for a template of which the text has the share t / (2 - t) of the bigrams; of runs
that overlap, the one with the most bigrams of its template is a segment.

Edge cases: a null or empty text matches nothing; licences whose notices differ by a few
words have a template each, so that each notice is most like its own (one changed by as
much as they differ may be given the other's name); of templates with equal
coefficients the one with the smaller id is given; a template of one word
counts its word as its bigram; repeated rows are judged each for itself; a null
id is a valid row; very long texts are scanned whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.batches import slices
from lectern.llm.common import table

THRESHOLD = 0.8

_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."

_GNU = "you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {kind} 4.0 International License."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
_ZLIB_GRANT = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"

#: Fixed notices: (license, text). Standard short forms, grants and headers, of which a document may hold any.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: " + _GNU.format(name="Affero General Public License", mark=",", version="3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", f"{_BSD} {_BSD_1} {_BSD_2}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", _CC.format(kind="Attribution")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", _CC.format(kind="Attribution-NonCommercial")),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", _CC.format(kind="Attribution-NonCommercial-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", _CC.format(kind="Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", _CC.format(kind="Attribution-NoDerivatives")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", _CC.format(kind="Attribution-ShareAlike")),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; " + _GNU.format(name="General Public License", mark=";", version="2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: " + _GNU.format(name="General Public License", mark=",", version="3")),
    ("ISC", _ISC),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; " + _GNU.format(name="Lesser General Public License", mark=";", version="2.1")),
    ("LGPL-3.0", "This library is free software: " + _GNU.format(name="Lesser General Public License", mark=",", version="3")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_NOTICE}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", _ZLIB),
    ("Zlib", f"{_ZLIB} {_ZLIB_GRANT}"),
    ("proprietary", "All rights reserved."),
]
#: Each licence is also named by its identifier.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in TEMPLATES) if name != "proprietary"]

_WORD = re.compile(r"[^\W_]+")
_YEAR = re.compile(r"(?:copyright|\(c\)|©)[\s,]*(?:\(c\)|©)?[\s,]*(?:\d{4}[\s,\-–]*)+")
#: What ends a unit: a line break, or the white space after a mark inside a line.
_CUT = re.compile(r"\n|(?<=[.!?;:])[ \t\r]+")
_START = 4096
_RESULT = "id long, n_hits long, n_segments long, license string, dice double, hits array<struct<license:string,dice:double,segment:string>>"


def bigrams(text: str) -> frozenset:
    found = _WORD.findall(_YEAR.sub(" ", text.lower()))
    return frozenset(zip(found, found[1:], strict=False)) if len(found) != 1 else frozenset([(found[0], "")])


class Templates:
    """The templates by bigram and by size."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.items = sorted((name, bigrams(text)) for name, text in templates)
        self.sizes = np.array([len(b) for _, b in self.items])
        self.threshold = threshold
        self.holders: dict[tuple, list[int]] = {}
        for k, (_, b) in enumerate(self.items):
            for x in b:
                self.holders.setdefault(x, []).append(k)
        t = threshold
        # By how much sizes may differ; a little wider than the threshold asks for, against rounding.
        self.wide = (2 - t) / t * (1 + 1e-9)
        self.least, self.most = float(self.sizes.min(initial=0)) / self.wide, float(self.sizes.max(initial=0)) * self.wide

    def best(self, text: str) -> tuple[float, str] | None:
        """The most similar template at or over the threshold."""
        # Bigrams only grow along a text: a start with too many settles it (the margin is for the cut).
        if len(text) > _START and len(bigrams(text[:_START])) > self.most + 8:
            return None
        own = bigrams(text)
        n, t = len(own), self.threshold
        if not n or not self.least <= n <= self.most:
            return None
        shared: dict[int, int] = {}
        for x in own:
            for k in self.holders.get(x, ()):
                if n / self.wide <= self.sizes[k] <= n * self.wide:
                    shared[k] = shared.get(k, 0) + 1
        scored = [(2 * s / (n + int(self.sizes[k])), self.items[k][0]) for k, s in shared.items()]
        scored = [x for x in scored if x[0] >= t]
        return min(scored, key=lambda x: (-x[0], x[1])) if scored else None


    def runs(self, text: str) -> list[str]:
        """Runs of units that reach the threshold for a template; of those that overlap, the one with the most of its template."""
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case
            text = low
        low = _YEAR.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), low)
        found = _WORD.findall(low)
        count: dict[int, int] = {}
        for x in self.holders.keys() & set(zip(found, found[1:], strict=False)):
            for k in self.holders[x]:
                count[k] = count.get(k, 0) + 1
        likely = {k for k, n in count.items() if n >= self.sizes[k] / self.wide}
        if not likely:
            return []
        spans, at = [], 0
        for cut in _CUT.finditer(low):
            spans.append((at, cut.start()))
            at = cut.end()
        spans.append((at, len(low)))
        unit = [u for u, (a, b) in enumerate(spans) for _ in _WORD.finditer(low, a, b)]
        places: dict[int, list[int]] = {k: [] for k in likely}
        for i, x in enumerate(zip(found, found[1:], strict=False)):
            for k in self.holders.get(x, ()):
                if k in likely:
                    places[k].append(i)
        made = []
        for k, at_k in places.items():
            best = _apart(sorted(((-d, a, b, s) for s, d, a, b in self._runs_of(int(self.sizes[k]), at_k, found, unit))), 1)
            made += [(-s, d, self.items[k][0], a, b) for d, a, b, s in best]
        return [text[spans[a][0] : spans[b][1]] for *_, a, b in _apart(sorted(made), 3)]

    def _runs_of(self, m: int, at_k: list[int], found: list[str], unit: list[int]) -> Iterator[tuple[int, float, int, int]]:
        """shared, dice, first and last unit of the best run from each unit that has bigrams of a template of ``m``, if it reaches the threshold."""
        t, later, ends, mine = self.threshold, {}, {}, set()
        # A unit is a start only of runs that end before all its bigrams have come again: without it those would be no worse.
        for i in reversed(at_k):
            u, x = unit[i], (found[i], found[i + 1])
            mine.add(x)
            seen = later.get(x)
            if seen is None or seen[0] != u:
                ends[u] = max(ends.get(u, 0), seen[1] if seen else unit[-1] + 1)
            later[x] = (u, unit[i + 1])
        starts: dict[int, int] = {}
        for i in at_k:
            starts.setdefault(unit[i], i)
        for u, i in starts.items():
            while i and unit[i - 1] == u:
                i -= 1
            own, shared, best = set(), 0, None
            while i + 1 < len(found) and unit[i + 1] < ends[u] and len(own) <= m * self.wide:
                x = (found[i], found[i + 1])
                if x not in own:
                    own.add(x)
                    shared += x in mine
                i += 1
                # A run ends with the last word of a unit.
                if i + 1 == len(found) or unit[i + 1] != unit[i]:
                    d = 2 * shared / (len(own) + m)
                    if d >= t and (best is None or d > best[1]):
                        best = (shared, d, u, unit[i])
            if best:
                yield best


def _apart(runs: list[tuple], first: int) -> list[tuple]:
    """In the given order the runs that overlap none before them; ``first`` is the place of the first unit, the last one follows."""
    ends: list[tuple[int, int]] = []
    out = []
    for r in runs:
        a, b = r[first], r[first + 1]
        k = bisect(ends, a, key=lambda e: e[0])
        if (not k or ends[k - 1][1] < a) and (k == len(ends) or ends[k][0] > b):
            ends.insert(k, (a, b))
            out.append(r)
    return out


_known: list[Templates] = []


def segments(text: str, known: Templates | None = None) -> list[str]:
    """The whole text, its paragraphs, its lines and its runs that match a template, each once."""
    if known is None:
        if not _known:
            _known.append(Templates(TEMPLATES, THRESHOLD))
        known = _known[0]
    blocks = re.split(r"\n[ \t\r]*\n", text)
    parts = dict.fromkeys([text, *blocks, *text.split("\n")])
    if runs := known.runs(text):
        plain = {p.strip() for p in parts}
        parts |= dict.fromkeys(r for r in runs if r.strip() not in plain)
    return list(parts)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: number of matching segments, the best licence and coefficient, and the matches."""
    given = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(given, threshold)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    parts = segments(text, known) if text else []
                    hits = [{"license": found[1], "dice": found[0], "segment": s} for s in parts if (found := known.best(s)) is not None]
                    top = min(hits, key=lambda h: (-h["dice"], h["license"])) if hits else {"license": None, "dice": 0.0}
                    rows.append({"id": key, "n_hits": len(hits), "n_segments": len(parts), "license": top["license"], "dice": top["dice"], "hits": hits})
                kind = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("segment", pa.string())])
                schema = pa.schema([("id", pa.int64()), ("n_hits", pa.int64()), ("n_segments", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("hits", pa.list_(kind))])
                yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, _RESULT).withColumnRenamed("id", id_col)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("hits")
