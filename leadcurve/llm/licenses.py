"""License scans: parts of a text compared with licence templates by the Dice coefficient.

Texts and templates are normalised: A-Z in lower case, and everything but ASCII letters,
digits and non-ASCII characters separates words. A part is a line, a paragraph of several
lines, or a whole text of several paragraphs. Its Dice coefficient with a template is
twice the word bigrams they share (copies counted) over the bigrams of both.

Two bounds prune without losing a match. A coefficient of at least t needs sizes within
a factor of (2 - t) / t, so a part meets only templates of its size; and it needs
t / (2 - t) of the part's bigrams to occur in templates at all, so most parts meet none.

Apart from parts, every template is sought in windows of the whole text, across lines and
paragraphs: all windows of a fitting size that begin and end at a bigram of the template,
which are the best ones. What they find is in columns of their own.

Null and empty texts, and parts of fewer than two words, match nothing. Rows are scanned
one by one, whatever their doc_id. Of equally good templates the first name is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadcurve.llm import words as W
from leadcurve.llm.frames import own_columns

PERCENT = 80  # the least coefficient of a match

_APART = np.ones(256, dtype=bool)
_APART[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = False
_APART[0x80:] = False

# Licence notices and short licence texts, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def bigrams(words: W.Words) -> np.ndarray:
    """The hash of each word and its successor; the last one has none."""
    run = W.running(words.hashes())
    at = np.arange(max(len(words) - 1, 0))
    return W.sequence_hash(run, at, at + 2)


class Templates:
    """Templates by the number of their bigrams."""

    def __init__(self, templates: list[tuple[str, str]], percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be above 0 and at most 100")
        self.percent = percent
        self.own: list[tuple[int, str, Counter]] = []
        for name, text in templates:
            words = W.split_words(pa.array([text]), lower=True, apart=_APART)
            found = Counter(bigrams(words).tolist())
            if found:
                self.own.append((found.total(), name, found))
        self.own.sort(key=lambda x: x[:2])
        self.sizes = np.array([n for n, _, _ in self.own], dtype=np.int64)
        self.known = np.array(sorted({h for _, _, c in self.own for h in c}), dtype=np.uint64)

    def fitting(self, size: int) -> list[tuple[int, str, Counter]]:
        """Templates whose size allows the coefficient."""
        rest = 200 - self.percent
        lo = np.searchsorted(self.sizes * rest, size * self.percent, side="left")
        hi = np.searchsorted(self.sizes * self.percent, size * rest, side="right")
        return self.own[lo:hi]

    def best(self, part: np.ndarray) -> tuple[float, str] | None:
        """Coefficient and name of the most similar template, if one is similar enough."""
        found, best = None, None
        for size, name, own in self.fitting(len(part)):
            found = found or Counter(part.tolist())
            both = sum(min(n, found[h]) for h, n in own.items() if h in found)
            score = 2 * both / (size + len(part))
            if 200 * both >= self.percent * (size + len(part)) and (best is None or (-score, name) < (-best[0], best[1])):
                best = score, name
        return best


def parts(words: W.Words, lines: W.Lines) -> Iterator[tuple[str, int, int, int]]:
    """(kind, row, first word, end) of the lines, paragraphs and whole texts."""
    for row, word, end in zip(lines.row.tolist(), lines.word.tolist(), lines.word_end.tolist(), strict=True):
        yield "line", row, word, end
    new = np.ones(len(lines.row), dtype=bool)
    new[1:] = (lines.row[1:] != lines.row[:-1]) | (lines.number[1:] != lines.number[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(new)) - 1 if len(head) else head
    for a, b in zip(head.tolist(), tail.tolist(), strict=True):
        if b > a:
            yield "paragraph", int(lines.row[a]), int(lines.word[a]), int(lines.word_end[b])
    count = np.bincount(lines.row[head], minlength=len(words.first) - 1)
    for row in np.flatnonzero(count > 1).tolist():
        yield "text", row, int(words.first[row]), int(words.first[row + 1])


def embedded(words: W.Words, pairs: np.ndarray, templates: Templates) -> list[dict[str, float]]:
    """For each text the best coefficient of each licence that one of its windows matches."""
    out: list[dict[str, float]] = [{} for _ in range(len(words.first) - 1)]
    percent, rest = templates.percent, 200 - templates.percent
    row = words.row[: len(pairs)]
    at = np.flatnonzero((row == words.row[1:]) & np.isin(pairs, templates.known))
    row, found = row[at], pairs[at]
    place = at + row * (int(templates.sizes.max(initial=0)) * rest // percent + 1)  # no window reaches another text
    for size, name, own in templates.own:
        mine = np.flatnonzero(np.isin(found, np.array(list(own), dtype=np.uint64)))
        pos = place[mine]
        count = np.searchsorted(pos, pos + size * rest // percent) - np.arange(len(pos))
        starts = np.flatnonzero(count * rest >= size * percent)
        hashes, where = found[mine].tolist(), pos.tolist()
        for i in starts.tolist():
            left, both = dict(own), 0
            best = out[row[mine[i]]]
            for j in range(i, i + int(count[i])):
                if left[hashes[j]]:
                    left[hashes[j]] -= 1
                    both += 1
                    total = size + where[j] - where[i] + 1
                    if 200 * both >= percent * total:
                        best[name] = max(best.get(name, 0.0), 2 * both / total)
    return out


def matches_of(column: pa.Array, templates: Templates) -> tuple[list[list[tuple[float, str, str]]], list[dict[str, float]]]:
    """For each text its parts' (coefficient, name, kind of part), and what is embedded in it."""
    words = W.split_words(column, lower=True, apart=_APART)
    lines = W.split_lines(words, W.text_buffer(column)[1])
    pairs = bigrams(words)
    hits = np.append(0, np.cumsum(np.isin(pairs, templates.known)))
    out: list[list[tuple[float, str, str]]] = [[] for _ in range(len(column))]
    rest = 200 - templates.percent
    for kind, row, word, end in parts(words, lines):
        size = end - 1 - word
        if size > 0 and (hits[end - 1] - hits[word]) * rest >= size * templates.percent:
            best = templates.best(pairs[word : end - 1])
            if best:
                out[row].append((*best, kind))
    return out, embedded(words, pairs, templates)


def scanned(documents: DataFrame, percent: int = PERCENT, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: doc_id, license (of the best part, or null), score, part, n_matches and licenses (all names, sorted).

    Of the windows of the whole text: embedded (all names, sorted) and embedded_score (the best, or null).
    """
    table = Templates(TEMPLATES if templates is None else templates, percent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            rows = []
            for found, inside in zip(*matches_of(batch.column("text"), table), strict=True):
                score, name, kind = min(found, key=lambda x: (-x[0], x[1], x[2]), default=(None, None, None))
                rows.append((name, score, kind, len(found), sorted({n for _, n, _ in found}), sorted(inside), max(inside.values(), default=None)))
            name, score, kind, n, names, inner, inner_score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(kind, pa.string()),
                    pa.array(n, pa.int64()), pa.array(names, pa.list_(pa.string())),
                    pa.array(inner, pa.list_(pa.string())), pa.array(inner_score, pa.float64()),
                ],
                ["doc_id", "license", "score", "part", "n_matches", "licenses", "embedded", "embedded_score"],
            )

    own = own_columns(documents, doc_id="doc_id", text="text")
    return own.mapInArrow(
        scan,
        "doc_id long, license string, score double, part string, n_matches long, licenses array<string>, "
        "embedded array<string>, embedded_score double",
    )
