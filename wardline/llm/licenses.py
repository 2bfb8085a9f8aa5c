"""License scans with a positional index of rare words.

Templates are wordings of public licences, from one line to whole texts. The index holds,
for each word, where it stands in the templates of whose rarest words it is one. A file's
words of highest inverse document frequency are looked up; their postings in a template are
intersected by relative position, with room for words put in or left out. Only a template of which two
different places agree on where it stands is scored, over all its words in order, and its key phrases are verified. The
places of a template that are indexed weigh more than what a match may lack and one place besides, so a match
holds two of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm import words as W

# Phrases of the base labels.
BASE_PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Fixed values: (label, wording, key phrases that a match must hold). Wordings of public licences and their notices.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license",)),
    ("apache-2.0", "apache license version 2 0", ("apache license", "version 2 0")),
    ("artistic-2.0", "licensed under the artistic license version 2 0", ("artistic license", "2 0")),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4 0",)),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-2.0", "gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("lgpl", "licensed under the gnu lesser general public license version", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("without any express or implied warranty",)),
)

# Whole texts and notices of public licences, with the phrases that a match must hold.
WHOLE = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("permission is hereby granted free of charge",)),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ("for any purpose with or without fee",)),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", ("source and binary forms", "must reproduce the above copyright notice")),
    ("bsd-3-clause", """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission.""", ("endorse or promote products",)),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software
must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution.""", ("must not be misrepresented",)),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain.""", ("free and unencumbered software",)),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.""", ("any person or organization obtaining a copy",)),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("except in compliance with the license",)),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of
the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", ("gnu general public license", "version 3 of the license")),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of
the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", ("gnu general public license", "version 2 of the license")),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1
of the License, or (at your option) any later version.""", ("lesser general public license",)),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("mozilla public license",)),
)


def _plain(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


ALL_TEMPLATES = (*TEMPLATES, *((label, _plain(text), phrases) for label, text, phrases in WHOLE))

#: Share of a template's weight, by inverse document frequency, that must stand at its place.
LEAST_SHARE = 0.5
#: Words beyond either end of a template's place in which its key phrases may stand.
SLACK = 3
#: Words by which places of a template may be out of step: so many, or one in so many of its words.
STEP, ONE_IN = 3, 8
#: Words of a template from which a key phrase may hold one other word; in a line such a word may name another licence.
LONG = 24


@dataclass(frozen=True)
class Index:
    """Words of the templates and where they stand in which."""

    vocabulary: tuple[str, ...]
    idf: np.ndarray
    templates: tuple[tuple[str, np.ndarray, tuple[np.ndarray, ...]], ...]  # label, word numbers, phrases' word numbers
    anchors: dict[int, list[tuple[int, int]]]  # word number: (template, place) of the places that are indexed
    postings: tuple[dict[int, list[int]], ...]  # of each template, word number: its places
    phrases: tuple[tuple[str, np.ndarray], ...]  # base phrases
    indexed: np.ndarray  # whether a word has anchors


def _vocabulary() -> list[str]:
    texts = [t for _, t, _ in ALL_TEMPLATES] + [p for _, _, ps in ALL_TEMPLATES for p in ps] + [p for _, p in BASE_PHRASES]
    return sorted({w for t in texts for w in t.split()})


def _numbers(w: W.Words, sorted_hash: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the batch of words of the vocabulary, and their numbers there."""
    quick = np.zeros(1 << 16, bool)
    quick[sorted_hash & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(quick[w.hash & np.uint64(0xFFFF)])
    k = np.minimum(np.searchsorted(sorted_hash, w.hash[at]), len(sorted_hash) - 1)
    ok = sorted_hash[k] == w.hash[at]
    return at[ok], number[k[ok]]


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    hashes = W.hash_words(_vocabulary(), W.ALNUM_WORDS)
    order = np.argsort(hashes)
    return hashes[order], order


def word_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, rows): in how many rows each word of the templates occurs, and all rows under number -1."""
    sorted_hash, number = _hashes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number) + 1, np.int64)
        for b in W.batches(it, 2 << 20, text):
            w = W.words(b.column(0), W.ALNUM_WORDS)
            at, word = _numbers(w, sorted_hash, number)
            total[:-1] += np.bincount(np.unique(w.doc[at] * len(number) + word) % len(number), minlength=len(number))
            total[-1] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(number)), -1], pa.int32()), pa.array(total)], ["word", "rows"])

    return docs.select(text).mapInArrow(run, "word int, rows long").groupBy("word").agg(F.sum("rows").alias("rows"))


def build_index(docs: DataFrame, text: str = "text") -> Index:
    """Templates indexed by their rarest words, rarity counted over all rows."""
    rows = {r["word"]: r["rows"] for r in word_rows(docs, text).collect()}  # a row for each word of the templates
    vocabulary = _vocabulary()
    number = {w: k for k, w in enumerate(vocabulary)}
    n = rows.get(-1, 0)
    idf = np.array([np.log((n + 1) / (rows.get(k, 0) + 1)) + 1 for k in range(len(vocabulary))])
    seq = lambda t: np.array([number[w] for w in t.split()])
    templates = tuple((label, seq(t), tuple(seq(p) for p in ps)) for label, t, ps in ALL_TEMPLATES)
    anchors: dict[int, list[tuple[int, int]]] = {}
    for k, (_, word, _) in enumerate(templates):
        # the rarest places that together weigh more than a match may lack and one place more: it holds two of them
        weight, lack = idf[word], (1 - LEAST_SHARE) * idf[word].sum() + idf[word].max()
        for q in np.lexsort((np.arange(len(word)), -weight)).tolist():
            if lack < -1e-9:
                break
            anchors.setdefault(int(word[q]), []).append((k, q))
            lack -= weight[q]
    indexed = np.zeros(len(vocabulary), bool)
    indexed[list(anchors)] = True
    postings: list[dict[int, list[int]]] = [{} for _ in templates]
    for k, (_, word, _) in enumerate(templates):
        for q, w in enumerate(word.tolist()):
            postings[k].setdefault(w, []).append(q)
    return Index(tuple(vocabulary), idf, templates, anchors, tuple(postings), tuple((label, seq(p)) for label, p in BASE_PHRASES), indexed)


def _find(line: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase stands in a row of word numbers (-1: other words)."""
    m = len(line) - len(phrase) + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    hit = np.ones(m, bool)
    for k, w in enumerate(phrase):
        hit &= line[k : k + m] == w
    return np.flatnonzero(hit)


def _stands(line: np.ndarray, phrase: np.ndarray, loosely: bool) -> bool:
    """Whether a key phrase stands in a row of word numbers; ``loosely``: with at most one other word put in."""
    if len(_find(line, phrase)):
        return True
    return loosely and any(len(_find(line, np.insert(phrase, k, x))) for k in range(1, len(phrase)) for x in np.unique(line[np.flatnonzero(line[:-1] == phrase[k - 1]) + 1]).tolist())


def _agreeing(hits: list[tuple[int, int]], room: int) -> list[int]:
    """Relative positions p - q on which two different places of a template agree, one for each stretch of ``room``."""
    out: list[int] = []
    ordered = sorted((p - q, q) for p, q in hits)
    low = 0
    for k, (d, q) in enumerate(ordered):
        while ordered[low][0] < d - room:
            low += 1
        if any(other != q for _, other in ordered[low:k]) and (not out or d - out[-1] > room):
            out.append(d)
    return out


def _in_order(hits: list[tuple[int, int]], weight: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """The heaviest of the hits (p, q) in which both places rise, and its weight."""
    hits = sorted(hits, key=lambda h: (h[0], -h[1]))
    best, back = [0.0] * len(hits), [-1] * len(hits)
    rising: list[tuple[int, float, int]] = []  # (q, weight of the best chain that ends there, hit), both rising
    for k, (_, q) in enumerate(hits):
        at = bisect_left(rising, (q,))
        before = rising[at - 1] if at else (-1, 0.0, -1)
        best[k], back[k] = before[1] + float(weight[q]), before[2]
        if at < len(rising) and rising[at][0] == q and rising[at][1] >= best[k]:
            continue
        end = at
        while end < len(rising) and rising[end][1] <= best[k]:
            end += 1
        rising[at:end] = [(q, best[k], k)]
    chain, k = [], rising[-1][2] if rising else -1
    total = best[k] if k >= 0 else 0.0
    while k >= 0:
        chain.append(hits[k])
        k = back[k]
    return total, chain[::-1]


def match_templates(line: np.ndarray, index: Index) -> list[tuple[str, int, float]]:
    """(label, start, share) of each template that stands in a text of word numbers.

    Indexed words of the text are looked up, the rarest first; a template is looked at where the relative positions of two of its
    indexed places agree, give or take STEP words or one in ONE_IN of its length. There its words in the text, in
    order and within that room, are weighed; it is kept if they have LEAST_SHARE of its weight and all key phrases are there.
    """
    at = np.flatnonzero(index.indexed[line] & (line >= 0))
    at = at[np.argsort(-index.idf[line[at]], kind="stable")]
    named: dict[int, list[tuple[int, int]]] = {}
    for p, w in zip(at.tolist(), line[at].tolist(), strict=True):
        for k, q in index.anchors[w]:
            named.setdefault(k, []).append((p, q))
    found = []
    for k, hits in named.items():
        label, word, phrases = index.templates[k]
        room = max(STEP, len(word) // ONE_IN)
        weight = index.idf[word]
        # a template all of whose indexed words are one place needs no second one
        alone = len({q for w in set(word.tolist()) for t, q in index.anchors.get(w, ()) if t == k}) == 1
        for d in [p - q for p, q in hits] if alone else _agreeing(hits, room):
            a, b = max(0, d - room), min(len(line), d + len(word) + room)
            near = [(a + i, q) for i, w in enumerate(line[a:b].tolist()) if w >= 0 for q in index.postings[k].get(w, ()) if abs(a + i - q - d) <= room]
            if weight[sorted({q for _, q in near})].sum() < LEAST_SHARE * weight.sum():
                continue
            total, chain = _in_order(near, weight)
            share = total / float(weight.sum())
            if share < LEAST_SHARE:
                continue
            around = line[max(0, chain[0][0] - chain[0][1] - SLACK) : chain[-1][0] + len(word) - chain[-1][1] + SLACK]
            if all(_stands(around, p, len(word) >= LONG) for p in phrases):
                steps = Counter(p - q for p, q in chain)
                found.append((label, min(steps, key=lambda x: (-steps[x], x)), share))
    return found


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences of each text: (key, n_words, n_base, first_word, last_word, base_labels, labels, score, places).

    Base labels are phrases whose words stand consecutively. Further labels are
    templates found through their rarest words. score is the best share of a
    template's weight that is there, 1 for a base phrase, 0 without any label.
    places lists the templates as label:first word. Null and empty texts have no
    words and no labels; repeated rows give repeated results.
    """
    index = build_index(docs, text)
    sorted_hash, number = _hashes()
    base = {int(w) for _, p in index.phrases for w in p}
    wanted = np.zeros(len(number), bool)
    wanted[list(base | set(index.anchors))] = True
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    types = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), T.ArrayType(T.StringType())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, 2 << 20, text):
            w = W.words(b.column(text), W.ALNUM_WORDS)
            at, word = _numbers(w, sorted_hash, number)
            n, out = np.diff(w.first), {}
            cut = np.searchsorted(w.doc[at], np.arange(b.num_rows + 1))
            for d in np.unique(w.doc[at[wanted[word]]]).tolist():
                line = np.full(n[d], -1)
                own = slice(cut[d], cut[d + 1])
                line[at[own] - w.first[d]] = word[own]
                starts = {label: _find(line, p) for label, p in index.phrases}
                all_starts = np.concatenate(list(starts.values()))
                found = match_templates(line, index)
                plain = {label for label, s in starts.items() if len(s)}
                if not plain and not found:
                    continue
                out[d] = (
                    len(all_starts), int(all_starts.min()) if len(all_starts) else None, int(all_starts.max()) if len(all_starts) else None,
                    ",".join(sorted(plain)), ",".join(sorted(plain | {f[0] for f in found})),
                    1.0 if plain else min(1.0, max(f[2] for f in found)), sorted({f"{label}:{max(0, start)}" for label, start, _ in found}),
                )
            rows = [out.get(d, (0, None, None, "", "", 0.0, [])) for d in range(b.num_rows)]
            cols = [pa.array(n, pa.int64())]
            for k, kind in enumerate([pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]):
                cols.append(pa.array([r[k] for r in rows], kind))
            yield pa.RecordBatch.from_arrays([b.column(key), *cols], [key, *names])

    schema = T.StructType([docs.schema[key], *(T.StructField(a, t) for a, t in zip(names, types, strict=True))])
    return docs.select(key, text).mapInArrow(run, schema)
