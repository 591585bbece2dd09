"""License texts in documents by patience alignment.

A template and a piece of a document are aligned on anchors: words that occur exactly once in both. The
longest increasing run of anchors (by patience sorting) is kept, and each gap between neighbouring
anchors is aligned in the same way; equal words at the rims of a gap are taken as they are. Coverage is
the share of the template's words that are matched; names, versions and terms that tell licenses apart must
be among them.

Where in a document a template may be is voted by its own words: an occurrence at place i of a word that
stands at place j in the template votes for a beginning at i - j. Only pieces around dense votes are
aligned, so several copies are found, and a long document costs in proportion to its length. Common words vote for nearly
every place, so a piece is aligned only if it has enough of the template's words, each as often as the template at most, and
all its telling words: no alignment can match more. The document as a whole is asked first. Between the words of a
find may stand up to as many others as the template has words; a template spread wider than that is not found. A name or
term of another license between them ("Lesser" in the name of the GPL) speaks against the find.

Which documents are looked at follows from the threshold: at most n - need of a template's n words may
be missing, so at least one of any n - need + 1 of them must be there. These are chosen so that the
templates share them; a document with none of them can't reach the threshold and is passed over.

Null and empty texts hold no license. Repeated rows and ids are rows like any other. Templates without
words are refused. Overlapping finds go to the better coverage, then to the longer template, then by name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.shared import text_batches, whole_text

# License statements and notices, as published with the licenses.
TEMPLATES = {
    "Apache-2.0/statement": "Licensed under the Apache License, Version 2.0.",
    "MIT/statement": "Released under the MIT License.",
    "GPL-3.0/statement": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0/statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-NC-4.0/statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0/notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\","
        " WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
        " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,"
        " TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS"
        " IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met: Redistributions of source code must retain the above copyright"
        " notice, this list of conditions and the following disclaimer. Redistributions in binary form must"
        " reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution. Neither the name of the copyright"
        " holder nor the names of its contributors may be used to endorse or promote products derived from this"
        " software without specific prior written permission."
    ),
    "GPL-3.0/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT"
        " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "MPL-2.0/notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
        " was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

TEMPLATES |= {
    f"CC-{code.upper()}-4.0/statement": f"Licensed under CC {code.upper()} 4.0." for code in ("by-sa", "by-nd", "by-nc-sa", "by-nc-nd")
}
TEMPLATES |= {
    "CC-BY-4.0/short/statement": "Licensed under CC BY 4.0.",
    "BSD/statement": "Released under the BSD License.",
    "ISC/statement": "Released under the ISC License.",
    "GPL-2.0/statement": "This work is licensed under the GNU General Public License, version 2.",
}
# Names, versions and terms that tell licenses apart: where a template has one, it must be matched.
TELLING = frozenset(
    b"apache mit isc bsd gpl lgpl agpl lesser affero gnu mozilla mpl cc creative attribution by nc sa nd noncommercial"
    b" sharealike noderivatives".split()
)
_VERSION = re.compile(rb"(?i)\bv(?:ersion|\b\.)?\s*([0-9]+)|\b([0-9])\.[0-9]\b")

_WORD = re.compile(rb"[a-z0-9]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list:
    return _WORD.findall(text.translate(_LOWER))


def increasing(values: list) -> list:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[pile], piles[pile] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(a: list, b: list) -> list:
    """Pairs (i, j), both increasing, with a[i] == b[j], by patience alignment."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i0, i1, j0, j1 = open_.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        at = {w: j for j, w in enumerate(b[j0:j1], j0) if in_b[w] == 1}
        anchors = [(i, at[a[i]]) for i in range(i0, i1) if in_a[a[i]] == 1 and a[i] in at]
        anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not anchors:
            continue
        out += anchors
        rims = [(i0 - 1, j0 - 1), *anchors, (i1, j1)]
        open_ += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(rims, rims[1:])]
    return sorted(out)


class Templates:
    """Templates as words, what votes for each, and the words of which a document must have one."""

    def __init__(self, texts: dict, coverage: float):
        self.words = {name: words_of(t.encode()) for name, t in sorted(texts.items())}
        if not all(self.words.values()):
            raise ValueError("a template without words")
        self.coverage = coverage
        self.telling = {}
        for name, words in self.words.items():
            numbers = {x for m in _VERSION.findall(texts[name].encode()) for x in m if x}
            self.telling[name] = {j for j, w in enumerate(words) if w in TELLING or w in numbers}
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        self.told = {name: Counter(words[j] for j in self.telling[name]) for name, words in self.words.items()}
        shared = Counter(w for words in self.words.values() for w in set(words))
        needed = set()
        for words in sorted(self.words.values(), key=len):
            free = len(words) - self.need(words) + 1  # so many places, and one of them is matched
            count = Counter(words)
            for w in sorted(count, key=lambda w: (w not in needed, len(w) < 4, -shared[w], -len(w), w)):
                if free <= 0:
                    break
                needed.add(w)
                free -= count[w]
        # inside another one: the longer one is there only if the shorter one is
        self.needed = sorted(w for w in needed if not any(o != w and o in w for o in needed))
        self.places = {}
        for name, words in self.words.items():
            self.places[name] = mine = {}
            for j, w in enumerate(words):
                mine.setdefault(w, []).append(j)
        self.known = frozenset(w for count in self.counts.values() for w in count)

    def need(self, words: list) -> int:
        return max(1, int(np.ceil(self.coverage * len(words) - 1e-9)))

    def possible(self, low: bytes) -> bool:
        return any(w in low for w in self.needed)

    def enough(self, name: str, places: dict) -> bool:
        """Whether a document with these places of words has enough of the template's words and all its telling ones."""
        if any(len(places.get(w, ())) < c for w, c in self.told[name].items()):
            return False
        return sum(min(c, len(places[w])) for w, c in self.counts[name].items() if w in places) >= self.need(self.words[name])

    def likely(self, name: str, at: dict, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same for each of the pieces from ``begin`` to ``end``; ``at`` holds the places of the template's words."""
        matched, told = np.zeros(len(begin), np.int64), np.ones(len(begin), bool)
        for w, places in at.items():
            inside = np.searchsorted(places, end) - np.searchsorted(places, begin)
            matched += np.minimum(inside, self.counts[name][w])
            if w in self.told[name]:
                told &= inside >= self.told[name][w]
        return told & (matched >= self.need(self.words[name]))

    def tells(self, name: str, words: list, begin: int, pairs: list) -> bool:
        """Whether all telling words of the template are matched, and no other license's stand between its words."""
        if not self.telling[name] <= {j for _, j in pairs}:
            return False
        places = {begin + i for i, _ in pairs}
        between = {words[i] for i in range(min(places), max(places)) if i not in places}
        return not (between & TELLING) - set(self.words[name])

    def find(self, text: bytes) -> list:
        """(name, coverage, first word, word after the last), without overlaps, in order."""
        if not self.possible(low := text.translate(_LOWER)):
            return []
        words = _WORD.findall(low)
        places = {}
        for i, w in enumerate(words):
            if w in self.known:
                places.setdefault(w, []).append(i)
        found = []
        for name, template in self.words.items():
            n, need = len(template), self.need(template)
            if not self.enough(name, places):
                continue
            at = {w: np.asarray(places[w]) for w in self.counts[name] if w in places}
            votes = np.sort(np.concatenate([at[w] - j for w in at for j in self.places[name][w]]))
            mine = []
            # closely set words first, so that neighbouring copies are told apart; then those with more words between
            for slack in (max(2, n // 4), max(2, n)):
                # need matches that drift at most ``slack`` places: so many votes within so short a stretch
                dense = np.flatnonzero(votes[need - 1 :] - votes[: len(votes) - need + 1] <= slack)
                starts = votes[dense]
                dense = dense[self.likely(name, at, np.maximum(starts - slack, 0), starts + n + 2 * slack)]
                upto, near, failed = -1, list(mine), None
                for k in dense.tolist():
                    begin, end = max(0, int(votes[k]) - slack, upto), int(votes[k]) + n + 2 * slack
                    if int(votes[k]) < upto - slack or any(a < end and begin < b for *_, a, b in near):
                        continue
                    if (begin, end) == failed:
                        continue
                    pairs = aligned(words[begin:end], template)
                    if len(pairs) >= need and self.tells(name, words, begin, pairs):
                        first, last = begin + pairs[0][0], begin + pairs[-1][0] + 1
                        mine.append((name, len(pairs) / n, first, last))
                        upto = last
                    else:
                        failed = begin, end
            found += mine
        taken, out = np.zeros(len(words), bool), []
        for name, share, first, last in sorted(found, key=lambda f: (-f[1], -len(self.words[f[0]]), f[0], f[2])):
            if not taken[first:last].any():
                taken[first:last] = True
                out.append((name, share, first, last))
        return sorted(out, key=lambda f: f[2])


def scanned(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", templates: dict | None = None, coverage: float = 0.8
) -> DataFrame:
    """One row per row of ``docs``: id and ``found``, an array of (license, coverage, first, end) in words."""
    known = Templates(TEMPLATES if templates is None else templates, coverage)
    kind_of = pa.list_(
        pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("end", pa.int64())])
    )
    names = ("license", "coverage", "first", "end")

    def run(batches):
        for b in batches:
            found = [[dict(zip(names, f)) for f in known.find(t)] for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind_of)], ["id", "found"])

    narrow = text_batches(docs).select(F.col(id_).alias("id"), whole_text(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, found array<struct<license:string,coverage:double,first:bigint,end:bigint>>"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_)
