"""License scans: a generalised suffix automaton of licence tokens gives each text's matching statistics.

The automaton holds every substring of the licence templates and of the base phrases. A text
is streamed through it word by word; at each word it knows the longest suffix that occurs in
some template. Base phrases are read off the states on the suffix-link path. Maximal matches
of MIN_MATCH words or more (MIN_MATCH_TEXT for whole texts) are chained, in text and template order, into covered spans; a
whole licence text covered to COVER or more, or a short notice covered whole, gives its label. Words outside the licence vocabulary, and
word pairs outside the templates' pairs, end every match of two words, so the automaton is
only entered between them; that changes no statistic of two words or more.

Edge cases: null, empty and blank texts have no words, no places, empty labels and score 0;
long texts are scanned whole; a null doc_id and repeated rows pass through; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botledger.llm.common import lean

#: Words of the shortest match that counts, for notices and for whole texts.
MIN_MATCH, MIN_MATCH_TEXT = 3, 6
#: Words up to which a template is a notice.
NOTICE_WORDS = 12
#: Share of a template's words that chained matches must cover for its label. A notice must be there whole.
COVER = 0.8
#: Words of the text that may lie between two matches of a chain, in a notice and in a whole text.
MAX_GAP, MAX_GAP_TEXT = 4, 40

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, short: str) -> str:
    """The notice that files under a GNU licence carry."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this program. If not, see <{short}>."""


#: Whole texts and file headers of public licences, and the short notices that name one. Case and punctuation do not count.
TEMPLATES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "Released under the ISC License",
    ],
    "bsd-2-clause": [_BSD_START + _BSD_END],
    "bsd-3-clause": [_BSD_START + _BSD_NAMES + _BSD_END],
    "bsd": ["Licensed under the BSD License", "Released under the BSD License"],
    "apache": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [_gnu("General Public License", "https://www.gnu.org/licenses/"), "Licensed under the GNU General Public License"],
    "lgpl": [_gnu("Lesser General Public License", "https://www.gnu.org/licenses/"), "Licensed under the GNU Lesser General Public License"],
    "agpl": [_gnu("Affero General Public License", "https://www.gnu.org/licenses/"), "Licensed under the GNU Affero General Public License"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "This is free and unencumbered software released into the public domain",
    ],
    "cc0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "Dedicated to the public domain under CC0",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA", "Licensed under a Creative Commons Attribution-ShareAlike"],
    "cc-by-nc": ["Licensed under CC BY-NC", "Licensed under a Creative Commons Attribution-NonCommercial"],
    "cc-by-nd": ["Licensed under CC BY-ND", "Licensed under a Creative Commons Attribution-NoDerivatives"],
    "reserved": ["All rights reserved"],
}

#: Lower-cases A-Z and turns every byte that separates words into a space.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class SuffixAutomaton:
    """Generalised suffix automaton of token lists; each state knows where its strings end in which template."""

    def __init__(self, lists: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for number, tokens in enumerate(lists):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                while len(ends) < len(self.next):
                    ends.append(set())
                ends[last].add((number, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            found = self.next[last][token]
            return found if self.length[found] == self.length[last] + 1 else self._split(last, token, found)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return cur

    def _split(self, p: int, token: int, q: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        """State and length of the longest suffix of (what state and length stand for, then token) that occurs."""
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        nxt = self.next[state].get(token)
        return (0, 0) if nxt is None else (nxt, length + 1)


class LicenceScanner:
    def __init__(self):
        self.templates = [(label, t.encode().translate(_TABLE).split()) for label, texts in TEMPLATES.items() for t in texts]
        phrases = [(label, p.encode().split()) for p, label in BASE.items()]
        words = sorted({w for _, t in self.templates + phrases for w in t})
        self.ids = {w: i + 1 for i, w in enumerate(words)}
        coded = [[self.ids[w] for w in t] for _, t in self.templates + phrases]
        self.automaton = SuffixAutomaton(coded)
        self.pairs = np.zeros((len(words) + 1,) * 2, bool)
        for t in coded:
            self.pairs[t[:-1], t[1:]] = True
        at = {}
        for (label, _), t in zip(phrases, coded[len(self.templates) :]):
            s = 0
            for token in t:
                s = self.automaton.next[s][token]
            at[s] = (label, len(t))
        self.base: list[tuple[tuple[str, int], ...]] = []
        for s in range(len(self.automaton.next)):
            own = []
            while s > 0:
                if s in at:
                    own.append(at[s])
                s = self.automaton.link[s]
            self.base.append(tuple(own))

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans [(label, first word, last word)]."""
        words = (text or "").encode().translate(_TABLE).split()
        ids = np.fromiter((self.ids.get(w, 0) for w in words), np.int32, len(words))
        linked = np.flatnonzero(self.pairs[ids[:-1], ids[1:]]) if len(ids) > 1 else np.empty(0, np.int64)
        if not len(linked):
            return len(words), 0, None, None, "", "", 0.0, []
        places, base_labels, matches = [], set(), []
        auto = self.automaton
        breaks = np.flatnonzero(np.diff(linked) > 1)
        for a, z in zip(linked[np.concatenate(([0], breaks + 1))].tolist(), linked[np.append(breaks, len(linked) - 1)].tolist()):
            state = length = 0
            for at, token in enumerate(ids[a : z + 2].tolist(), a):
                state, longer = auto.step(state, length, token)
                if longer <= length and length >= MIN_MATCH:
                    matches.append((at - length, at, held))
                length, held = longer, state
                for label, n in self.base[state]:
                    if length >= n:
                        places.append(at - n + 1)
                        base_labels.add(label)
            if length >= MIN_MATCH:
                matches.append((z + 2 - length, z + 2, held))
        score, labels, spans = self._chain(matches)
        if base_labels:
            score = max(score, 1.0)
        first, last = (min(places), max(places)) if places else (None, None)
        join = lambda x: ",".join(sorted(x))
        return len(words), len(places), first, last, join(base_labels), join(base_labels | labels), score, spans

    def _chain(self, matches: list[tuple[int, int, int]]) -> tuple[float, set[str], list]:
        """Chains of matches by template: a match goes on with the chain if it follows it closely in the text and further on in the template.

        Of covered templates over the same words, such as licences that share most of their text, the one that covers more counts.
        """
        open_: dict[int, list] = {}  # template: [first word, word after, template place after, words covered]
        best, covered = 0.0, []

        def close(number: int, chain: list) -> None:
            nonlocal best
            label, words = self.templates[number]
            share = min(1.0, chain[3] / len(words))
            best = max(best, share)
            if share >= (1.0 if len(words) <= NOTICE_WORDS else COVER):
                covered.append((-chain[3], -share, chain[0], chain[1] - 1, label))

        for a, z, state in matches:
            for number, end in self.automaton.ends[state]:
                if number >= len(self.templates):
                    continue
                notice = len(self.templates[number][1]) <= NOTICE_WORDS
                if z - a < (MIN_MATCH if notice else MIN_MATCH_TEXT):
                    continue
                start, stop = end + 1 - (z - a), end + 1
                chain = open_.get(number)
                if chain is not None and a - chain[1] <= (MAX_GAP if notice else MAX_GAP_TEXT) and stop > chain[2] and z > chain[1]:
                    chain[3] += min(stop - max(start, chain[2]), z - max(a, chain[1]))
                    chain[1], chain[2] = z, stop
                    continue
                if chain is not None and a < chain[1] and chain[3] >= z - a:
                    continue
                if chain is not None:
                    close(number, chain)
                open_[number] = [a, z, stop, z - a]
        for number, chain in open_.items():
            close(number, chain)
        labels, spans, told = set(), [], []
        for _, _, first, last, label in sorted(covered):
            if not any(a <= last and first <= z for a, z in told):
                labels.add(label)
                spans.append((label, first, last))
                told.append((first, last))
        return best, labels, sorted(spans, key=lambda s: (s[1], s[2], s[0]))


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, last_word: long>>"
)


@lean
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = LicenceScanner()
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), span]
    names = [c.split()[0] for c in _SCHEMA.split(", ")[:9]]
    for b in batches:
        rows = [scanner.scan(t.as_py()) for t in b.column("text")]
        cols = list(zip(*rows)) or [()] * 8
        cols[7] = [[{"label": x, "first_word": a, "last_word": z} for x, a, z in s] for s in cols[7]]
        yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, k) for c, k in zip(cols, kinds)], names)


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per row of docs: the base counts and labels, the labels of covered templates, the best coverage and the spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, _SCHEMA)
