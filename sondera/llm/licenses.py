"""Licence scan by a generalised suffix automaton over the words of licence templates.

The automaton accepts every run of words that stands in some template. Streaming a file's words through it gives matching
statistics: at each word the length of the longest run ending there that some template contains, and where in the templates it
stands. Runs that cannot grow any further and are long enough are chained, per template, in rising order in both file and
template with short gaps; a chain that covers enough of its template is a span, and the template's label is found.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import column, prefix_hash, row_of, runs, slices, span_hash, text_buffer

# Phrases that name a licence, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Licences and their notices as their publishers word them. Short licences are whole; of long ones there are the
# notices that files carry here, and all their sections in license_texts, each a template of its own.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions"""
_MIT_REST = f"""The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met"""
_BSD_TWO = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THREE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", _MIT_GRANT),
    ("mit", f"{_MIT_GRANT}: {_MIT_REST}"),
    ("bsd", _BSD_HEAD),
    ("bsd", f"{_BSD_HEAD}: 1. {_BSD_TWO} {_BSD_REST}"),
    ("bsd", f"{_BSD_HEAD}: 1. {_BSD_TWO} 3. {_BSD_THREE} {_BSD_REST}"),
    ("isc", _ISC_GRANT),
    ("isc", f"{_ISC_GRANT} {_ISC_REST}"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("boost", f"""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
{_WARRANTY.replace("PURPOSE AND NONINFRINGEMENT", "PURPOSE, TITLE AND NON-INFRINGEMENT")} IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law. {_WARRANTY} IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("wtfpl", """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long
as the name is changed"""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("apache", """Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,
worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display,
publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""),
    ("apache", """Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,
worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use,
offer to sell, sell, import, and otherwise transfer the Work"""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"""),
    ("gpl", """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and
other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is
intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."""),
    ("gpl", """The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."""),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation"""),
    ("agpl", """it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version"""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at"""),
    ("epl", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available
at"""),
    ("epl", """THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE. ANY USE, REPRODUCTION OR DISTRIBUTION OF THE
PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


#: Files of whole licences, as their publishers word them, by label.
WHOLE = {"apache": ("Apache-2.0",), "artistic": ("Artistic",), "bsd": ("BSD",), "cc0": ("CC0-1.0",), "gfdl": ("GFDL-1.2", "GFDL-1.3"), "gpl": ("GPL-1", "GPL-2", "GPL-3"), "lgpl": ("LGPL-2", "LGPL-2.1", "LGPL-3"), "mpl": ("MPL-1.1", "MPL-2.0")}
#: A section of a whole licence is its next paragraphs until they have so many words.
SECTION_WORDS = 100


@functools.cache
def whole_licences() -> tuple[tuple[str, str], ...]:
    """(label, section) of the licences in license_texts, so that a part that is quoted, and not only the whole, is found."""
    out = []
    for label, names in WHOLE.items():
        for name in names:
            held: list[str] = []
            for paragraph in re.split(r"\n\s*\n", (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text()):
                held.append(paragraph)
                if sum(len(p.split()) for p in held) >= SECTION_WORDS:
                    out.append((label, "\n".join(held)))
                    held = []
            # what is left belongs to the last section
            if held and out:
                out[-1] = (out[-1][0], "\n".join([out[-1][1], *held]))
    return tuple(out)


@dataclass(frozen=True)
class Scan:
    #: Runs shorter than this are not used.
    least_run: int = 4
    #: Words that may be missing or extra between two runs of a chain.
    gap: int = 8
    #: Share of a template that a chain must cover.
    covered: float = 0.8


_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_WORD[0x80:] = True


def scan_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word); A-Z count as a-z."""
    starts, ends, first = runs(_WORD[buf], offs)
    return span_hash(prefix_hash(buf, True), starts, ends), first


def _words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return scan_words(raw, np.array([0, len(raw)]))[0]


class SuffixAutomaton:
    """Generalised: of several sequences of small integers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.own: list[list[tuple[int, int]]] = [[]]
        for s, sequence in enumerate(sequences):
            state = 0
            for at, word in enumerate(sequence):
                state = self._extend(state, word)
                self.own[state].append((s, at + 1))
        self.linked: list[list[int]] = [[] for _ in self.link]
        for state, link in enumerate(self.link[1:], 1):
            self.linked[link].append(state)

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) wherever the state's runs stand: where it ends itself, and where the states that link to it end. Ends are
        kept once, so the automaton grows in proportion to the templates."""
        out, todo = [], [state]
        while todo:
            now = todo.pop()
            out += self.own[now]
            todo += self.linked[now]
        return sorted(out)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.own.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state for the run of p's longest and the word, split off its longer runs where needed."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def stream(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length) after each word: the matching statistics."""
        state = length = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append((state, length))
        return out


class Scanner:
    def __init__(self, p: Scan, templates=None, phrases=PHRASES):
        self.p = p
        templates = (*TEMPLATES, *whole_licences()) if templates is None else templates
        self.labels = [x for x, _ in templates]
        hashed = [_words_of(t) for _, t in templates]
        self.lengths = [len(h) for h in hashed]
        self.phrases = [(label, _words_of(t)) for t, label in phrases]
        self.vocabulary = np.unique(np.concatenate([*hashed, *[h for _, h in self.phrases]]))
        self.automaton = SuffixAutomaton([np.searchsorted(self.vocabulary, h).tolist() for h in hashed])

    def ids(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def base(self, ids: np.ndarray, row: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """(label, indexes of the first words) of the phrases."""
        out = []
        for label, h in self.phrases:
            want = np.searchsorted(self.vocabulary, h)
            n = len(ids) - len(want) + 1
            if n <= 0:
                continue
            ok = row[:n] == row[len(want) - 1 :]
            for k, w in enumerate(want):
                ok &= ids[k : k + n] == w
            out.append((label, np.flatnonzero(ok)))
        return out

    def matches(self, ids: list[int]) -> list[tuple[int, int, int, int]]:
        """(template, place in it, place in the words, length) of the runs that cannot be made longer to the right."""
        stats, out = self.automaton.stream(ids), []
        for k, (state, length) in enumerate(stats):
            grows = k + 1 < len(stats) and stats[k + 1][1] == length + 1
            if length >= self.p.least_run and not grows:
                out += [(t, end - length, k + 1 - length, length) for t, end in self.automaton.ends(state)]
        return out

    def spans(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, share covered) of the chains that cover enough."""
        out = []
        for template in {m[0] for m in found}:
            chain: list[list[int]] = []
            closed: list[list[int]] = []
            mine = sorted((a, b, n) for t, b, a, n in found if t == template)
            for a, b, n in mine:
                # chains that end too far before it are out of reach of all later matches too
                closed += [c for c in chain if a - c[1] > self.p.gap]
                chain = [c for c in chain if a - c[1] <= self.p.gap]
                # onto the chain that covers most, of those that end before it in file and template; overlaps are counted once
                fit = [c for c in chain if 0 < a + n - c[1] and 0 < b + n - c[2] and b - c[2] <= self.p.gap]
                if fit:
                    c = max(fit, key=lambda c: c[3])
                    c[3] += min(n, a + n - c[1], b + n - c[2])
                    c[1], c[2] = a + n, b + n
                else:
                    chain.append([a, a + n, b + n, n])
            for first, end, _, covered in closed + chain:
                share = min(1.0, covered / self.lengths[template])
                if share >= self.p.covered:
                    out.append((template, first, end - 1, share))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict[int, dict]]:
        """Words per row, and for each row with a phrase or a run: n_base, first_word, last_word, base_labels, labels, score and spans."""
        words, first = scan_words(buf, offs)
        ids, row = self.ids(words), row_of(first)
        rows: dict[int, dict] = {}
        entry = lambda r: rows.setdefault(int(r), {"n_base": 0, "at": [], "base": set(), "all": set(), "score": 0.0, "spans": []})
        for label, at in self.base(ids, row):
            for k in at:
                e = entry(row[k])
                e["n_base"] += 1
                e["at"].append(int(k - first[row[k]]))
                e["base"].add(label)
        a, b, _ = runs(ids >= 0, first)
        for k in np.flatnonzero(b - a >= self.p.least_run):
            r = row[a[k]]
            found = self.matches(ids[a[k] : b[k]].tolist())
            if found:
                entry(r).setdefault("found", []).extend((t, at, int(a[k] - first[r]) + i, n) for t, at, i, n in found)
        for e in rows.values():
            for t, lo, hi, share in self.spans(e.pop("found", [])):
                e["all"].add(self.labels[t])
                e["spans"].append({"label": self.labels[t], "first": lo, "last": hi, "covered": share})
                e["score"] = max(e["score"], share)
            # a phrase without a span says half as much as a whole notice
            if e["n_base"]:
                e["score"] = max(e["score"], 0.5)
        return np.diff(first), rows


def _scan_map(shared):
    def run(batches):
        scanner = shared.value
        for batch in batches:
            ids = column(batch, "doc_id")
            buf, offs = text_buffer(column(batch, "text"))
            for a, b, part, po in slices(buf, offs):
                n, found = scanner.scan(part, po)
                none = {"n_base": 0, "at": [], "base": (), "all": (), "score": 0.0, "spans": []}
                rows = [found.get(k, none) for k in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array([e["n_base"] for e in rows], pa.int64()),
                        pa.array([min(e["at"], default=None) for e in rows], pa.int64()), pa.array([max(e["at"], default=None) for e in rows], pa.int64()),
                        pa.array([",".join(sorted(e["base"])) for e in rows]), pa.array([",".join(sorted({*e["base"], *e["all"]})) for e in rows]),
                        pa.array([e["score"] for e in rows], pa.float64()),
                        pa.array([e["spans"] for e in rows], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return run


def scan(docs: DataFrame, p: Scan = Scan(), templates: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (least and largest start of a phrase), base_labels, labels (those of spans
    too), score (largest share of a template covered, 0.5 at least where a phrase stands) and spans.

    A null text counts as empty: no words, no labels (""), score 0. Repeated rows get equal results; an empty table gives
    no rows; columns other than doc_id and text are not read, whatever their names. Texts of any length are streamed whole. Of
    overlapping spans all are given. templates are (label, text) pairs; without them, all notices and sections here. The automaton is made once, from the templates alone, and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(p, templates))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _scan_map(shared), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,covered:double>>")
