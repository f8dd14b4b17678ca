"""License scans: a generalised suffix automaton over license templates, streamed over files.

The automaton accepts every run of words of every template. Streaming a file's
words through it gives the matching statistics: for every word, the longest run
ending there that some template contains, and the state that stands for it. Runs
of ``MIN_MATCH`` words or more that cannot be extended are matches; matches that
follow one another in the file and in one template, with gaps of at most ``GAP``
words, are chained to spans. A span that covers ``MIN_COVER`` of its template, or
``MIN_WORDS`` words of it, gives the file the template's label.

Naming phrases (``PHRASES``) are found wherever their words stand in a row. They
are the base; the automaton adds labels and never takes one away.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
Defined cases: null and empty texts have no words and no labels; equal texts get
equal results; a file may hold any number of licenses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm.common import whole_text

MIN_MATCH = 5
GAP = 8
MIN_COVER = 0.8
MIN_WORDS = 12

#: Base phrases and their labels: fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public license notices and their labels: fixed values.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software"
        " is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY"
        " KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
        " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
        " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR"
        " OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mit", "Released under the MIT License."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law"
        " or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
        " limitations under the License.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This"
        " program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have"
        " received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
        " the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the"
        " copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
        " without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit"
        " http://creativecommons.org/licenses/by/4.0/.",
    ),
    ("cc-by", "This work is licensed under CC BY 4.0."),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,"
        " sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or"
        " non-commercial, and by any means.",
    ),
]

#: Bytes that separate words become spaces.
_TABLE = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def words_of_text(text: str) -> list[bytes]:
    return text.encode().lower().translate(_TABLE).split()


@dataclass(frozen=True)
class Span:
    """A covered stretch: words ``first`` to ``last`` of the file hold ``covered`` words of the template."""

    label: str
    first: int
    last: int
    covered: int
    share: float


class Automaton:
    """The generalised suffix automaton of word-id sequences, with the places where each state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].append((t, i))
        # a run also ends where the longer runs that it is a suffix of end
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, transitions: dict[int, int], link: int) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state of the parent's longest run plus the word, split off the state that holds it."""
        whole = self.next[parent][word]
        if self.length[whole] == self.length[parent] + 1:
            return whole
        part = self._state(self.length[parent] + 1, dict(self.next[whole]), self.link[whole])
        self.link[whole] = part
        while parent >= 0 and self.next[parent].get(word) == whole:
            self.next[parent][word] = part
            parent = self.link[parent]
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Of every word: the length of the longest run ending there, and its state."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield length, state


class Scanner:
    """Templates and phrases, ready to scan texts."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        cut = [words_of_text(text) for _, text in templates]
        named = [(words_of_text(p), label) for p, label in phrases.items()]
        self.ids: dict[bytes, int] = {}
        for word in [w for t in cut for w in t] + [w for p, _ in named for w in p]:
            self.ids.setdefault(word, len(self.ids))
        sequences = [[self.ids[w] for w in t] for t in cut]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.phrases = [(np.array([self.ids[w] for w in p]), label) for p, label in named]
        # which word may follow which: unknown words (the last row and column) follow nothing
        self.follows = np.zeros((len(self.ids) + 1, len(self.ids) + 1), bool)
        for s in sequences:
            self.follows[s[:-1], s[1:]] = True

    def _matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Maximal runs of at least MIN_MATCH words: first word, length, state.

        A run's neighbours all follow each other in some template, so only
        stretches of that kind are streamed through the automaton.
        """
        linked = self.follows[ids[:-1], ids[1:]]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + 1 < MIN_MATCH:
                continue
            before, of_before = 0, 0
            for i, (length, state) in enumerate([*self.automaton.statistics(ids[a : b + 1].tolist()), (0, 0)]):
                if length <= before and before >= MIN_MATCH:
                    yield a + i - before, before, of_before
                before, of_before = length, state

    def spans(self, ids: np.ndarray) -> list[Span]:
        """Chains of matches, each within one template."""
        done: list[Span] = []
        # per template the chain being built: first and last word, last template word, words covered
        open_chains: dict[int, list[int]] = {}

        def end(t: int) -> None:
            first, last, _, covered = open_chains.pop(t)
            done.append(Span(self.labels[t], first, last, covered, covered / self.sizes[t]))

        for first, length, state in self._matches(ids):
            last = first + length - 1
            for t, place in self.automaton.ends[state]:
                chain = open_chains.get(t)
                if chain is not None:
                    ahead, onward = last - chain[1], place - chain[2]
                    if 0 < ahead and 0 < onward and first - chain[1] - 1 <= GAP and place - length - chain[2] <= GAP:
                        chain[3] += min(length, ahead, onward)
                        chain[1], chain[2] = last, place
                        continue
                    if first <= chain[1] and chain[0] <= first:
                        continue  # another place of words that the chain has
                    end(t)
                open_chains[t] = [first, last, place, length]
        for t in list(open_chains):
            end(t)
        return sorted((s for s in done if s.share >= MIN_COVER or s.covered >= MIN_WORDS), key=lambda s: (s.first, s.last, s.label))

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[Span]]:
        """Number of words, base places (first word, label) and spans of a text."""
        words = words_of_text(text)
        look = self.ids.get
        ids = np.array([look(w, -1) for w in words], np.int64)
        places: list[tuple[int, str]] = []
        for phrase, label in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n > 0:
                here = ids[:n] == phrase[0]
                for j in range(1, len(phrase)):
                    here &= ids[j : n + j] == phrase[j]
                places += [(p, label) for p in np.flatnonzero(here).tolist()]
        return len(words), sorted(places), self.spans(ids) if len(ids) >= MIN_MATCH else []


def scanned(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: word count, base places, labels, score, and the spans found.

    The score is 1 for a named license, else the share of its template that the best span covers.
    """
    kind = documents.schema[key].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    fields += [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, places, spans = scanner.scan(text.as_py())
                base = {label for _, label in places}
                every = base | {s.label for s in spans}
                score = 1.0 if base else min(1.0, max((s.share for s in spans), default=0.0))
                first, last = (places[0][0], places[-1][0]) if places else (None, None)
                rows.append((n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(every)), score, [vars(s) for s in spans]))
            columns = zip(*rows) if rows else [[] for _ in fields]
            arrays = [batch.column(0), *[pa.array(list(c), t) for c, (_, t) in zip(columns, fields)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *[name for name, _ in fields]])

    schema = (
        f"`{key}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double,"
        " spans array<struct<label:string,first:bigint,last:bigint,covered:bigint,share:double>>"
    )
    return documents.select(key, whole_text().alias("text")).mapInArrow(run, schema)
