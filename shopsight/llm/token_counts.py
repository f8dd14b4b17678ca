"""Token counts: greedy longest-match word pieces, counted by one pass over a failure-linked trie.

The vocabulary is a trie over characters. Greedy longest-match cuts a word at the
longest token that starts it, then at the longest that starts the rest, and so on.
Every trie node has a failure link: the node reached by cutting off the tokens
that greedy matching takes from the node's string, once no longer match can follow; and the
number of tokens so cut off. Both are computed beforehand, so a word is counted
in one pass: a step either reads a character or follows a link and adds its
number. No piece is ever built.

A vocabulary with an end-of-word suffix has two kinds of tokens: those with it
match only up to a word's end, the others only before it. A node therefore has a
second number: the tokens of a word's end that is the node's string.

A word that the vocabulary cannot build counts as one unknown token. Words are
those between ASCII white space, lower-cased; they are counted once per worker and
kept in a bounded memo. Defined cases: null and empty texts have no tokens; very
long texts are taken whole, one at a time; repeated rows get equal results, and
ties cannot occur; columns other than the key and text are not read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm.bpe import byte_characters, vocabulary_path
from shopsight.llm.common import whole_text

MEMO_WORDS = 400_000


class LongestMatch:
    """The trie of a vocabulary: ``next[node]`` by character, ``link[node]``, ``popped[node]`` and ``ended[node]``.

    Tokens that end in ``suffix`` stand at a word's end only, the others before it
    only; without a suffix every token may stand anywhere.
    """

    def __init__(self, vocabulary: Iterable[str], suffix: str = ""):
        self.next: list[dict[str, int]] = [{}]
        # may stand before a word's end; may stand at it
        inner, final = [False], [False]
        for word in sorted(set(vocabulary)):
            ends = word.endswith(suffix)
            word = word.removesuffix(suffix)
            if not word:
                continue
            node = 0
            for c in word:
                child = self.next[node].get(c)
                if child is None:
                    child = self.next[node][c] = len(self.next)
                    self.next.append({})
                    inner.append(False)
                    final.append(False)
                node = child
            final[node] |= ends
            inner[node] |= not ends or not suffix
        # link -1: no way on; the root has none
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        # tokens of a word's end that is the node's string, cut from its start; -1: it cannot be built
        self.ended = [-1] * len(self.next)
        self.ended[0] = 0
        queue = deque((0, c, child) for c, child in self.next[0].items())
        while queue:
            parent, c, node = queue.popleft()
            # the tokens cut off the parent's string, then more until the character can follow
            at, count = self.link[parent], self.popped[parent]
            while at >= 0 and c not in self.next[at]:
                count += self.popped[at]
                at = self.link[at]
            if inner[node]:
                self.link[node], self.popped[node] = 0, 1
            elif at >= 0:
                self.link[node], self.popped[node] = self.next[at][c], count
            if final[node]:
                self.ended[node] = 1
            elif at >= 0 and self.ended[self.next[at][c]] > 0:
                # a shorter string, so it is known
                self.ended[node] = count + self.ended[self.next[at][c]]
            queue.extend((node, d, child) for d, child in self.next[node].items())

    def count(self, word: str) -> int | None:
        """Number of greedy longest-match tokens of a word; None if it cannot be built."""
        node = total = 0
        step, link, popped = self.next, self.link, self.popped
        for c in word:
            while c not in step[node]:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return None
            node = step[node][c]
        end = self.ended[node]
        return None if end < 0 else total + end


class WordCounter:
    """Counts for whole words, over byte characters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.machine = LongestMatch(model["vocab"], model.get("end_of_word_suffix") or "")
        self._bytes = byte_characters()
        self._memo: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        known = self._memo.get(word)
        if known is None:
            found = self.machine.count("".join([self._bytes[b] for b in word]))
            known = 1 if found is None else found
            if len(self._memo) >= MEMO_WORDS:
                self._memo.clear()
            self._memo[word] = known
        return known


_LOADED: dict[str, WordCounter] = {}


def counted(documents: DataFrame, name: str = "word_bpe_49k.json", key: str = "doc_id") -> DataFrame:
    """The key, n_words and n_tokens of every document; the vocabulary is a tokenizer file's tokens."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(name)
        counter = _LOADED.get(path) or _LOADED.setdefault(path, WordCounter(path))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = text.as_py().lower().encode().split()
                words.append(len(found))
                tokens.append(sum(map(counter.count, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[key, "n_words", "n_tokens"])

    return documents.select(key, whole_text().alias("text")).mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_tokens bigint")
