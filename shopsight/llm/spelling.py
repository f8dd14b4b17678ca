"""Spelling variant grouping: words that differ by one code point, and the form that each is a variant of.

A word's frequency vector counts its letters by group (``GROUPS``). One inserted
or deleted code point changes one count by one; a replaced one adds to one count
and takes from another, or changes none. A trie arranges the words by successive
counts, and a depth-first search for a word follows its own counts with a budget
of one surplus and one deficit to spend on the way; the words at the leaves that
it reaches are verified by comparing them.

The trie is split at its top: the length and the first counts name a branch, and a
word is sent to its own branch and, with what it has spent, to those
branches that one surplus or deficit in the first counts leads to. So many counts
name a branch that no branch has more than ``BRANCH`` words, as far as the groups
go. Each task builds the rest of its branches one at a time. Searches go one
way only (to shorter words; of equal length, with the surplus before the deficit;
of equal vectors, from the smaller word), so a pair of words is found once.

Defined cases: null, empty and wordless texts have no words; a missing doc_id is
the empty text in the hash; very long texts are taken whole; repeated rows count
each; ties of n go to the word that is smaller in code points; columns other than
doc_id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm.common import whole_text
from shopsight.session import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Of so many hashes one deletes a code point of its run.
DELETE_EVERY = 97
#: Code points and occurrences that a word has at least.
SHORTEST, LEAST = 5, 3
#: A form has at least so many times the occurrences of its variant.
TIMES = 2
#: Groups of the frequency vector (fixed values): one for each letter, the common ones first, and six of the other code points.
LETTERS = "eainsrtoldcumhpgbfyvwkzxjq"
OTHERS = 6
#: Words of a branch that a task holds.
BRANCH = 20_000
#: Distinct words that a task counts before it sends them on.
FLUSH = 200_000

_GROUP_OF = {c: i for i, c in enumerate(LETTERS)}
GROUPS = len(LETTERS) + OTHERS
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vector(word: str) -> tuple[int, ...]:
    """The counts of a word's code points by group."""
    counts = [0] * GROUPS
    for c in word:
        counts[_GROUP_OF[c] if c in _GROUP_OF else len(LETTERS) + ord(c) % OTHERS] += 1
    return tuple(counts)


def near(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def counted_words(documents: DataFrame) -> DataFrame:
    """word and n of all words that are long and frequent enough; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                seed = crc32(f"{doc_id}:".encode())
                for word, n in Counter(RUN.findall(text.translate(_LOWER))).items():
                    h = crc32(word.encode(), seed)
                    if h % DELETE_EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= SHORTEST:
                        counts[word] += n
                if len(counts) >= FLUSH:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    def rows(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    texts = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), whole_text().alias("text"))
    found = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(found.where(F.col("n") >= LEAST))


def branch(length: int, counts: tuple[int, ...]) -> bytes:
    """The name of a branch."""
    return bytes([min(length, 255) % 256, length // 255 % 256, *(min(c, 255) for c in counts)])


def visits(word: str, top: int) -> Iterator[tuple[bytes, int, int]]:
    """Branch, surplus and deficit left of every branch that a word's search enters (its own, with neither, to be stored there, first)."""
    first, n = vector(word)[:top], len(word)
    put = lambda *at: tuple(c + at.count(i) - at.count(~i) for i, c in enumerate(first))
    own = branch(n, first)
    yield own, -1, -1
    # one code point fewer
    yield branch(n - 1, first), 0, 1
    for i in range(top):
        if first[i]:
            yield branch(n - 1, put(~i)), 0, 0
    # another code point: the surplus stands before the deficit
    yield own, 1, 1
    for i in range(top):
        yield branch(n, put(i)), 0, 1
    for i, j in combinations(range(top), 2):
        if first[j]:
            yield branch(n, put(i, ~j)), 0, 0


def search(trie: dict, counts: tuple[int, ...], level: int, surplus: int, deficit: int) -> Iterator[list]:
    """The leaves of a branch that the counts from ``level`` on lead to when the whole budget is spent, or, with (1, 1) left, none of it."""
    stack = [(trie, level, surplus, deficit)]
    while stack:
        node, level, surplus, deficit = stack.pop()
        while True:
            if level == GROUPS:
                if surplus == deficit:
                    yield node
                break
            c = counts[level]
            level += 1
            if surplus:
                if (child := node.get(c + 1)) is not None:
                    stack.append((child, level, 0, deficit))
            elif deficit and c and (child := node.get(c - 1)) is not None:
                stack.append((child, level, surplus, 0))
            node = node.get(c)
            if node is None:
                break


class Branch:
    """The words of one branch, and what the searches in it have found: of each word the number of near words and the best of them."""

    def __init__(self, top: int):
        self.top, self.trie, self.found = top, {}, {}

    def add(self, word: str, n: int) -> None:
        counts = vector(word)
        node = self.trie
        for c in counts[self.top : -1]:
            node = node.setdefault(c, {})
        node.setdefault(counts[-1], []).append((word, n))

    def visit(self, word: str, n: int, surplus: int, deficit: int) -> None:
        same = surplus == 1 and deficit == 1
        for leaf in search(self.trie, vector(word), self.top, surplus, deficit):
            for other, m in leaf:
                # with nothing spent the vectors are equal: the smaller word has looked for the larger
                if near(word, other) and (not same or word < other or vector(word) != vector(other)):
                    self.meet(word, other, m)
                    self.meet(other, word, n)

    def meet(self, word: str, other: str, m: int) -> None:
        times, best = self.found.get(word, (0, (1, "")))
        self.found[word] = (times + 1, min(best, (-m, other)))

    def rows(self) -> pa.RecordBatch:
        words = list(self.found)
        found = list(self.found.values())
        columns = [pa.array(words, pa.string())] + [pa.array([get(x) for x in found], t) for get, t in ((lambda x: x[0], pa.int64()), (lambda x: -x[1][0], pa.int64()), (lambda x: x[1][1], pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "times", "m", "other"])


def branch_depth(words: DataFrame) -> int:
    """The number of first counts that name a branch, so that the largest has ``BRANCH`` words at most, if any number does."""
    for top in range(3, GROUPS - 1):
        counts = [F.length("word") - F.length(F.translate("word", c, "")) for c in LETTERS[:top]]
        largest = words.groupBy(F.length("word").alias("size"), *[c.alias(f"c{i}") for i, c in enumerate(counts)]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) <= BRANCH or top == len(LETTERS):
            break
    return top


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, m (the largest n of a near word) and other (the least of those) of every word with a near one."""
    top = branch_depth(words)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*v, w, n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) for v in visits(w, top)]
            if rows:
                columns = zip(list(zip(*rows)), (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["branch", "surplus", "deficit", "word", "n"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come ordered by branch, its own words (deficit -1) first
        last, held = None, Branch(top)
        for batch in batches:
            for name, surplus, deficit, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if name != last:
                    if held.found:
                        yield held.rows()
                    last, held = name, Branch(top)
                if deficit < 0:
                    held.add(word, n)
                elif held.trie:
                    held.visit(word, n, surplus, deficit)
        if held.found:
            yield held.rows()

    sent = words.mapInArrow(send, "branch binary, surplus int, deficit int, word string, n bigint")
    met = sent.repartition("branch").sortWithinPartitions("branch", "deficit").mapInArrow(look, "word string, times bigint, m bigint, other string")
    best = met.groupBy("word").agg(F.sum("times").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.m")).alias("m"), F.col("best.other").alias("other"))


def variants(documents: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = counted_words(documents)
    is_form = F.col("m") >= TIMES * F.col("n")
    out = words.join(near_words(words), "word", "left")
    out = materialize(
        out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("other")).alias("form"), F.when(is_form, F.col("m")).alias("form_n"))
    )
    # a form occurs twice as often as its variant: no circles, and few steps
    ends = out.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        ends = materialize(ends)
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("end"))
        stepped = ends.join(further, "root").select("word", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved"))
        stepped = materialize(stepped)
        ends = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return out.join(ends, "word").select("word", "form", "root", "n", "n_near", "form_n")
