"""Phrase collocation mining: per language, the phrases of two and three words that stand together more often than their parts.

Counting sorts suffixes. A task holds the words of its documents as one array;
a suffix pointer is the place of a word, its key the ``DEPTH`` words from there to
the end of the piece. A multikey three-way quicksort splits pointers by one word
at a time into less, equal and greater, and an equal partition at depth d is a
phrase of d words whose count is the partition's size. Each task's partitions, a
row for each of them and its size, are routed by their leading words, so a very
common word or pair arrives as one row from each task and never as its
occurrences. Where all rows of the same leading words meet, the same sort runs
over them by weight and abandons every partition that weighs less than ``LEAST``,
whatever is left to sort in it; the others are the frequent phrases. This goes
one depth at a time, and suffixes of abandoned partitions are not sorted deeper:
a bitmap of bounded size tells all tasks which phrases of the depth before are
frequent (a false hit costs a row and changes no count). Scores need counts
of a candidate's parts, which are frequent as well: joins of these tables.

Words and phrases are named by 64-bit hashes until the end.

Defined cases: null and empty texts have no words; a null language is ``und``;
very long texts are taken whole; rows of one id and repeated rows count each; ties
of score and count are ordered by phrase, in UTF-8 byte order; columns other than
text and lang are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.llm.common import shuffle_width, whole_text
from shopsight.session import materialize

#: Words of the longest phrase.
DEPTH = 3
#: Occurrences that a candidate has at least.
LEAST = 10
#: A candidate goes if a longer one with so many percent of its count holds it.
WITHIN_PERCENT = 50
#: Phrases reported for each language.
TOP = 2_000
#: Words that a task sorts at once.
CHUNK = 400_000
#: Bits of the bitmap of frequent phrases.
BITS = 1 << 26
#: Partitions of so few pointers are sorted by comparison.
SMALL = 4_096

#: Characters that end a piece, and the tab that parts words, as one byte each.
_TO_MARK = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"........." + b" ")
_MARK = b"."
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_with_marks(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with a mark at the end of each piece (no word holds a mark)."""
    data = text.encode().lower().translate(_TO_MARK)
    return [*data.replace(_MARK, b" . ").split(), _MARK]


def suffix_keys(words: np.ndarray, mark: np.uint64) -> np.ndarray:
    """DEPTH rows: of each word that is no mark, its hash and those of the words after it in its piece (0: none)."""
    keys = np.zeros((DEPTH, len(words)), np.uint64)
    keys[0] = words
    within = words != mark
    for d in range(1, DEPTH):
        keys[d, :-d] = words[d:]
        within[:-d] &= words[d:] != mark
        within[-d:] = False
        keys[d][~within] = 0
    return keys[:, words != mark]


def _median(x: np.ndarray) -> np.uint64:
    return np.sort(x[:: max(1, len(x) // 31)])[min(len(x), 31) // 2]


def partitions(keys: np.ndarray, weights: np.ndarray, least: int, shallow: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Depth, a pointer of each and the weights of all equal partitions that weigh ``least`` or more, from depth ``shallow`` on.

    A multikey three-way quicksort of the pointers 0 .. len(weights) - 1. A key
    0 ends a suffix. Partitions that weigh less are abandoned unsorted.
    """
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        pointers, depth = stack.pop()
        if weights[pointers].sum() < least:
            continue
        if len(pointers) <= SMALL:
            yield from _sorted_small(pointers, keys, weights, depth, least, shallow)
            continue
        key = keys[depth, pointers]
        pivot = _median(key)
        less, equal = key < pivot, key == pivot
        stack.append((pointers[less], depth))
        stack.append((pointers[~(less | equal)], depth))
        pointers = pointers[equal]
        weight = weights[pointers].sum()
        if pivot and weight >= least:
            if depth + 1 >= shallow:
                yield depth + 1, pointers[:1], np.array([weight])
            if depth + 1 < len(keys):
                stack.append((pointers, depth + 1))


def _sorted_small(pointers: np.ndarray, keys: np.ndarray, weights: np.ndarray, depth: int, least: int, shallow: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same of a small partition whose keys agree above ``depth``."""
    own = keys[depth:, pointers]
    order = np.lexsort(own[::-1])
    own, pointers = own[:, order], pointers[order]
    new = np.zeros(len(pointers), bool)
    new[0] = True
    for d in range(len(own)):
        new[1:] |= own[d, 1:] != own[d, :-1]
        start = np.flatnonzero(new)
        weight = np.add.reduceat(weights[pointers], start)
        keep = (weight >= least) & (own[d, start] != 0)
        if depth + d + 1 >= shallow and keep.any():
            yield depth + d + 1, pointers[start[keep]], weight[keep]


def _names(lang: str, keys: np.ndarray) -> np.ndarray:
    """64-bit names of phrases, by their language and all their words."""
    h = np.full(keys.shape[1], xxhash.xxh3_64_intdigest(lang) ^ len(keys), np.uint64)
    for k in keys:
        h = (h ^ k) * _ODD[0]
        h = (h ^ (h >> np.uint64(31))) * _ODD[1]
    return h ^ (h >> np.uint64(29))


def _among(names: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = names % np.uint64(8 * len(bitmap))
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: What a task sends to one part: of each language (and depth) an item in every list.
SENT = "part int, lang array<string>, depth array<int>, keys array<binary>, weights array<binary>, words array<array<binary>>"
SENT_TYPES = [pa.int32(), *map(pa.list_, (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())))]
FOUND = "lang string, depth int, h1 bigint, h2 bigint, h3 bigint, name bigint, n bigint, word string"


def _counts(lang: str, tokens: list[bytes], depth: int, frequent: np.ndarray | None, parts: int) -> list[tuple]:
    """A task's phrases of one depth and language and their counts, an item for each part; with depth 1, at depth 0, the number of words."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)) | np.uint64(1)  # 0 is none
    mark = np.uint64(xxhash.xxh3_64_intdigest(_MARK)) | np.uint64(1)
    keys = suffix_keys(hashes, mark)[:depth]
    rows = []
    if depth == 1:
        rows.append((xxhash.xxh3_64_intdigest(lang) % parts, lang, 0, b"", np.array([keys.shape[1]], "<u8").tobytes(), None))
        name = dict(zip(hashes.tolist(), tokens))
    else:
        keys = keys[:, keys[-1] != 0]
        keys = keys[:, _among(_names(lang, keys[:-1]), frequent)]
        keys = keys[:, _among(_names(lang, keys[1:]), frequent)]
    found = list(partitions(keys, np.ones(keys.shape[1], np.int64), 1, depth))
    if found:
        own = keys[:, np.concatenate([p for _, p, _ in found])]
        weights = np.concatenate([w for _, _, w in found])
        part = ((_names(lang, own) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((own[0], part))
        own, weights, part = own[:, order], weights[order], part[order]
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
            words = [name[h] for h in own[0, a:b].tolist()] if depth == 1 else None
            rows.append((int(part[a]), lang, depth, own[:, a:b].tobytes(), weights[a:b].astype("<u4").tobytes(), words))
    return rows


def _sent(held: dict[str, list[bytes]], depth: int, frequent: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """The counts of all languages, one row for each part."""
    of: dict[int, list[tuple]] = defaultdict(list)
    for lang, tokens in held.items():
        for part, *item in _counts(lang, tokens, depth, frequent, parts):
            of[part].append(item)
    columns = [list(of), *([[x[i] for x in items] for items in of.values()] for i in range(5))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SENT_TYPES)], names=["part", "lang", "depth", "keys", "weights", "words"])


def _met(lang: str, depth: int, rows: list[tuple[bytes, bytes, list[bytes] | None]], least: int) -> pa.RecordBatch:
    """Frequent phrases of one depth in one part."""
    if depth == 0:
        total = sum(int(np.frombuffer(w, "<u8")[0]) for _, w, _ in rows)
        columns = [[lang], [0], [0], [0], [0], [0], [total], [None]]
    else:
        keys = np.concatenate([np.frombuffer(k, "<u8").reshape(depth, -1) for k, _, _ in rows], axis=1)
        weights = np.concatenate([np.frombuffer(w, "<u4") for _, w, _ in rows]).astype(np.int64)
        some = list(partitions(keys, weights, least, depth))
        pointers = np.concatenate([np.empty(0, np.int64), *[p for _, p, _ in some]]).astype(np.int64)
        n = np.concatenate([np.empty(0, np.int64), *[w for _, _, w in some]])
        h = [keys[d, pointers].view(np.int64) if d < depth else np.zeros(len(n), np.int64) for d in range(DEPTH)]
        if depth == 1:
            name = dict(zip(keys[0].tolist(), (w for _, _, words in rows for w in words)))
            words = [name[k].decode() for k in keys[0, pointers].tolist()]
        else:
            words = [None] * len(n)
        columns = [[lang] * len(n), [depth] * len(n), *h, _names(lang, keys[:, pointers]).view(np.int64), n, words]
    types = [pa.string(), pa.int32(), *[pa.int64()] * 5, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "depth", "h1", "h2", "h3", "name", "n", "word"])


def _bitmap(found: DataFrame) -> np.ndarray:
    """The names of frequent phrases as BITS bits, eight a byte."""
    bit = F.pmod("name", F.lit(BITS)).cast("int")  # BITS is a power of two: the sign does not matter
    held = found.select(F.call_function("div", bit, F.lit(64)).alias("at"), (bit % 64).alias("bit"))
    held = held.groupBy("at").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, "<i8")
    out[held.column("at").to_numpy()] = held.column("bits").to_numpy()
    return out.view(np.uint8)


def phrases_of_depth(documents: DataFrame, depth: int, before: DataFrame | None, least: int) -> DataFrame:
    """The rows of ``frequent_phrases`` with one depth, where ``before`` has those of the depth before; stored."""
    spark = documents.sparkSession
    parts = 2 * shuffle_width(spark)
    frequent = spark.sparkContext.broadcast(None if before is None else _bitmap(before))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = words_with_marks(text)
                held[lang] += words
                size += len(words)
                if size >= CHUNK:
                    yield _sent(held, depth, frequent.value, parts)
                    held.clear()
                    size = 0
        if held:
            yield _sent(held, depth, frequent.value, parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come ordered by part
        last, held = None, defaultdict(list)
        for batch in batches:
            for part, *items in zip(*(c.to_pylist() for c in batch.columns)):
                if last != part:
                    yield from (_met(*k, rows, least) for k, rows in held.items())
                    last, held = part, defaultdict(list)
                for lang, d, *row in zip(*items):
                    held[lang, d].append(row)
        yield from (_met(*k, rows, least) for k, rows in held.items())

    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().alias("text"))
    sent = texts.mapInArrow(gather, SENT)
    return materialize(sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, FOUND))


def frequent_phrases(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, depth, h1 to h3, name, n and (of single words) word of all phrases of up to DEPTH words that occur ``least`` times; at depth 0 the words of a language."""
    found = [phrases_of_depth(documents, 1, None, least)]
    for depth in range(2, DEPTH + 1):
        found.append(phrases_of_depth(documents, depth, found[-1].where("depth > 0"), least))
    return found[0].unionByName(found[1]).unionByName(found[2])


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top, bottom = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right)
    return F.call_function("div", top, bottom)


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases."""
    found = frequent_phrases(documents, least)
    total = found.where("depth = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    one = found.where("depth = 1")
    words = lambda i: one.select("lang", F.col("h1").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("n").alias(f"f{i}"))
    two, three = (found.where(F.col("depth") == d).withColumnRenamed("n", "a").drop("word", "depth", "name") for d in (2, 3))
    pairs = lambda i: two.select("lang", F.col("h1").alias(f"h{i}"), F.col("h2").alias(f"h{i + 1}"), F.col("a").alias(f"p{i}"))

    # the counts of the most frequent triples that start or end with a pair
    around = three.groupBy("lang", "h1", "h2").agg(F.max("a").alias("x"))
    around = around.unionByName(three.groupBy("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2")).agg(F.max("a").alias("x")))
    around = around.groupBy("lang", "h1", "h2").agg(F.max("x").alias("longer"))
    free = two.join(around, ["lang", "h1", "h2"], "left").where(F.coalesce(100 * F.col("longer") < WITHIN_PERCENT * F.col("a"), F.lit(True)))
    named = free.join(words(1), ["lang", "h1"]).join(words(2), ["lang", "h2"])
    short = named.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))

    named = three.join(words(1), ["lang", "h1"]).join(words(2), ["lang", "h2"]).join(words(3), ["lang", "h3"])
    named = named.join(pairs(1), ["lang", "h1", "h2"]).join(pairs(2), ["lang", "h2", "h3"])
    named = named.withColumn("s1", _score("a", "f1", "p2")).withColumn("s2", _score("a", "p1", "f3"))
    after_first = F.col("s1") <= F.col("s2")
    long = named.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(after_first, F.col("f1")).otherwise(F.col("p1")).alias("l"),
        F.when(after_first, F.col("p2")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = short.unionByName(long).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (VALUES (1), (2), (3)) AS depth(k))
), f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT f.lang, f.phrase, f.c AS a, f.k, cut,
         array_to_string(string_split(f.phrase, ' ')[1:cut], ' ') AS head, array_to_string(string_split(f.phrase, ' ')[cut + 1:], ' ') AS rest
  FROM f, (VALUES (1), (2)) AS places(cut) WHERE f.k >= 2 AND cut < f.k
), scored AS (
  SELECT cuts.*, h.c AS l, t.c AS r, (1000000::hugeint * cuts.a * cuts.a) // (h.c::hugeint * t.c) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN f t ON t.lang = cuts.lang AND t.phrase = cuts.rest
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, pair, max(c) AS c FROM (
    SELECT lang, c, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS pair FROM f WHERE k = 3
  ) GROUP BY lang, pair
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.pair = lowest.phrase
  WHERE inside.c IS NULL OR 100 * inside.c < {WITHIN_PERCENT} * lowest.a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, total.n::bigint AS n, score::bigint AS score
FROM kept JOIN total ON total.lang = kept.lang
QUALIFY rank <= {TOP}
"""
