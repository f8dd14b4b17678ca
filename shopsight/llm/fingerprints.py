"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph (``\\n``-split line) hashes to a wide vector; a document's
fingerprint is the lane-wise sum of its paragraphs' vectors modulo 2^32. So
documents with the same multiset of paragraphs have equal fingerprints in any
paragraph order, and inserting or deleting a paragraph is one vector addition
or subtraction (:func:`combine`).

A vector has two parts, both additive over paragraphs:

* ``digest``: 16 lanes of 32 bits cut from the paragraph's SHA-512. They decide
  equality.
* ``sketch``: 64 lanes counting, over the paragraph's short word runs, how many
  hash to 1 in that bit, and ``n``, the number of runs. Read as ``2 * lane - n``
  they are random projections of the document's run counts, so the cosine of
  two sketches estimates how much two documents share. They decide likeness.

Defined cases: a null text is the empty text; the empty text is one empty
paragraph; texts without words have an empty sketch and are like equal
fingerprints only. Repeated rows get equal results. Everything is built-in
column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.llm.common import shuffle_width, whole_text

DIGEST_LANES = 16
SKETCH_LANES = 64
LANE_MASK = (1 << 32) - 1
#: While counting, four 16-bit lanes share a long; so runs are counted in blocks that cannot overflow one.
PLANES = 16
PLANE_MASK = 0x0001000100010001
BLOCK_RUNS = 60_000

#: One run: up to three words of a line; a word that ends in punctuation ends its run,
#: so runs fall in step again soon after an edit.
RUN_PATTERN = r"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.,;:!?][\x20\x09\x0B-\x0D]+){0,2}[^\x20\x09-\x0D]+"


def _lane_sum(digests: Column, lane: int) -> Column:
    part = lambda d: F.conv(F.substring(d, 8 * lane + 1, 8), 16, 10).cast("long")
    return F.aggregate(digests, F.lit(0).cast("long"), lambda a, d: (a + part(d)).bitwiseAND(F.lit(LANE_MASK)))


def _plane_counts(blocks: Column, bit: int) -> Column:
    """Of each block of hashes: how many have bits ``bit``, ``bit + 16``, ``bit + 32`` and ``bit + 48``, packed."""
    return F.transform(
        blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, h: a + F.shiftright(h, bit).bitwiseAND(F.lit(PLANE_MASK)))
    )


def _lanes(planes: Column) -> Column:
    """The 64 lane sums of all planes and blocks."""
    one = lambda plane, shift: F.aggregate(
        plane, F.lit(0).cast("long"), lambda a, x: (a + F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(LANE_MASK))
    )
    return F.flatten(F.transform(planes, lambda plane: F.array(*[one(plane, shift) for shift in (0, 16, 32, 48)])))


def with_vector(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: struct(digest array<long>, n long, sketch array<long>) of the text column."""
    digests, runs, blocks, planes = (f"__{out}_{x}" for x in ("digests", "runs", "blocks", "planes"))
    block = lambda i: F.slice(runs, i * BLOCK_RUNS + 1, F.lit(BLOCK_RUNS))
    return (
        df.withColumn(digests, F.transform(F.split(whole_text(text), "\n", -1), lambda p: F.sha2(p, 512)))
        .withColumn(runs, F.transform(F.regexp_extract_all(whole_text(text), F.lit(RUN_PATTERN), F.lit(0)), lambda r: F.xxhash64(r)))
        .withColumn(blocks, F.transform(F.sequence(F.lit(0), F.floor((F.size(runs) / BLOCK_RUNS)).cast("int")), block))
        .withColumn(planes, F.array(*[_plane_counts(F.col(blocks), i) for i in range(PLANES)]))
        .withColumn(
            out,
            F.struct(
                F.array(*[_lane_sum(F.col(digests), i) for i in range(DIGEST_LANES)]).alias("digest"),
                F.size(runs).cast("long").alias("n"),
                _lanes(F.col(planes)).alias("sketch"),
            ),
        )
        .drop(digests, runs, blocks, planes)
    )


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The vector of two multisets together (``sign`` 1), or of the left without the right (-1)."""
    lanes = lambda name: F.zip_with(left[name], right[name], lambda a, b: (a + sign * b).bitwiseAND(F.lit(LANE_MASK)))
    return F.struct(lanes("digest").alias("digest"), (left["n"] + sign * right["n"]).alias("n"), lanes("sketch").alias("sketch"))


def as_string(vector: Column) -> Column:
    """The fingerprint as text: digest lanes, run count and sketch lanes in fixed-width hex."""
    lanes = lambda name: F.array_join(F.transform(vector[name], lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return F.lower(F.concat(lanes("digest"), F.lit("."), F.hex(vector["n"]), F.lit("."), lanes("sketch")))


def _signed(vector: Column) -> Column:
    """The sketch as 64 numbers around zero."""
    n = vector["n"]
    return F.transform(vector["sketch"], lambda x: (2 * x - n).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two vectors, 0 to 1: 1 for equal digests, else the cosine of the sketches, at least 0.

    ``a`` and ``b`` are structs as made by :func:`with_vector`.
    """
    signed = F.struct(_signed(a).alias("x"), _signed(b).alias("y"))
    # one-element transforms bind the signed lanes once
    cosine = F.transform(
        F.array(signed),
        lambda s: F.try_divide(_dot(s["x"], s["y"]), F.sqrt(_dot(s["x"], s["x"]) * _dot(s["y"], s["y"]))),
    )[0]
    return F.when(a["digest"] == b["digest"], F.lit(1.0)).otherwise(F.coalesce(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))


def _bucket(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, by binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    padded = F.array(*[F.lit(c).cast("long") for c in cuts + [None] * (2**steps - 1 - len(cuts))])
    jumps = F.array(*[F.lit(2**i) for i in reversed(range(steps))])
    return F.aggregate(jumps, F.lit(0), lambda p, j: p + F.when(F.get(padded, p + j - 1) <= key, j).otherwise(0))


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``next``: struct of ``columns`` of the row that follows in descending ``doc_id`` order.

    After the last row comes the first. Rows without an id come last; rows of
    one id are ordered by text. The rows are dealt into id ranges, and the
    first rows of each range are also sent to the range before it, so one
    shuffle of the texts and no global window are needed. Only the range
    borders, at most ``buckets`` ids, pass through the driver.
    """
    spark = docs.sparkSession
    buckets = buckets or 6 * shuffle_width(spark)
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_bucket(F.col("doc_id"), cuts))
    # the highest id of each range that has rows, ranges in the order of the rows
    heads = sorted(((r["b"], r["m"]) for r in ids.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("m")).collect()), reverse=True)
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    slots = range(-1, len(cuts) + 1)
    head_of = dict(heads)
    head = F.array(*[F.lit(head_of.get(b)).cast("long") for b in slots])
    target = F.array(*[F.lit(before.get(b)).cast("int") for b in slots])

    at = F.struct(F.col("__b").alias("b"), F.lit(0).alias("ghost"))
    also = F.struct(F.get(target, F.col("__b") + 1).alias("b"), F.lit(1).alias("ghost"))
    is_head = F.col("doc_id").eqNullSafe(F.get(head, F.col("__b") + 1))
    dealt = docs.withColumn("__b", bucket).withColumn("__at", F.explode(F.when(is_head, F.array(at, also)).otherwise(F.array(at))))
    order = Window.partitionBy("__at.b").orderBy("__at.ghost", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).where(F.col("__at.ghost") == 0).drop("__b", "__at")


def edited_likeness(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness (see the query's contract)."""
    docs = with_vector(documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), "text", "fp")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next.text", F.lit(1), half))
    pairs = with_next(docs, ["text", "fp"], buckets).withColumn("n_chars", F.length("text").cast("long"))
    pairs = with_vector(pairs.withColumn("edited", edited), "edited", "edited_fp")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next.fp")).alias("near_next"),
    )
