"""Word shingles as 64-bit hashes, and stored sets of them that are looked up by the name of a set."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.llm.common import shuffle_width
from shopsight.session import ensure_checkpoint_dir, shuffles_removed

#: Texts to read again are looked for by hash bucket first: one bit for each of 64 times so many buckets, in at most so many rows.
BITMAP_WORDS = 1 << 18

_ODD = np.random.default_rng(13).integers(1, 2**63, 66, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[64]
    x = (x ^ (x >> np.uint64(29))) * _ODD[65]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``width`` words; of fewer words, one hash of them all; of none, none.

    Words are runs of anything but ASCII white space, A-Z lower-cased.
    """
    words = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        return _mixed((hashes * _ODD[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - width + 1
    rolled = hashes[:n] * _ODD[0]
    for i in range(1, width):
        rolled += hashes[i : i + n] * _ODD[i]
    return np.unique(_mixed(rolled))


def parity(shingles: np.ndarray) -> np.ndarray:
    """One bit for each residue of the hashes: whether an odd number of shingles has it. As many residues, a power of two, as shingles or more."""
    bits = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of shingles in only one of two sets, of their parities; the longer one is folded."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """The 128-bit name of a set, as two signed 64-bit integers: equal sets have equal names."""
    whole = xxhash.xxh3_128_intdigest(np.ascontiguousarray(shingles).tobytes())
    return tuple(np.array([whole >> 64, whole & (2**64 - 1)], np.uint64).view(np.int64).tolist())


def _bucket(doc_id: Column) -> tuple[Column, Column]:
    """Row and bit of a document id in the bitmap."""
    h = F.xxhash64(doc_id)
    return F.pmod(h, F.lit(BITMAP_WORDS)), F.pmod(F.shiftright(h, 24), F.lit(64)).cast("int")


def _bucketed(sets: DataFrame) -> DataFrame:
    """Store a table with one row for each node in buckets of it, so that joins on node leave it where it lies."""
    spark, name = sets.sparkSession, f"sets_{uuid.uuid4().hex}"
    buckets = shuffle_width(spark)
    dealt = sets.repartition(buckets, "node").dropDuplicates(["node"])  # a task has one bucket
    with shuffles_removed(spark):
        dealt.write.bucketBy(buckets, "node").option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}").saveAsTable(name, format="parquet")
    return spark.table(name)


def stored_sets(documents: DataFrame, holders: DataFrame, shingles: Callable[[str], np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """node, shingles (little-endian unsigned 64-bit integers, sorted) and parity of every wanted set, as a stored table in buckets of node.

    ``documents`` has doc_id and text, ``holders`` node, holder (a doc_id) and
    holder_hash (xxhash64 of the text, which tells rows of one id apart); ``keep``
    names bigint columns of it that the result has too. A bitmap
    of the holders' ids, of bounded size, leaves most other texts where they are;
    the join after it decides.
    """
    row, bit = _bucket(F.col("holder"))
    bitmap = holders.groupBy(row.alias("__row")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    row, bit = _bucket(F.col("doc_id"))
    near = documents.select("doc_id", "text", row.alias("__row"), bit.alias("__bit")).join(F.broadcast(bitmap), "__row")
    near = near.where(F.call_function("shiftrightunsigned", F.col("__bits"), F.col("__bit")).bitwiseAND(F.lit(1)) == 1)
    same = F.col("doc_id").eqNullSafe(F.col("holder")) & (F.xxhash64("text") == F.col("holder_hash"))
    texts = near.select("doc_id", "text").join(holders, same).select("node", *keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            blobs = [pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array([parity(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", *keep)), *blobs], names=["node", *keep, "shingles", "parity"])

    return _bucketed(texts.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("node", *keep)) + ", shingles binary, parity binary"))


def as_set(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")
