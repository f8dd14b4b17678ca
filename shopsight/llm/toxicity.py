"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the presence of its character n-grams (``ORDERS`` code
points of the lower-cased text), hashed to ``BUCKETS``. For each bucket the
training texts give a log-count ratio between the classes; the buckets that
separate them best are kept, and a logistic regression is fitted on presence
times ratio. Scoring sums the products of weight and ratio of a text's kept
buckets.

Training takes labelled rows whose ``crc32(doc_id) % 5`` is not 0, at most
``TRAIN_ROWS`` of them (a seeded sample of the labels). The class counts are
Spark aggregates; the fit itself runs on the driver over the sample's kept buckets,
at most ``TRAIN_ROWS * KEPT`` of them. Nothing but the text enters a score.

Defined cases: a null text is empty; an empty text scores the fitted intercept;
texts shorter than an n-gram have the n-grams they have; rows labelled twice
count twice; labels without a document and null labels are ignored; ties between
buckets go to the lower one; very long texts are taken whole; without rows of both
classes, or without an n-gram that ``MIN_TEXTS`` texts have, every score is the
share of toxic rows but below 0.5, so nothing is called toxic; columns other than
doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shopsight.llm.common import seeded_hash, whole_text
from shopsight.session import materialize

ORDERS = (2, 3, 4, 5, 6)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
TRAIN_ROWS = 16_384
KEPT = 4_096
MIN_TEXTS = 3
FOLDS = 5
#: Toxic rows are few; each counts so many times in the fit.
TOXIC_WEIGHT = 3.0
#: Parts of the sample for the shift of its log odds.
SHIFT_FOLDS = 3
#: Log odds that a model without kept n-grams gives at most: it calls nothing toxic.
NO_EVIDENCE = -1e-6
#: Strength of the penalty on weights, and rounds of the fit.
PENALTY = 2e-4
ROUNDS = 250
SEED = "toxic-1"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, one array per order."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    rolled = points
    for n in range(2, ORDERS[-1] + 1):
        if len(points) < n:
            return
        rolled = rolled[:-1] * _BASE + points[n - 1 :]
        if n in ORDERS:
            yield (((rolled + np.uint64(n)) * _SPREAD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def present(text: str, kept: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text; with ``kept`` (a mask), only those."""
    parts = [b if kept is None else b[kept[b]] for b in ngram_buckets(text)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


@dataclass
class Model:
    """``table[b]``: what bucket b adds to the log odds; ``kept``: mask of the buckets in use."""

    intercept: float
    table: np.ndarray
    kept: np.ndarray

    def score(self, text: str) -> float:
        odds = self.intercept + float(self.table[present(text, self.kept)].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500))))


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the training sample. The sample of labels is bounded, so it is broadcast."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sample = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(seeded_hash(SEED, F.col("doc_id")), "doc_id", "toxic").limit(TRAIN_ROWS)
    return documents.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id")


def class_counts(rows: DataFrame) -> DataFrame:
    """bucket, toxic and clean: training texts of each class that have the bucket (and bucket -1: all of them)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                own = counts[1 if toxic.as_py() else 0]
                own[present(text.as_py())] += 1
                own[BUCKETS] += 1
        some = np.flatnonzero(counts.any(axis=0))
        bucket = np.where(some == BUCKETS, -1, some)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(counts[1][some]), pa.array(counts[0][some])], names=["bucket", "toxic", "clean"])

    sparse = rows.select("text", "toxic").mapInArrow(count, "bucket bigint, toxic bigint, clean bigint")
    return sparse.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _choose(bucket: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept buckets, best first by their z score between the classes, and their log-count ratios."""
    ok = toxic + clean >= MIN_TEXTS
    bucket, toxic, clean = bucket[ok], toxic[ok], clean[ok]
    share = (toxic + clean) / (n1 + n0)
    spread = np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) + 1e-12
    z = np.abs(toxic / n1 - clean / n0) / spread
    best = np.lexsort((bucket, -z))[:KEPT]
    ratio = np.log(((toxic + 1) / (toxic.sum() + len(bucket))) / ((clean + 1) / (clean.sum() + len(bucket))))
    return bucket[best], ratio[best]


def _fit(row: np.ndarray, column: np.ndarray, label: np.ndarray, ratio: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression on presence times ratio, by full-batch Adam steps."""
    n, k = len(label), len(ratio)
    weight, intercept = np.zeros(k + 1), np.log((label.sum() + 0.5) / (n - label.sum() + 0.5))
    weight[k] = intercept
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    value = ratio[column]
    share = np.where(label > 0, TOXIC_WEIGHT, 1.0)
    share /= share.sum()
    for step in range(1, ROUNDS + 1):
        odds = np.bincount(row, weights=weight[column] * value, minlength=n) + weight[k]
        error = (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - label) * share
        slope = np.append(np.bincount(column, weights=error[row] * value, minlength=k) + PENALTY * weight[:k], error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weight -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return float(weight[k]), weight[:k] * ratio


def _shift(row: np.ndarray, column: np.ndarray, label: np.ndarray, ratio: np.ndarray) -> float:
    """What takes the bias of the weighted fit off the log odds: rows scored by fits without them get as many toxic ones in sum as they are."""
    n, part = len(label), np.arange(len(label)) % SHIFT_FOLDS
    odds = np.empty(n)
    for fold in range(SHIFT_FOLDS):
        rest, place = part != fold, np.cumsum(part != fold) - 1
        used = rest[row]
        intercept, effect = _fit(place[row[used]], column[used], label[rest], ratio)
        odds[~rest] = intercept + np.bincount(row, weights=effect[column], minlength=n)[~rest]
    low, high = -20.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        if (1 / (1 + np.exp(-np.clip(odds + middle, -500, 500)))).sum() < label.sum():
            low = middle
        else:
            high = middle
    return middle


def train(documents: DataFrame, labels: DataFrame) -> Model:
    rows = materialize(training_rows(documents, labels))
    counts = class_counts(rows).where((F.col("bucket") < 0) | (F.col("toxic") + F.col("clean") >= MIN_TEXTS)).toArrow()
    bucket, toxic, clean = (counts.column(c).to_numpy() for c in ("bucket", "toxic", "clean"))
    n1, n0 = int(toxic[bucket < 0].sum()), int(clean[bucket < 0].sum())
    table, kept = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, bool)
    real = bucket >= 0
    chosen, ratio = _choose(bucket[real], toxic[real], clean[real], n1, n0) if n1 and n0 else ([], [])
    if not len(chosen):
        return Model(min(float(np.log((n1 + 0.5) / (n0 + 0.5))), NO_EVIDENCE), table, kept)
    kept[chosen] = True
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [place[present(t.as_py(), kept)].astype(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "found"])

    some = rows.mapInArrow(features, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, found array<int>").toArrow()
    order = np.lexsort((some.column("toxic").to_numpy(), some.column("doc_id").to_numpy()))
    found = some.column("found").combine_chunks()
    sizes, flat = np.diff(found.offsets.to_numpy()), found.flatten().to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    label = (some.column("toxic").to_numpy()[order] != 0).astype(np.float64)
    row = np.repeat(rank, sizes)
    by = np.lexsort((flat, row))
    cells = row[by], flat[by].astype(np.int64), label, ratio
    intercept, effect = _fit(*cells)
    table[chosen] = effect
    return Model(intercept + _shift(*cells), table, kept)


def scored(documents: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """The documents with the score of their text."""
    model = documents.sparkSession.sparkContext.broadcast(model)
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(t.as_py() or "") for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    schema = StructType([*documents.schema.fields, StructField(out, DoubleType())])
    return documents.mapInArrow(run, schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = scored(documents.select("doc_id", "text"), train(documents, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
