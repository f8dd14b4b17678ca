"""RFM segmentation: log-scaled features, KMeans with restarts, silhouette, profiles.

KMeans seeds with Spark ML's k-means||, once for each k and restart (``n_init``).
The Lloyd iterations of all k and restarts run side by side: one pass over the
points serves every fit that has not converged, so passes follow the slowest fit
and not the number of fits. The fit with the lowest training cost wins. The silhouette is the exact Euclidean
one on a fixed-size sample: the sample (a bounded parameter, 10,000 rows) is
broadcast, and each partition of the sample computes its points' mean
distances per cluster with numpy, so no pair is ever materialised as a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsight.operators.eda import exact_quantiles
from shopsight.operators.marts import RFM_LABELS
from shopsight.session import materialize

PERSON = "customer_unique_id"
RFM_COLS = ["recency_days", "frequency", "monetary"]
SCALED = ["x_recency", "x_log_frequency", "x_log_monetary"]
DIGITS = 9


def rfm_log_scale(rfm: DataFrame) -> DataFrame:
    """Drop rows missing R/F/M; recency, log1p(frequency), log1p(monetary), standardised.

    Standardisation uses the population standard deviation (a zero deviation
    leaves the column unscaled); the statistics are one scalar subquery.
    """
    base = rfm.na.drop(subset=RFM_COLS).select(
        PERSON,
        F.col("recency_days").cast("double").alias("r"),
        F.log1p(F.col("frequency").cast("double")).alias("f"),
        F.log1p(F.col("monetary").cast("double")).alias("m"),
    )
    stats = base.select(
        F.struct(
            *[F.avg(c).alias(f"mu_{c}") for c in "rfm"],
            *[F.stddev_pop(c).alias(f"sd_{c}") for c in "rfm"],
        )
    ).scalar()  # one scalar subquery (six moments in one pass), reused
    cols = []
    for c, name in zip("rfm", SCALED):
        sd = stats.getField(f"sd_{c}")
        scale = F.when(sd > 0, sd).otherwise(F.lit(1.0))
        cols.append(F.round((F.col(c) - stats.getField(f"mu_{c}")) / scale, DIGITS).alias(name))
    return base.select(PERSON, *cols)


def _vectors(scaled: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=SCALED, outputCol="features").transform(scaled).select(PERSON, *SCALED, "features")


class Centers:
    """A fitted KMeans: its cluster centres, which label points as Spark ML's model does (the first of equally near ones)."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers

    def transform(self, df: DataFrame) -> DataFrame:
        near = [reduce(add, [F.pow(F.col(c) - F.lit(float(x)), F.lit(2.0)) for c, x in zip(SCALED, center)]) for center in self.centers]
        apart = F.array(*near)
        return df.withColumn("prediction", (F.array_position(apart, F.array_min(apart)) - 1).cast("int"))


def lloyd_sums(points: DataFrame, fits: dict[int, np.ndarray]) -> pd.DataFrame:
    """fit, cluster, n, s0 .. (coordinate sums) and cost of the points nearest to each centre of each fit: a row per centre."""
    spark = points.sparkSession
    bx = spark.sparkContext.broadcast(fits)
    sums = [f"s{i}" for i in range(len(points.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = bx.value
        edges = np.cumsum([0, *map(len, fits.values())])
        centers = np.concatenate(list(fits.values()))
        total = np.zeros((len(centers), 2 + len(sums)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            d = (x**2).sum(axis=1)[:, None] - 2.0 * x @ centers.T + (centers**2).sum(axis=1)
            for a, b in zip(edges[:-1], edges[1:]):
                own = d[:, a:b].argmin(axis=1)
                cost = np.maximum(d[np.arange(len(x)), a + own], 0.0)
                total[a:b] += np.column_stack([np.bincount(own, w, b - a) for w in (None, *x.T, cost)])
        keys = [np.repeat(list(fits), np.diff(edges)), np.concatenate([np.arange(len(c)) for c in fits.values()])]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()) for k in keys] + [pa.array(c) for c in total.T.copy()], names=["fit", "cluster", "n", *sums, "cost"])

    kind = "fit int, cluster int, " + ", ".join(f"{c} double" for c in ("n", *sums, "cost"))
    out = points.mapInArrow(run, kind).groupBy("fit", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", *sums, "cost")])
    found = out.toPandas().sort_values(["fit", "cluster"])
    bx.unpersist()
    return found


def lloyd(points: DataFrame, fits: list[np.ndarray], max_iter: int = 300, tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Centres and training cost of each fit after Lloyd iterations, from its given centres on.

    As in Spark ML a fit ends when none of its centres moves further than ``tol``, a centre
    without points stays, and the cost is that of the last pass.
    """
    centers = dict(enumerate(fits))
    costs = dict.fromkeys(centers, 0.0)
    open_fits = set(centers)
    for _ in range(max_iter):
        if not open_fits:
            break
        for i, found in lloyd_sums(points, {i: centers[i] for i in sorted(open_fits)}).groupby("fit"):
            n = found["n"].to_numpy()
            moved = centers[i].copy()
            moved[n > 0] = found.filter(regex=r"^s\d+$").to_numpy()[n > 0] / n[n > 0, None]
            if (((moved - centers[i]) ** 2).sum(axis=1) <= tol**2).all():
                open_fits.discard(i)
            centers[i], costs[i] = moved, float(found["cost"].sum())
    return [(centers[i], costs[i]) for i in range(len(fits))]


def fit_kmeans_each(vectors: DataFrame, ks: Sequence[int], n_init: int = 10, seed: int = 42, max_iter: int = 300) -> dict[int, tuple[Centers, float]]:
    """For each k, the best of ``n_init`` KMeans fits (distinct seeds) by training cost (inertia), and that cost.

    The (stored) vectors are cached: every fit makes many passes, and a lost
    cached block is re-read from the stored frame.
    """
    cached = vectors.persist(StorageLevel.MEMORY_AND_DISK)

    def start(task: tuple[int, int]) -> np.ndarray:
        k, i = task
        return np.array(KMeans(k=k, seed=seed + i, maxIter=0, tol=1e-4, featuresCol="features").fit(cached).clusterCenters())

    tasks = [(k, i) for k in ks for i in range(n_init)]
    try:
        # seedings are independent jobs: submit a few at once to share the cluster
        with ThreadPoolExecutor(max_workers=min(4, len(tasks))) as pool:
            starts = list(pool.map(start, tasks))
        fits = lloyd(cached.select(*SCALED), starts, max_iter)
    finally:
        cached.unpersist()
    best = {}
    for k in ks:
        own = [f for t, f in zip(tasks, fits) if t[0] == k]
        # lowest cost wins; ties (but for the rounding of sums) go to the earliest seed
        limit = min(cost for _, cost in own) * (1 + 1e-12)
        centers, cost = next(f for f in own if f[1] <= limit)
        best[k] = (Centers(centers), cost)
    return best


def fit_kmeans(vectors: DataFrame, k: int, n_init: int = 10, seed: int = 42, max_iter: int = 300) -> tuple[Centers, float]:
    """Best of ``n_init`` KMeans fits of one k, and its cost (see :func:`fit_kmeans_each`)."""
    return fit_kmeans_each(vectors, [k], n_init, seed, max_iter)[k]


def sample_fixed(df: DataFrame, n: int, seed: int = 42, id_col: str = PERSON) -> DataFrame:
    """Exactly min(n, rows) rows, repeatable: the n smallest seeded hashes of the id (top-k plan)."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(n)


def silhouette(points: DataFrame, label_col: str = "prediction", cols: Sequence[str] = SCALED) -> float:
    """Mean Euclidean silhouette of a bounded frame of points (the sample).

    The points are broadcast once (their count is the sample size); each task
    scores its share of points against all of them with numpy.
    """
    spark = points.sparkSession
    local = points.select(*cols, label_col).toPandas()
    if local.empty:
        return float("nan")
    X = local[list(cols)].to_numpy(dtype=float)
    y = local[label_col].to_numpy()
    if len(np.unique(y)) < 2:
        return float("nan")
    bx = spark.sparkContext.broadcast((X, y))
    cols_l = list(cols)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        X_all, y_all = bx.value
        labels = np.unique(y_all)
        sizes = {lab: int((y_all == lab).sum()) for lab in labels}
        for pdf in batches:
            P = pdf[cols_l].to_numpy(dtype=float)
            own = pdf[label_col].to_numpy()
            # |p - x|^2 = |p|^2 + |x|^2 - 2 p.x : one (batch x sample) matrix
            sq = (P**2).sum(axis=1)[:, None] + (X_all**2).sum(axis=1)[None, :] - 2.0 * P @ X_all.T
            d = np.sqrt(np.maximum(sq, 0.0))
            means = {}
            for lab in labels:
                mask = y_all == lab
                sums = d[:, mask].sum(axis=1)
                means[lab] = sums
            a = np.zeros(len(P))
            b = np.full(len(P), np.inf)
            for lab in labels:
                is_own = own == lab
                n_own = sizes[lab] - 1
                a = np.where(is_own, np.where(n_own > 0, means[lab] / max(n_own, 1), 0.0), a)
                b = np.where(is_own, b, np.minimum(b, means[lab] / sizes[lab]))
            s = np.where(np.maximum(a, b) > 0, (b - a) / np.maximum(a, b), 0.0)
            single = np.array([sizes[v] == 1 for v in own])
            s = np.where(single, 0.0, s)
            yield pd.DataFrame({"s": s})

    # chunk the sample so each task holds (chunk x sample) distances, bounded
    parts = max(1, len(local) // 500)
    spread = points.select(*cols, label_col).repartition(parts)
    vals = spread.mapInPandas(score, "s double").agg(F.avg("s")).first()[0]
    bx.unpersist()
    return float(vals)


def kmeans_sweep(
    rfm: DataFrame, ks: Sequence[int] = range(2, 9), n_init: int = 10, sample_size: int = 10_000, seed: int = 42
) -> DataFrame:
    """Inertia and sample silhouette per k (the elbow/silhouette table)."""
    vectors = materialize(_vectors(rfm_log_scale(rfm)))
    sample_ids = sample_fixed(vectors.select(PERSON), sample_size, seed)
    sample = materialize(vectors.join(sample_ids, PERSON).select(*SCALED))
    rows = []
    for k, (model, cost) in fit_kmeans_each(vectors, list(ks), n_init, seed).items():
        rows.append((int(k), float(cost), silhouette(model.transform(sample))))
    return rfm.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def cluster_rank(assigned: DataFrame, rfm: DataFrame) -> DataFrame:
    """Stable names C0.. by mean monetary, descending (k rows, broadcast)."""
    means = (
        assigned.join(rfm.select(PERSON, "monetary"), PERSON)
        .groupBy("kmeans_cluster")
        .agg(F.avg("monetary").alias("_mean"))
    )
    ranks = means.select(
        "kmeans_cluster",
        F.concat(
            F.lit("C"),
            (F.row_number().over(Window.orderBy(F.col("_mean").desc(), F.col("kmeans_cluster"))) - 1).cast("string"),
        ).alias("cluster"),
    )
    return assigned.join(F.broadcast(ranks), "kmeans_cluster")


def kmeans_fit(rfm: DataFrame, k: int = 4, n_init: int = 20, seed: int = 42) -> DataFrame:
    """customer_clusters: (customer_unique_id, cluster, kmeans_cluster) for the final k."""
    vectors = materialize(_vectors(rfm_log_scale(rfm)))
    model, _ = fit_kmeans(vectors, k, n_init, seed)
    assigned = model.transform(vectors).select(PERSON, F.col("prediction").alias("kmeans_cluster"))
    return cluster_rank(assigned, rfm).select(PERSON, "cluster", "kmeans_cluster")


def cluster_profile(clusters: DataFrame, rfm: DataFrame) -> DataFrame:
    """Per cluster: n, mean/median recency, mean frequency, mean/median monetary (2 decimals, half-even)."""
    joined = clusters.join(rfm.select(PERSON, *RFM_COLS), PERSON)
    means = joined.groupBy("cluster").agg(
        F.count(PERSON).alias("n"),
        F.avg("recency_days").alias("recency_mean"),
        F.avg("frequency").alias("frequency_mean"),
        F.avg("monetary").alias("monetary_mean"),
    )
    med_r = exact_quantiles(joined, "recency_days", [0.5], by=["cluster"]).select(
        "cluster", F.col("value").alias("recency_median")
    )
    med_m = exact_quantiles(joined, "monetary", [0.5], by=["cluster"]).select(
        "cluster", F.col("value").alias("monetary_median")
    )
    out = means.join(med_r, "cluster", "left").join(med_m, "cluster", "left")
    return out.select(
        "cluster",
        "n",
        *[F.bround(c, 2).alias(c) for c in ("recency_mean", "recency_median", "frequency_mean", "monetary_mean", "monetary_median")],
    ).orderBy("cluster")


def cluster_crosstab(clusters: DataFrame, rfm: DataFrame) -> DataFrame:
    """Cluster x rule label table, long: count and share of the cluster in percent, empty cells with 0."""
    joined = clusters.join(rfm.select(PERSON, "rfm_segment_label"), PERSON)
    counts = joined.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("_tot"), *[F.count_if(F.col("rfm_segment_label") == label).alias(f"_n{i}") for i, label in enumerate(RFM_LABELS)]
    )
    cells = F.array(*[F.struct(F.lit(label).alias("rfm_segment_label"), F.col(f"_n{i}").alias("n")) for i, label in enumerate(RFM_LABELS)])
    return counts.select("cluster", "_tot", F.explode(cells).alias("cell")).select(
        "cluster", "cell.rfm_segment_label", "cell.n", F.bround(F.col("cell.n") * 100.0 / F.col("_tot"), 1).alias("pct_of_cluster")
    )
