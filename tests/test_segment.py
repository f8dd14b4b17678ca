"""Silhouette against a brute-force definition; scaling; KMeans labels."""

from __future__ import annotations

import math

import numpy as np

from shopsight.operators import segment


def brute_silhouette(X, y):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))
    s = []
    for i in range(n):
        own = y == y[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, y == lab].mean() for lab in set(y) if lab != y[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(4, 1, (35, 3)), rng.normal([0, 5, 0], 1, (1, 3))])
    y = np.array([0] * 40 + [1] * 35 + [2])
    df = spark.createDataFrame([(*map(float, x), int(lab)) for x, lab in zip(X, y)], "a double, b double, c double, prediction int")
    got = segment.silhouette(df, "prediction", ["a", "b", "c"])
    assert math.isclose(got, brute_silhouette(X, y), rel_tol=1e-9)


def test_log_scale_is_standardised(spark):
    rows = [(i, i * 3, 1 + i % 2, float(10 * i + 1)) for i in range(20)]
    rfm = spark.createDataFrame(rows, "customer_unique_id long, recency_days long, frequency long, monetary double")
    pdf = segment.rfm_log_scale(rfm).toPandas()
    for c in segment.SCALED:
        assert abs(pdf[c].mean()) < 1e-8
        assert math.isclose(pdf[c].std(ddof=0), 1.0, rel_tol=1e-6)


def test_kmeans_fit_names_clusters_by_monetary(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(1, 400)), 1 + int(i % 7 == 0), float(rng.choice([20, 200, 2000]) + rng.random())) for i in range(300)]
    rfm = spark.createDataFrame(rows, "customer_unique_id long, recency_days long, frequency long, monetary double")
    clusters = segment.kmeans_fit(rfm, k=3, n_init=2)
    assert clusters.count() == 300
    means = (
        clusters.join(rfm, "customer_unique_id").groupBy("cluster").avg("monetary").orderBy("cluster").toPandas()
    )
    assert list(means["cluster"]) == ["C0", "C1", "C2"]
    assert means["avg(monetary)"].is_monotonic_decreasing
