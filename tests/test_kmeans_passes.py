"""All restarts of a KMeans share their passes and end where separate fits end."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans

from shopsight.operators import segment


def points(spark, n=400):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 1, (n, 3)) + 4 * rng.integers(0, 3, (n, 1)), 9)
    rows = [(i, *map(float, p)) for i, p in enumerate(x)]
    return segment._vectors(spark.createDataFrame(rows, ["customer_unique_id", *segment.SCALED])).cache()


def test_restarts_share_passes(spark, monkeypatch):
    passes = []
    inner = segment.lloyd_sums
    monkeypatch.setattr(segment, "lloyd_sums", lambda df, fits: passes.append(len(fits)) or inner(df, fits))
    segment.fit_kmeans_each(points(spark), [2, 3, 4], n_init=3, max_iter=6)
    assert passes[0] == 9 and len(passes) <= 6


def test_same_fit_as_spark_ml(spark):
    vectors = points(spark)
    for k, seed in ((2, 42), (3, 43), (5, 44)):
        model, cost = segment.fit_kmeans(vectors, k, 1, seed)
        fit = KMeans(k=k, seed=seed, maxIter=300, tol=1e-4).fit(vectors)
        assert math.isclose(cost, fit.summary.trainingCost, rel_tol=1e-9)
        assert np.allclose(model.centers, np.array(fit.clusterCenters()), atol=1e-9)
        want = {r[0]: r[1] for r in fit.transform(vectors).select("customer_unique_id", "prediction").collect()}
        assert {r[0]: r[1] for r in model.transform(vectors).select("customer_unique_id", "prediction").collect()} == want
