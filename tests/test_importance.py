"""Shuffled-feature importance against numpy; one split for all models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from shopsight.operators import propensity
from shopsight.plans import modeling


def _ap(label, score):
    found = 0.0
    for s in np.unique(score[label == 1]):
        above = score >= s
        found += (label[score == s].sum() / label.sum()) * label[above].mean()
    return found


@pytest.mark.parametrize("rows_per_bucket", [1000, 40])
def test_importance_matches_brute_force(spark, rows_per_bucket):
    df = spark.range(150).select(
        F.col("id").alias("pid"), (F.col("id") * 7 % 11).cast("double").alias("a"), (F.col("id") * 5 % 3).cast("int").alias("b"),
        ((F.col("id") * 7 % 11 + F.col("id") % 4) > 7).cast("int").alias("label"),
    )
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol="label")]
    model = Pipeline(stages=stages).fit(df)
    got = propensity.perm_importance(model, df, ["a", "b"], "pid", "label", 3, 42, rows_per_bucket=rows_per_bucket, min_buckets=2)
    rows = df.orderBy("pid").toPandas()
    coef, icpt = np.array(model.stages[-1].coefficients), model.stages[-1].intercept
    score = lambda x: np.round(1 / (1 + np.exp(-(x @ coef + icpt))), 13)
    X, y = rows[["a", "b"]].to_numpy(dtype=float), rows["label"].to_numpy()
    want = {}
    for f, name in enumerate(["a", "b"]):
        drops = []
        for rep in range(3):
            order = df.orderBy(F.xxhash64("pid", F.lit(42), F.lit(f), F.lit(rep)), "pid").toPandas()
            Z = X.copy()
            Z[:, f] = order[name]
            drops.append(_ap(y, score(X)) - _ap(y, score(Z)))
        want[name] = (np.mean(drops), np.std(drops))
    for r in got.collect():
        assert (r["importance_mean"], r["importance_std"]) == pytest.approx(want[r["feature"]], abs=1e-9)


def test_no_copy_of_whole_rows_is_stored(spark, monkeypatch):
    df = spark.range(30).select(F.col("id").alias("pid"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), LogisticRegression(maxIter=2)]).fit(df)
    stored, keep = [], propensity.materialize
    monkeypatch.setattr(propensity, "materialize", lambda x: stored.append(x.columns) or keep(x))
    propensity.perm_importance(model, df, ["a"], "pid", "label", 2).collect()
    assert [c for c in stored if "a" in c] == [["pid", "label", "a"]]


def test_models_share_one_split(spark, monkeypatch):
    calls = []
    frame = spark.createDataFrame([(1, "train"), (2, "test")], "customer_unique_id long, split string")
    monkeypatch.setattr(modeling, "_split", lambda s, sf: calls.append(sf) or (frame, frame))
    monkeypatch.setattr(modeling.propensity, "fit_model", lambda *a, **k: "model")
    kept = spark.sparkContext.__dict__
    monkeypatch.setitem(kept, "_shopsight_models", {})
    monkeypatch.setitem(kept, "_shopsight_splits", {})
    for kind in propensity.MODEL_TYPES:
        modeling._model(spark, "folder", kind)
    assert calls == ["folder"]
