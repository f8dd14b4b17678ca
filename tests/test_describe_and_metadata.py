"""Means that keep a value's digits, and the view of stored model metadata."""

from __future__ import annotations

import math

from shopsight.operators import eda, propensity


def test_mean_keeps_digits_past_the_sixth(spark):
    df = spark.createDataFrame([(4e-7, 1e25), (4e-7, 3e25), (None, None)], "small double, huge double")
    got = {r["column"]: r for r in eda.describe(df, ["small", "huge"]).collect()}
    assert got["small"]["mean"] == 4e-7 and got["small"]["count"] == 2
    assert math.isclose(got["huge"]["mean"], 2e25)


def test_metrics_view_of_fixed_metadata(spark):
    meta = {
        "horizon_days": 180, "train_end": "2018-01-01", "eval_end": "2018-03-01", "train_size": 7, "test_size": 3, "default_model": "boost",
        "metrics_test": {"logreg": {"pr_auc": 0.1, "roc_auc": None}, "boost": {"pr_auc": 0.2}},
    }
    view = propensity.model_metrics_view(propensity.metadata_frame(spark, meta))
    rows = {(r["model"], r["metric"]): r["value"] for r in view.collect()}
    assert rows == {("logreg", "pr_auc"): 0.1, ("logreg", "roc_auc"): None, ("boost", "pr_auc"): 0.2}
    one = view.first()
    assert (one["default_model"], one["horizon_days"], one["train_end"], one["eval_end"], one["train_size"], one["test_size"]) == ("boost", 180, "2018-01-01", "2018-03-01", 7, 3)


def test_metrics_view_without_sizes(spark):
    one = propensity.model_metrics_view(propensity.metadata_frame(spark, {"metrics_test": {"logreg": {"brier": 0.5}}})).first()
    assert one["default_model"] == "logreg" and one["train_size"] is None and one["eval_end"] is None
