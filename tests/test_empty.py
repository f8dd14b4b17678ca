"""Empty inputs give empty (or all-NULL one-row) results, never errors."""

from __future__ import annotations

from helpers import make_fct
from shopsight.operators import eda, features, marts, metrics


def test_empty_fact(spark):
    fct = make_fct(spark, [{}]).limit(0)
    assert marts.monthly_revenue(fct).count() == 0
    assert marts.customer_cohorts(fct).count() == 0
    assert marts.customer_rfm(fct).count() == 0
    feats = features.add_repeat_target(features.first_order_features(fct), fct, 7)
    assert feats.count() == 0
    assert features.observable(feats, fct, 7).count() == 0
    q = eda.delivery_quantiles(fct).collect()
    assert q == []


def test_empty_scores(spark):
    df = spark.createDataFrame([], "id long, label int, score double")
    row = metrics.evaluate(df, "id").first()
    assert row["n_samples"] == 0 and row["pr_auc"] is None
    assert metrics.pr_curve(df).count() == 0
