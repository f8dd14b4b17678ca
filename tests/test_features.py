"""Hand-made order facts for the first-order features, the label and the split."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from helpers import make_fct
from shopsight.operators import features

T0 = dt.datetime(2020, 1, 1, 10, 0)


def test_first_non_null_default_and_strict(spark):
    # order 1 has no delivery time, order 2 has 5 days
    fct = make_fct(spark, [
        {"purchased_at": T0, "delivery_days": None},
        {"purchased_at": T0 + dt.timedelta(days=3), "delivery_days": 5},
    ])
    default = features.first_order_features(fct).first()
    strict = features.first_order_features(fct, strict=True).first()
    assert default["delivery_days"] == 5
    assert strict["delivery_days"] is None
    assert default["first_order_id"] == 1 and default["first_order_month"] == 1


def test_same_time_tie_break_and_zero_delta(spark):
    fct = make_fct(spark, [{"order_id": 20, "purchased_at": T0}, {"order_id": 10, "purchased_at": T0}])
    out = features.add_repeat_target(features.first_order_features(fct), fct, 7).first()
    assert out["first_order_id"] == 10
    assert out["repeat_within_7d"] == 1


def test_horizon_edge_whole_days(spark):
    inside = make_fct(spark, [{"purchased_at": T0}, {"purchased_at": T0 + dt.timedelta(days=180, hours=23)}])
    outside = make_fct(spark, [{"purchased_at": T0}, {"purchased_at": T0 + dt.timedelta(days=181)}])
    for fct, want in ((inside, 1), (outside, 0)):
        out = features.add_repeat_target(features.first_order_features(fct), fct, 180).first()
        assert out["repeat_within_180d"] == want


def test_single_order_is_negative_and_null_person_dropped(spark):
    fct = make_fct(spark, [{"customer_unique_id": 1}, {"customer_unique_id": None}])
    out = features.add_repeat_target(features.first_order_features(fct), fct, 180).collect()
    assert len(out) == 1 and out[0]["repeat_within_180d"] == 0


def test_eval_end_is_midnight(spark):
    day = dt.datetime(2020, 6, 1)
    fct = make_fct(spark, [
        {"customer_unique_id": 1, "purchased_at": day},
        {"customer_unique_id": 2, "purchased_at": day + dt.timedelta(hours=10)},
        {"customer_unique_id": 3, "purchased_at": dt.datetime(2020, 1, 1)},
    ])
    feats = features.first_order_features(fct)
    train, test = features.chronological_split(feats, "2020-03-01", "2020-06-01")
    assert [r[0] for r in test.select("customer_unique_id").collect()] == [1]
    assert [r[0] for r in train.select("customer_unique_id").collect()] == [3]


def test_observability_filter(spark):
    fct = make_fct(spark, [
        {"customer_unique_id": 1, "purchased_at": dt.datetime(2020, 1, 1)},
        {"customer_unique_id": 2, "purchased_at": dt.datetime(2020, 1, 5)},
    ])
    kept = features.observable(features.first_order_features(fct), fct, 3)
    assert sorted(r[0] for r in kept.select("customer_unique_id").collect()) == [1]


def test_was_late_null_becomes_zero(spark):
    fct = make_fct(spark, [{"was_late": None}])
    assert features.first_order_features(fct).select(F.col("was_late")).first()[0] == 0
