"""Metric operators against brute-force definitions on small score frames."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopsight.operators import metrics

SMALL = dict(rows_per_bucket=3, min_buckets=3)


def brute_ap(y, s):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for yi, si in zip(y, s) if si >= t and yi == 1)
        fp = sum(1 for yi, si in zip(y, s) if si >= t and yi == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def brute_auc(y, s):
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def frame(spark, y, s):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id long, label int, score double")


def test_ties_ap_and_auc(spark):
    y = [1, 0, 1, 0, 0, 1, 0, 0, 1, 0]
    s = [0.9, 0.9, 0.5, 0.5, 0.5, 0.2, 0.2, 0.2, 0.9, 0.5]
    got = metrics.auc_metrics(frame(spark, y, s), **SMALL).first()
    assert math.isclose(got["pr_auc"], brute_ap(y, s), rel_tol=1e-9)
    assert math.isclose(got["roc_auc"], brute_auc(y, s), rel_tol=1e-9)


def test_random_frames_match_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300).tolist()
    s = (rng.integers(0, 40, 300) / 40).tolist()
    got = metrics.auc_metrics(frame(spark, y, s), rows_per_bucket=10, min_buckets=4).first()
    assert math.isclose(got["pr_auc"], brute_ap(y, s), rel_tol=1e-9)
    assert math.isclose(got["roc_auc"], brute_auc(y, s), rel_tol=1e-9)


def test_no_positives_gives_zero_recall_and_lift(spark):
    got = metrics.recall_lift(frame(spark, [0] * 5, [0.1, 0.2, 0.3, 0.4, 0.5]), "id").first()
    assert got["recall_top_10pct"] == 0.0 and got["lift_top_10pct"] == 0.0


def test_recall_lift_top_fraction(spark):
    y = [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    s = [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]
    got = metrics.recall_lift(frame(spark, y, s), "id").first()
    assert got["recall_top_10pct"] == 0.5  # top ceil(1) row holds one of two positives
    assert math.isclose(got["lift_top_10pct"], 1.0 / 0.2)


@pytest.mark.parametrize("p,decile", [(0.0, 1), (0.0999, 1), (0.1, 2), (1.0, 10)])
def test_score_decile_edges(spark, p, decile):
    got = spark.createDataFrame([(p,)], "p double").select(metrics.score_decile(F.col("p"))).first()[0]
    assert got == decile


def test_calibration_bins_drop_empty(spark):
    df = frame(spark, [0, 1, 1], [0.05, 0.1, 0.95])
    got = {r["bin"]: r for r in metrics.calibration_bins(df).collect()}
    assert set(got) == {0, 9}  # 0.1 sits on an inner edge and stays in bin 0
    assert got[0]["n"] == 2


def test_evaluate_has_nine_metrics(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, rng.integers(0, 2, 50).tolist(), rng.random(50).tolist())
    row = metrics.evaluate(df, "id").first().asDict()
    assert list(row) == list(metrics.METRIC_NAMES)
    assert row["n_samples"] == 50
