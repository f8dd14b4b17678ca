"""A person holding a third of all orders: results stay whole and exact."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from helpers import make_fct
from shopsight.operators import features, marts

T0 = dt.datetime(2020, 1, 1)


def skewed_fct(spark):
    rows = []
    for i in range(600):  # the hot person
        rows.append({"customer_unique_id": 1, "purchased_at": T0 + dt.timedelta(hours=7 * i)})
    for p in range(2, 202):  # 200 persons with 1..6 orders
        for j in range(1 + p % 6):
            rows.append({"customer_unique_id": p, "purchased_at": T0 + dt.timedelta(days=3 * p + 40 * j, hours=p % 24)})
    for i, r in enumerate(rows):
        r["order_id"] = 10_000 + i
        r["status"] = "canceled" if i % 17 == 0 else "delivered"
    return make_fct(spark, rows), pd.DataFrame(rows)


def test_rfm_frequency_and_cohorts_under_skew(spark):
    fct, pdf = skewed_fct(spark)
    valid = pdf[~pdf["status"].isin(["canceled", "unavailable"])]
    want_freq = valid.groupby("customer_unique_id")["order_id"].nunique()
    got = {r["customer_unique_id"]: r["frequency"] for r in marts.rfm_per_person(fct).collect()}
    assert got == want_freq.to_dict()

    month = valid["purchased_at"].dt.to_period("M")
    first = month.groupby(valid["customer_unique_id"]).transform("min")
    offs = (month - first).apply(lambda d: d.n)
    want = (
        pd.DataFrame({"c": first, "o": offs, "p": valid["customer_unique_id"]})
        .groupby(["c", "o"])["p"]
        .nunique()
    )
    rows = marts.customer_cohorts(fct).collect()
    got = {(pd.Period(r["cohort_month"], "M"), r["months_since_first"]): r["active_customers"] for r in rows}
    assert got == want.to_dict()


def test_second_order_under_skew(spark):
    fct, pdf = skewed_fct(spark)
    srt = pdf.sort_values(["customer_unique_id", "purchased_at", "order_id"])
    want = srt.groupby("customer_unique_id").nth(1).set_index("customer_unique_id")["purchased_at"].to_dict()
    got = {r["customer_unique_id"]: r["second_order_at"] for r in features.second_orders(fct).collect()}
    assert got == want


def test_global_ntile_with_heavy_ties(spark):
    fct, _ = skewed_fct(spark)
    rfm = marts.customer_rfm(fct, rows_per_bucket=20, min_buckets=5)
    counts = rfm.groupBy("f_score").count().orderBy("f_score").collect()
    n = rfm.count()
    # ntile sizes differ by at most one whatever the ties
    assert max(r["count"] for r in counts) - min(r["count"] for r in counts) <= 1
    assert sum(r["count"] for r in counts) == n
    assert rfm.filter(F.col("customer_unique_id") == 1).first()["f_score"] == 5
