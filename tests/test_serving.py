"""Scoring contract and serving aggregates."""

from __future__ import annotations

from shopsight.operators import serving

VALID = dict(
    customer_unique_id=0, items_total=120.0, items_subtotal=100.0, freight_total=20.0, payments_total=120.0,
    max_installments=3, payment_count=1, item_count=1, unique_products=1, unique_sellers=1, delivery_days=10.0,
    was_late=0, avg_review_score=5.0, first_order_month=11, customer_state="SP",
)
SCHEMA = (
    "customer_unique_id long, items_total double, items_subtotal double, freight_total double, payments_total double,"
    " max_installments int, payment_count int, item_count int, unique_products int, unique_sellers int,"
    " delivery_days double, was_late int, avg_review_score double, first_order_month int, customer_state string"
)
VIOLATIONS = [
    ("items_total", 0.0), ("items_subtotal", -1.0), ("freight_total", -0.5), ("payments_total", 0.0),
    ("max_installments", 25), ("max_installments", 0), ("payment_count", 0), ("item_count", 0),
    ("unique_products", 0), ("unique_sellers", 0), ("delivery_days", -1.0), ("was_late", 2),
    ("avg_review_score", 0.5), ("avg_review_score", 5.5), ("first_order_month", 13), ("first_order_month", None),
    ("customer_state", "SPX"), ("items_total", None),
]


def test_contract_accepts_valid_and_rejects_each_violation(spark):
    rows = [tuple(VALID.values())]
    for i, (field, value) in enumerate(VIOLATIONS, start=1):
        r = dict(VALID, customer_unique_id=i)
        r[field] = value
        rows.append(tuple(r.values()))
    out = {r["customer_unique_id"]: r for r in serving.score_contract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0]["accepted"] and out[0]["reasons"] == ""
    for i, (field, _) in enumerate(VIOLATIONS, start=1):
        assert not out[i]["accepted"], field
        assert field in out[i]["reasons"]


def test_contract_defaults_fill_missing(spark):
    r = dict(VALID, freight_total=None, max_installments=None, customer_state=None, delivery_days=None)
    out = serving.score_contract(spark.createDataFrame([tuple(r.values())], SCHEMA)).first()
    assert out["accepted"]
    assert out["freight_total"] == 0.0 and out["max_installments"] == 1 and out["customer_state"] == "SP"


def test_kpi_summary_counts_customers_per_month(spark):
    monthly = spark.createDataFrame(
        [("2020-01-01", 2, 2, 10.10), ("2020-02-01", 1, 1, 0.20)],
        "month string, orders long, customers long, gross_revenue double",
    )
    row = serving.kpi_summary(monthly).first()
    assert row["total_customers"] == 3.0 and row["total_gross_revenue"] == 10.3
    assert abs(row["avg_order_value"] - 10.3 / 3) < 1e-12
