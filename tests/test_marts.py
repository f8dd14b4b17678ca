"""Marts on hand-made raw tables, and invariants on the test tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import SF_CHECK, make_fct
from shopsight.operators import marts
from shopsight.operators.staging import Staging
from shopsight.plans.warehouse import Warehouse
from shopsight.sources.schemas import RAW_SCHEMAS


def raw_frames(spark, **tables):
    out = {}
    for name, schema in RAW_SCHEMAS.items():
        rows = tables.get(name, [])
        out[name] = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
    return out


def test_customer_without_orders(spark):
    raw = raw_frames(
        spark,
        customers=[
            {"customer_id": "a", "customer_unique_id": "p1", "customer_zip_code_prefix": 1, "customer_city": "X", "customer_state": "sp"},
            {"customer_id": "b", "customer_unique_id": "p2", "customer_zip_code_prefix": 2, "customer_city": "Y", "customer_state": "rj"},
        ],
        orders=[{"order_id": "o1", "customer_id": "a", "order_status": "delivered", "order_purchase_timestamp": dt.datetime(2020, 1, 1)}],
    )
    dim = {r["customer_unique_id"]: r for r in marts.dim_customers(Staging(raw)).collect()}
    assert dim["p2"]["total_orders"] == 0 and dim["p2"]["first_order_at"] is None
    assert dim["p2"]["is_repeat_buyer"] is False
    assert dim["p1"]["state"] == "SP" and dim["p1"]["delivered_orders"] == 1


def test_null_status_is_not_a_valid_order(spark):
    fct = make_fct(spark, [{"status": None}, {"status": "delivered"}, {"status": "canceled"}])
    assert marts.valid_orders(fct).count() == 1


def test_rfm_with_three_customers_and_null_money(spark):
    fct = make_fct(spark, [
        {"customer_unique_id": 1, "purchased_at": dt.datetime(2020, 1, 1)},
        {"customer_unique_id": 2, "purchased_at": dt.datetime(2020, 1, 5), "items_total": None},
        {"customer_unique_id": 3, "purchased_at": dt.datetime(2020, 1, 9), "items_total": Decimal("3.00")},
    ])
    rfm = {r["customer_unique_id"]: r for r in marts.customer_rfm(fct).collect()}
    assert len(rfm) == 3
    # ntile(5) over 3 rows gives 1, 2, 3; recency is descending
    assert [rfm[c]["r_score"] for c in (1, 2, 3)] == [1, 2, 3]
    assert rfm[2]["monetary"] is None and rfm[2]["m_score"] == 1  # NULLs first on ascending
    assert rfm[3]["recency_days"] == 1


def test_translation_fallbacks(spark):
    raw = raw_frames(
        spark,
        products=[{"product_id": "x", "product_category_name": "a"}, {"product_id": "y", "product_category_name": "b"}, {"product_id": "z"}],
        product_category_translation=[{"string_field_0": "a", "string_field_1": "en_a"}],
    )
    got = {r["product_id"]: r["category"] for r in marts.dim_products(Staging(raw)).collect()}
    assert got == {"x": "en_a", "y": "b", "z": "unknown"}


def test_invariants_on_test_tables(spark):
    wh = Warehouse.from_test_tables(spark, SF_CHECK)
    fct = wh.fct_orders
    assert fct.count() == fct.select("order_id").distinct().count()
    valid = marts.valid_orders(fct).count()
    assert wh.monthly_revenue().agg(F.sum("orders")).first()[0] == valid
    cohorts = wh.customer_cohorts()
    zero = cohorts.filter(F.col("months_since_first") == 0)
    assert zero.agg(F.sum("active_customers")).first()[0] == zero.agg(F.sum("cohort_size")).first()[0]
    assert zero.filter(F.col("retention_rate") != 1.0).count() == 0


def test_build_writes_all_marts(spark, tmp_path):
    from shopsight.plans.warehouse import build

    counts = build(Warehouse.from_test_tables(spark, "/root/testdata/sf0.001"), str(tmp_path / "marts"), str(tmp_path / "csv"))
    assert set(counts) == {
        "fct_orders", "dim_customers", "dim_products", "monthly_revenue", "revenue_by_state",
        "category_performance", "customer_cohorts", "customer_rfm",
    }
    assert counts["fct_orders"] == spark.read.parquet(str(tmp_path / "marts" / "fct_orders")).count()
    assert (tmp_path / "csv" / "monthly_revenue").exists()
    # month folders, each written by few tasks (range partitioning before the write)
    months = [p for p in (tmp_path / "marts" / "fct_orders").iterdir() if p.name.startswith("purchased_month=")]
    assert len(months) >= counts["monthly_revenue"]
    files = [f for m in months for f in m.iterdir() if f.suffix == ".parquet"]
    assert len(files) <= len(months) + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cohort_pivot_keeps_every_offset(spark, monkeypatch):
    from types import SimpleNamespace

    from shopsight.plans import analysis

    # one person buys in the first, the second and the 121st month; an invalid order far out opens no columns
    days = [dt.datetime(2010, 1, 31), dt.datetime(2010, 2, 1), dt.datetime(2020, 1, 1)]
    rows = [{"purchased_at": d} for d in days] + [{"purchased_at": dt.datetime(2030, 1, 1), "status": "canceled"}]
    fct = make_fct(spark, rows)
    for orders, offsets in ((fct, 121), (fct.filter("order_id <= 2"), 2), (fct.limit(0), 0)):
        w = SimpleNamespace(fct_orders=orders, customer_cohorts=lambda orders=orders: marts.customer_cohorts(orders))
        monkeypatch.setattr(analysis, "wh", lambda *_, w=w: w)
        matrix = analysis.q_cohort_pivot(spark, None)
        assert matrix.columns == ["cohort_month", *map(str, range(offsets))]
        cells = {k: v for r in matrix.collect() for k, v in r.asDict().items() if k != "cohort_month" and v is not None}
        assert cells == {str(i): 1.0 for i in (0, 1, 120) if i < offsets}


def test_cohorts_of_spans_beyond_a_word(spark):
    """Months as bits: spans over 64 months, months before 1970, missing dates and missing ids, against sets of months."""
    import random

    from shopsight.operators import marts

    rng = random.Random(6)
    rows = []
    for person in [*range(40), None]:
        for _ in range(rng.choice([1, 1, 2, 30])):
            ts = dt.datetime(rng.choice([1964, 1969, 1970, 1999, 2020]) + rng.randint(0, 6), rng.randint(1, 12), rng.randint(1, 28))
            rows.append({"customer_unique_id": person, "purchased_at": None if rng.random() < 0.1 else ts})
    rows.append({"customer_unique_id": 99, "purchased_at": None})
    months: dict = {}
    for r in rows:
        ts = r["purchased_at"]
        if r["customer_unique_id"] is not None:
            months.setdefault(r["customer_unique_id"], set()).add(None if ts is None else 12 * ts.year + ts.month - 1)
    expected: dict = {}
    for own in months.values():
        known = [m for m in own if m is not None]
        for m in own if known else []:
            at = (min(known), None if m is None else m - min(known))
            expected[at] = expected.get(at, 0) + 1
    got = marts.customer_cohorts(make_fct(spark, rows)).collect()
    assert {(12 * r["cohort_month"].year + r["cohort_month"].month - 1, r["months_since_first"]): r["active_customers"] for r in got} == expected
    assert all(r["cohort_size"] == expected[(12 * r["cohort_month"].year + r["cohort_month"].month - 1, 0)] for r in got)
    assert max(o for _, o in expected if o is not None) > 128
