"""What several test modules import: the folders of the test tables and a hand-made order fact."""

from __future__ import annotations

import datetime as dt

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem".split()

FCT_COLUMNS = [
    ("order_id", "bigint"),
    ("customer_unique_id", "bigint"),
    ("customer_state", "string"),
    ("status", "string"),
    ("purchased_at", "timestamp_ntz"),
    ("purchased_date", "date"),
    ("purchased_month", "date"),
    ("delivery_days", "bigint"),
    ("was_late", "boolean"),
    ("avg_review_score", "double"),
    ("item_count", "bigint"),
    ("unique_products", "bigint"),
    ("unique_sellers", "bigint"),
    ("items_subtotal", "decimal(18,2)"),
    ("freight_total", "decimal(18,2)"),
    ("items_total", "decimal(18,2)"),
    ("max_installments", "int"),
    ("payment_count", "bigint"),
    ("payments_total", "decimal(18,2)"),
]


def make_fct(spark, rows: list[dict]):
    """A hand-made order fact: unspecified columns take plain defaults."""
    from decimal import Decimal

    out = []
    for i, r in enumerate(rows):
        ts = r.get("purchased_at", dt.datetime(2020, 1, 1))
        d = ts.date() if ts else None
        base = {
            "order_id": i + 1,
            "customer_unique_id": 1,
            "customer_state": "SP",
            "status": "delivered",
            "purchased_at": ts,
            "purchased_date": d,
            "purchased_month": d.replace(day=1) if d else None,
            "delivery_days": 5,
            "was_late": False,
            "avg_review_score": 5.0,
            "item_count": 1,
            "unique_products": 1,
            "unique_sellers": 1,
            "items_subtotal": Decimal("10.00"),
            "freight_total": Decimal("2.00"),
            "items_total": Decimal("12.00"),
            "max_installments": 1,
            "payment_count": 1,
            "payments_total": Decimal("12.00"),
        }
        base.update(r)
        out.append(tuple(base[c] for c, _ in FCT_COLUMNS))
    schema = ", ".join(f"{c} {t}" for c, t in FCT_COLUMNS)
    return spark.createDataFrame(out, schema)
