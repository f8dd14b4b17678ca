"""Order lines move once, as plain rows: no copies for distinct counts."""

from __future__ import annotations

from decimal import Decimal

from shopsight.operators import intermediate


def _plan(df) -> str:
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def _items(spark):
    rows = [(1, 7, 3, 1), (1, 7, 3, 2), (1, 8, 3, 4), (1, None, 4, 8), (2, None, None, 16), (None, 5, 5, 32), (None, 5, 6, 64)]
    rows = [(o, p, s, Decimal(c), Decimal(0), Decimal(c)) for o, p, s, c in rows]
    return spark.createDataFrame(
        rows, "order_id long, product_id long, seller_id long, price decimal(18,2), freight_value decimal(18,2), line_total decimal(19,2)"
    )


def test_item_totals_count_distinct_without_copies(spark):
    got = intermediate.int_item_totals(_items(spark))
    rows = {r["order_id"]: (r["item_count"], r["unique_products"], r["unique_sellers"], r["items_total"]) for r in got.collect()}
    assert rows == {1: (4, 2, 2, Decimal(15)), 2: (1, 0, 0, Decimal(16)), None: (2, 1, 2, Decimal(96))}
    plan = _plan(got)
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_payments_and_reviews_move_once_by_order(spark):
    pays = spark.createDataFrame([(1, 1, Decimal(5), "b"), (1, 3, Decimal(6), "a"), (1, 2, None, "b"), (2, None, None, None)], "order_id long, installments int, payment_value decimal(18,2), payment_type string")
    got = intermediate.int_payment_totals(pays)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 3, Decimal(11), "a,b"), (2, 1, None, None, None)]
    revs = spark.createDataFrame([(1, 4), (1, 5), (2, None)], "order_id long, score int")
    out = intermediate.int_review_aggregated(revs)
    assert sorted(map(tuple, out.collect())) == [(1, 2, 4.5, 5, 4), (2, 1, None, None, None)]
    for df in (got, out):
        plan = _plan(df)
        assert plan.count("Exchange hashpartitioning") == 1
        assert plan.count("Aggregate(") == 2 and plan.rindex("Aggregate(") < plan.index("Exchange hashpartitioning")


def test_line_totals_do_not_move(spark):
    want = sorted(map(tuple, intermediate.int_item_totals(_items(spark)).collect()), key=str)
    got = intermediate.int_item_totals(_items(spark).drop("line_total"))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert "line_total" not in _plan(intermediate.int_item_totals(_items(spark))).split("LocalTableScan")[0].split("Scan")[0]
