"""First orders: few plain rows of each person move, and the second order's time comes with them."""

from __future__ import annotations

import datetime as dt

import pytest

from helpers import make_fct
from shopsight.operators import features

T0 = dt.datetime(2020, 1, 1)


def _plan(df) -> str:
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict", [False, True])
def test_first_orders_are_bounded_rows_and_give_the_second_time(spark, strict):
    h = lambda n: T0 + dt.timedelta(hours=n)
    rows = [{"purchased_at": h(i), "delivery_days": None, "avg_review_score": None} for i in range(5)]
    rows += [{"purchased_at": h(5), "delivery_days": None, "avg_review_score": 2.0}]
    rows += [{"purchased_at": h(6 + i), "delivery_days": i, "avg_review_score": None, "customer_state": "RJ"} for i in range(5)]
    rows += [{"purchased_at": None, "customer_unique_id": 2}, {"purchased_at": h(9), "customer_unique_id": 2, "customer_state": None}]
    rows += [{"customer_unique_id": 3, "purchased_at": h(1)}]
    out = features.first_and_second_orders(make_fct(spark, rows), strict)
    got = {r[features.PERSON]: r for r in out.collect()}
    first = got[1]
    assert (first["first_order_id"], first["first_order_at"], first["second_order_at"], first["customer_state"]) == (1, h(0), h(1), "SP")
    assert (first["delivery_days"], first["avg_review_score"]) == ((None, None) if strict else (0, 2.0))
    assert (got[2]["first_order_id"], got[2]["second_order_at"], got[2]["customer_state"]) == (13, None, None if strict else "SP")
    assert got[3]["second_order_at"] is None
    plan = _plan(out)
    assert "min_by" not in plan and "WindowGroupLimit" in plan


def test_second_rows_of_a_group_move_with_time_and_id_only(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    rows = [{"order_id": 1, "purchased_at": h(1), "avg_review_score": None}, {"order_id": 2, "purchased_at": h(2), "avg_review_score": None, "delivery_days": 9}]
    rows += [{"order_id": 3, "purchased_at": h(3), "avg_review_score": 4.0, "delivery_days": 7}, {"order_id": 4, "purchased_at": h(4), "avg_review_score": 1.0}]
    rows += [{"order_id": 5, "purchased_at": h(1), "customer_unique_id": 2, "item_count": 3}, {"order_id": 5, "purchased_at": h(1), "customer_unique_id": 2, "item_count": 3}]
    for strict in (False, True):
        out = features.first_and_second_orders(make_fct(spark, rows), strict)
        got = {r[features.PERSON]: (r["first_order_id"], r["second_order_at"], r["delivery_days"], r["avg_review_score"], r["item_count"]) for r in out.collect()}
        assert got == {1: (1, h(2), 5, None if strict else 4.0, 1), 2: (5, h(1), 5, 5.0, 3)}
        assert ("CASE WHEN (_nth" in _plan(out)) != strict
