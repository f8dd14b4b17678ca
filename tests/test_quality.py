"""Declarative checks find the planted faults of the test tables."""

from __future__ import annotations

import pytest
from helpers import SF_SMALL
from shopsight.operators import quality
from shopsight.plans.analysis import _dq_tables


def test_check_inventory():
    kinds = {}
    for c in quality.CHECKS:
        kinds[c.test] = kinds.get(c.test, 0) + 1
    assert len(quality.CHECKS) == 63
    assert kinds == {"not_null": 32, "unique": 13, "unique_combination": 4, "relationships": 7, "accepted_values": 7}


def test_planted_faults_are_found(spark):
    res = {r["check_id"]: r for r in quality.run_checks(_dq_tables(spark, SF_SMALL)).collect()}
    combo = res["unique_combination__stg_order_items__order_id__order_item_id"]
    assert combo["failures"] > 0 and combo["status"] == "fail"
    review = res["unique__stg_order_reviews__review_id"]
    assert review["severity"] == "warn" and review["status"] == ("warn" if review["failures"] else "pass")
    assert res["unique__fct_orders__order_id"]["failures"] == 0


def test_only_touched_tables_are_built(spark):
    built = []
    tables = {k: (lambda k=k, make=make: built.append(k) or make()) for k, make in _dq_tables(spark, SF_SMALL).items()}
    quality.run_checks(tables, [c for c in quality.CHECKS if c.test == "unique_combination"]).collect()
    assert sorted(built) == ["category_performance", "customer_cohorts", "stg_order_items", "stg_order_payments"]


@pytest.mark.parametrize(
    ("test", "failures"), [("not_null", 2), ("unique", 1), ("unique_combination", 1), ("relationships", 3), ("accepted_values", 2)]
)
def test_every_kind_of_fault_is_counted(spark, test, failures):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (7, "x"), (7, "y"), (9, "a"), (None, None), (None, "a")], "k int, v string")
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    check = {
        "not_null": quality.Check("child", "not_null", ("k",)),
        "unique": quality.Check("parent2", "unique", ("k",)),
        "unique_combination": quality.Check("child", "unique_combination", ("k", "v")),
        "relationships": quality.Check("child", "relationships", ("k",), "parent", "k"),
        "accepted_values": quality.Check("child", "accepted_values", ("v",), values=("a", "b")),
    }[test]
    tables = {"child": child, "parent": parent, "parent2": parent.union(parent.limit(1))}
    row = quality.run_checks(tables, [check]).first()
    assert row["failures"] == failures and row["status"] == "fail"
