"""Plan-shape guards for the scale design (checked on the executed plans)."""

from __future__ import annotations

import re

from helpers import SF_CHECK
from shopsight.plans.warehouse import Warehouse
from shopsight.session import cluster_conf


def _plan(df) -> str:
    """The final adaptive plan (without the initial-plan section AQE also prints)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rfm_scores_are_projections(spark):
    plan = _plan(Warehouse.from_test_tables(spark, SF_CHECK).customer_rfm())
    # the fifths' first keys are selected beforehand: no window, and no row is dealt by a rank bucket
    assert "_rank_bucket" not in plan and "Window" not in plan


def test_scans_are_pruned(spark):
    plan = _plan(Warehouse.from_test_tables(spark, SF_CHECK).monthly_revenue())
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    lineitem = [s for s in schemas if "l_" in s]
    # only the order key, prices and tax are read from the line table for revenue
    assert lineitem and all("l_comment" not in s and "l_quantity" not in s for s in lineitem)


def test_no_cross_product_in_marts(spark):
    wh = Warehouse.from_test_tables(spark, SF_CHECK)
    for df in (wh.customer_cohorts(), wh.revenue_by_state(), wh.dim_customers):
        assert "CartesianProduct" not in _plan(df)


def test_cluster_conf_scales_with_input():
    small = cluster_conf(10 * 1024**3, 1000)
    big = cluster_conf(100 * 1024**4, 1000)
    assert int(small["spark.sql.shuffle.partitions"]) == 3000
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024**4 // (256 * 1024**2)


def test_no_expand_in_revenue_marts(spark):
    wh = Warehouse.from_test_tables(spark, SF_CHECK)
    for df in (wh.monthly_revenue(), wh.revenue_by_state()):
        assert "Expand" not in _plan(df)


def test_second_order_keeps_two_rows_per_person_and_task(spark):
    from shopsight.operators import features

    plan = _plan(features.second_orders(Warehouse.from_test_tables(spark, SF_CHECK).fct_orders))
    limits = re.findall(r"WindowGroupLimit .*, (Partial|Final)", plan)
    assert "Partial" in limits and "Join" not in plan.split("WindowGroupLimit")[0]


def test_cohorts_need_no_join(spark):
    wh = Warehouse.from_test_tables(spark, SF_CHECK)
    from shopsight.operators import marts
    from shopsight.session import materialize

    fact = materialize(wh.fct_orders.select("customer_unique_id", "purchased_date", "status"))
    plan = _plan(marts.customer_cohorts(fact))
    assert "Join" not in plan and "Expand" not in plan
