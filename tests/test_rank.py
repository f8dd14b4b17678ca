"""Distributed global ranking equals the single-partition window functions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shopsight.operators.rank import global_ntile, global_row_number, prefix_sums

SMALL = dict(rows_per_bucket=150, min_buckets=6)


def _frame(spark, n, seed=7):
    rng = np.random.default_rng(seed)
    vals = rng.integers(0, 4, size=n)  # heavy ties
    rows = [(int(i), None if i % 11 == 0 else int(v), float(rng.random())) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "id long, v long, x double")


@pytest.mark.parametrize("n", [3, 7, 2003])
@pytest.mark.parametrize("direction,nulls", [("asc", "first"), ("desc", "last"), ("asc", "last"), ("desc", "first")])
def test_global_ntile_equals_ntile(spark, n, direction, nulls):
    df = _frame(spark, n)
    keys = [("v", direction, nulls), ("id", "asc", "first")]
    got = global_ntile(df, 5, keys, "t", **SMALL)
    col = {("asc", "first"): F.col("v").asc_nulls_first(), ("asc", "last"): F.col("v").asc_nulls_last(),
           ("desc", "first"): F.col("v").desc_nulls_first(), ("desc", "last"): F.col("v").desc_nulls_last()}[(direction, nulls)]
    want = df.withColumn("t", F.ntile(5).over(Window.orderBy(col, F.col("id"))))
    diff = got.select("id", "t").exceptAll(want.select("id", "t"))
    assert got.count() == n
    assert diff.count() == 0


def test_global_row_number_is_a_permutation_in_order(spark):
    df = _frame(spark, 1500)
    got = global_row_number(df, [("x", "desc", "last"), ("id", "asc", "first")], "rn", **SMALL).toPandas()
    got = got.sort_values("rn")
    assert list(got["rn"]) == list(range(1, 1501))
    assert (np.diff(got["x"].to_numpy()) <= 0).all()


def test_prefix_sums(spark):
    df = _frame(spark, 1200).withColumn("one", F.lit(1))
    got = prefix_sums(df, [("id", "asc", "first")], {"one": F.col("one"), "x": F.col("x")}, **SMALL).toPandas()
    got = got.sort_values("id")
    assert list(got["cum_one"]) == list(range(1, 1201))
    assert np.allclose(got["cum_x"].to_numpy(), np.cumsum(got["x"].to_numpy()))
    assert (got["tot_one"] == 1200).all()


def test_no_single_partition_exchange_of_rows(spark):
    df = _frame(spark, 5000)
    plan = global_ntile(df, 5, [("v", "asc", "first"), ("id", "asc", "first")], "t", **SMALL)._jdf.queryExecution().executedPlan().toString()
    # the tiles' first keys are selected beforehand: the rows are not moved at all
    assert "Exchange" not in plan and "Window" not in plan


def test_many_buckets_use_array_search(spark):
    df = _frame(spark, 3000, seed=11)
    keys = [("v", "desc", "last"), ("id", "asc", "first")]
    got = global_ntile(df, 7, keys, "t", rows_per_bucket=20, min_buckets=100)
    want = df.withColumn("t", F.ntile(7).over(Window.orderBy(F.col("v").desc_nulls_last(), F.col("id"))))
    assert got.select("id", "t").exceptAll(want.select("id", "t")).count() == 0
