"""Exploratory statistics over the marts: rates, exact quantiles, histograms, pivots.

Quantiles are exact and distributed: the values at the target ranks are selected
by narrowing intervals, a few aggregates over a stored column. No task ever holds
all values of a column, and none is moved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight.functions import bool_rate, clip, exact_avg, month_start
from shopsight.operators.select import values_at

DIGITS = 12
#: Decimals of a reported mean, from 1 on and below.
MEAN_DIGITS = (6, 15)


def nunique(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """agg_nunique: distinct non-NULL values; exact by default, HyperLogLog++ as an opt-in."""
    agg = F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)
    return df.agg(agg.alias(f"nunique_{col}"))


def repeat_rate(dim_customers: DataFrame) -> DataFrame:
    """Persons, repeat buyers (>1 order) and their share; one row."""
    return dim_customers.agg(
        F.count_distinct("customer_unique_id").alias("total_customers"),
        F.count_if(F.col("is_repeat_buyer")).alias("repeat_customers"),
    ).withColumn("repeat_rate", F.try_divide(F.col("repeat_customers").cast("double"), F.col("total_customers")))


def value_counts(df: DataFrame, col: str, by: str = "count", n: int | None = None) -> DataFrame:
    """Counts per non-NULL value; sorted by key or by count (desc, key as tie-break), first n."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(col) if by == "key" else counts.orderBy(F.col("n").desc(), F.col(col))
    return ordered.limit(n) if n else ordered


def orders_per_customer(dim_customers: DataFrame, n: int = 15) -> DataFrame:
    """Histogram of total_orders by key, first n keys."""
    return value_counts(dim_customers, "total_orders", by="key", n=n)


def top_states(dim_customers: DataFrame, n: int = 15) -> DataFrame:
    """Persons per state, the n largest."""
    return value_counts(dim_customers, "state", by="count", n=n)


def segment_counts(rfm: DataFrame) -> DataFrame:
    """Persons per RFM label, 'Unknown' for a missing label."""
    return rfm.groupBy(F.coalesce(F.col("rfm_segment_label"), F.lit("Unknown")).alias("rfm_segment_label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def delivered(fct: DataFrame) -> DataFrame:
    """flt_delivered: orders with a known, non-negative delivery time."""
    return fct.filter(F.col("delivery_days").isNotNull() & (F.col("delivery_days") >= 0))


def late_observed(fct: DataFrame) -> DataFrame:
    """flt_late_observed: orders whose lateness is known."""
    return fct.filter(F.col("was_late").isNotNull())


def late_rate(fct: DataFrame) -> DataFrame:
    return fct.agg(
        F.count("was_late").alias("observed"),
        F.count_if(F.col("was_late")).alias("late"),
        bool_rate("was_late").alias("late_rate"),
    )


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = (), **rank_opts) -> DataFrame:
    """Exact quantiles with linear interpolation (position q * (n - 1)); one row per (group, q).

    The values at the ranks around each position are selected by narrowing
    intervals (``select``), all groups in the same passes; no row is moved by its
    group and no task holds all values of one. Groups are few (column names,
    clusters): a row for each of them reaches the driver. Groups without a value
    have no row.
    """
    from shopsight.session import materialize

    by = list(by)
    values = materialize(df.filter(F.col(col).isNotNull()).select(*by, F.col(col).alias("v")))  # read once a round
    groups = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted, bounds, rows = [], {}, []
    for g in groups.where("n > 0").collect():
        name = tuple(g[b] for b in by)
        own = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.lit(v)) for b, v in zip(by, name)], F.lit(True))
        bounds[name] = (g["lo"], g["hi"])
        for q in qs:
            pos = float(q) * (g["n"] - 1)
            wanted += [(name, own, math.floor(pos)), (name, own, math.ceil(pos))]
            rows.append((*name, float(q), pos - math.floor(pos)))
    found = [float(v) for v, _ in values_at(values, "v", wanted, bounds)]
    rows = [(*r, low, high) for r, low, high in zip(rows, found[::2], found[1::2])]
    fields = [values.schema[b] for b in by] + [T.StructField(c, T.DoubleType()) for c in ("q", "frac", "v_lo", "v_hi")]
    per_q = df.sparkSession.createDataFrame(rows, T.StructType(fields))
    return per_q.select(*by, "q", F.round(F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac"), DIGITS).alias("value"))


def approx_quantiles(df: DataFrame, col: str, qs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Opt-in: Greenwald-Khanna sketch quantiles (one pass, mergeable), not interpolated."""
    est = df.agg(F.percentile_approx(F.col(col).cast("double"), list(qs), accuracy).alias("v"))
    return est.select(F.posexplode("v").alias("i", "value")).select(
        F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("i") + 1).alias("q"), "value"
    )


def delivery_quantiles(fct: DataFrame, qs: Sequence[float] = (0.5, 0.9), approx: bool = False, **rank_opts) -> DataFrame:
    """Median and P90 of delivery days: exact (linear interpolation) or the sketch opt-in."""
    if approx:
        return approx_quantiles(delivered(fct), "delivery_days", qs)
    return exact_quantiles(delivered(fct), "delivery_days", qs, **rank_opts)


def histogram(df: DataFrame, col: str, bins: int, upper: float | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] of the (clipped) values, all bins listed.

    Bin i covers [lo_i, lo_{i+1}) and the last bin also its right edge. The
    bin frame (``bins`` rows) is generated from the parameter, not the data.
    """
    spark: SparkSession = df.sparkSession
    x = clip(F.col(col), hi=upper).cast("double") if upper is not None else F.col(col).cast("double")
    vals = df.filter(F.col(col).isNotNull()).select(x.alias("x"))
    # the value range is one scalar subquery (min and max in one pass), reused
    rng = vals.select(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    lo, hi = rng.getField("lo"), rng.getField("hi")
    width = (hi - lo) / bins
    idx = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)))
    counted = vals.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        all_bins.join(counted, "bin", "left")
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("bin_left"),
            F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("bin_right"),
            F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        )
        .where(lo.isNotNull())
    )


def delivery_histogram(fct: DataFrame, bins: int = 60, upper: float = 60) -> DataFrame:
    return histogram(delivered(fct), "delivery_days", bins, upper)


PREVIEW_COLUMNS = ["items_total", "delivery_days", "avg_review_score", "max_installments", "item_count", "unique_products"]


def repeat_feature_means(first_orders: DataFrame, dim_customers: DataFrame, cols=PREVIEW_COLUMNS) -> DataFrame:
    """Mean first-order features of one-time vs. repeat buyers, one row per feature.

    join_first_repeat (inner join on the person) + a two-row aggregate, then
    unpivot/pivot to feature x (one_time, repeat, repeat_minus_onetime).
    """
    joined = first_orders.join(dim_customers.select("customer_unique_id", "is_repeat_buyer"), "customer_unique_id")
    means = joined.groupBy("is_repeat_buyer").agg(*[exact_avg(c).alias(c) for c in cols])
    long = means.select(
        "is_repeat_buyer",
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("m")) for c in cols])).alias(
            "kv"
        ),
    ).select("is_repeat_buyer", "kv.feature", "kv.m")
    wide = long.groupBy("feature").agg(
        F.first(F.when(~F.col("is_repeat_buyer"), F.col("m")), ignorenulls=True).alias("one_time"),
        F.first(F.when(F.col("is_repeat_buyer"), F.col("m")), ignorenulls=True).alias("repeat"),
    )
    return wide.select(
        "feature",
        F.round("one_time", DIGITS).alias("one_time"),
        F.round("repeat", DIGITS).alias("repeat"),
        F.round(F.col("repeat") - F.col("one_time"), DIGITS).alias("repeat_minus_onetime"),
    )


def describe(df: DataFrame, cols: Sequence[str], **rank_opts) -> DataFrame:
    """count, mean, std (sample), min, 25%, 50%, 75%, max per column; exact quantiles.

    The columns are unpivoted to (column, x) so moments and quantiles of all
    columns come from one grouped pass each.
    """
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])
        ).alias("kv")
    ).select("kv.column", "kv.x")
    # the mean from a decimal sum that keeps a value's digits (order-free); the deviation is
    # a float reduction, rounded to 4 decimals so partition order cannot show
    wide = F.col("x").try_cast(T.DecimalType(38, 18))
    exact = F.try_divide(F.try_sum(wide).cast("double"), F.count("x").cast("double"))
    # NaN, infinities, values from 1e20 on and sums beyond them have no such decimal
    mean = F.coalesce(F.when(F.count(wide) == F.count("x"), exact), F.avg("x"))
    moments = long.groupBy("column").agg(
        F.count("x").alias("count"),
        F.when(F.abs(mean) >= 1, F.round(mean, MEAN_DIGITS[0])).otherwise(F.round(mean, MEAN_DIGITS[1])).alias("mean"),
        F.round(F.stddev_samp("x"), 4).alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    named = ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
    qs = exact_quantiles(long, "x", [q for q, _ in named], by=["column"], **rank_opts)
    wide = qs.groupBy("column").agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in named])
    return moments.join(wide, "column")


def rfm_describe(rfm: DataFrame, **rank_opts) -> DataFrame:
    cols = ["recency_days", "frequency", "monetary"]
    return describe(rfm.na.drop(subset=cols), cols, **rank_opts)


def month_offsets(orders: DataFrame) -> range:
    """Every offset that cohorts of these orders can have: 0 to the months between the first and the last order.

    One aggregate over a single column, two values to the driver; the cohorts themselves are not computed.
    """
    month = month_start("purchased_date")
    first, last = orders.agg(F.min(month), F.max(month)).first()
    return range(0 if first is None else 12 * (last.year - first.year) + last.month - first.month + 1)


def cohort_pivot(cohorts: DataFrame, offsets: Sequence[int] | None = None) -> DataFrame:
    """Retention matrix: cohort x months since first; missing cells stay NULL.

    The pivot values are the distinct offsets (a bounded list: months in the
    data range); passing them (see :func:`month_offsets`) keeps the plan to one
    aggregation pass. Cells of an offset that is not passed would be lost.
    """
    if offsets is None:
        offsets = [r[0] for r in cohorts.select("months_since_first").distinct().orderBy("months_since_first").collect()]
    return (
        cohorts.groupBy("cohort_month")
        .pivot("months_since_first", list(offsets))
        .agg(F.first("retention_rate"))
        .orderBy("cohort_month")
    )
