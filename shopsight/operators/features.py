"""First-order features, the repeat-purchase label, observability and the split.

Everything is keyed by the person (``customer_unique_id``). One person may own a
large share of all orders, so rows are reduced per task before they move: a row
number with a bound keeps the first orders of each person (and, where later orders
fill gaps, of each set of missing columns), as plain rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight.functions import true_as_int, whole_days

# Model inputs (13 numeric, 1 categorical), in their published order.
FEATURE_COLUMNS_NUMERIC = [
    "delivery_days",
    "was_late",
    "avg_review_score",
    "item_count",
    "unique_products",
    "unique_sellers",
    "items_subtotal",
    "freight_total",
    "items_total",
    "max_installments",
    "payment_count",
    "payments_total",
    "first_order_month",
]
FEATURE_COLUMNS_CATEGORICAL = ["customer_state"]

# Columns carried from the first order (after the person id).
CARRIED = [
    "order_id",
    "purchased_at",
    "customer_state",
    "delivery_days",
    "was_late",
    "avg_review_score",
    "item_count",
    "unique_products",
    "unique_sellers",
    "items_subtotal",
    "freight_total",
    "items_total",
    "max_installments",
    "payment_count",
    "payments_total",
]
PERSON = "customer_unique_id"


def _in_time(*by: str):
    """Time order of a person's orders: purchase time (NULL last), then order id."""
    return Window.partitionBy(PERSON, *by).orderBy(F.col("purchased_at").asc_nulls_last(), F.col("order_id"))


def first_and_second_orders(fct: DataFrame, strict: bool = False, carried: Sequence[str] = tuple(CARRIED[2:])) -> DataFrame:
    """One row per person: the features of the first order and the time of the second (NULL without one).

    Default (reference semantics): each column takes its first non-NULL value in
    time order, which may come from a later order when the first has a NULL.
    ``strict=True`` takes every column from the true first row instead.
    ``carried`` names the columns that are taken besides the order's id and time.

    Of a person's orders that lack the same columns only the first can give a
    value, and two can be among the person's first two. So two rows of each such
    group are kept before the person's rows meet (the window group limit drops
    the others in their tasks), and one pass in time order over these gives all columns.
    The second of a group comes to this pass with its time and id only: what it has, the first has too.
    """
    columns = [*CARRIED[:2], *carried]
    f = fct.filter(F.col(PERSON).isNotNull()).select(PERSON, *columns)
    by = () if strict else ("_lacks",)
    if not strict:
        f = f.withColumn("_lacks", reduce(lambda x, y: x + y, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)]))
    kept = f.withColumn("_nth", F.row_number().over(_in_time(*by))).filter(F.col("_nth") <= 2)
    if not strict:
        kept = kept.select(PERSON, *columns[:2], *[F.when(F.col("_nth") == 1, F.col(c)).alias(c) for c in carried])
    whole = _in_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taken = [F.first(c, ignorenulls=not strict).over(whole).alias(c) for c in columns]
    # the second order's time comes from the second row, not from a column that gaps fill
    second = F.lead("purchased_at").over(_in_time()).alias("second_order_at")
    first = kept.select(PERSON, *taken, second, F.row_number().over(_in_time()).alias("_nth")).filter(F.col("_nth") == 1)
    return first.select(
        PERSON,
        F.col("order_id").alias("first_order_id"),
        F.col("purchased_at").alias("first_order_at"),
        *[true_as_int(c).alias(c) if c == "was_late" else F.col(c) for c in carried],
        F.month("purchased_at").alias("first_order_month"),
        "second_order_at",
    )


def first_order_features(fct: DataFrame, strict: bool = False, carried: Sequence[str] = tuple(CARRIED[2:])) -> DataFrame:
    """One row per person with the features of the first order (see :func:`first_and_second_orders`)."""
    return first_and_second_orders(fct, strict, carried).drop("second_order_at")


def second_orders(fct: DataFrame) -> DataFrame:
    """Per person, the time of the second order in time order (``nth(1)``).

    A row number with a bound: each task keeps at most two rows per person before
    the shuffle (window group limit), so a person with very many orders moves no
    more rows than there are tasks, times two.
    """
    f = fct.filter(F.col(PERSON).isNotNull()).select(PERSON, "purchased_at", "order_id")
    ranked = f.withColumn("_nth", F.row_number().over(_in_time())).filter(F.col("_nth") <= 2)
    return ranked.filter(F.col("_nth") == 2).select(PERSON, F.col("purchased_at").alias("second_order_at"))


def add_repeat_target(features: DataFrame, fct: DataFrame, horizon_days: int = 180) -> DataFrame:
    """repeat_within_<H>d = 1 if 0 <= whole days(second - first) <= H, else 0.

    Features without ``second_order_at`` get it from the order fact.
    """
    col = f"repeat_within_{horizon_days}d"
    out = features if "second_order_at" in features.columns else features.join(second_orders(fct), PERSON, "left")
    delta = whole_days("first_order_at", "second_order_at")
    hit = (delta >= 0) & (delta <= horizon_days)
    return out.withColumn(col, F.coalesce(hit, F.lit(False)).cast(T.IntegerType()))


def observable(features: DataFrame, fct: DataFrame, horizon_days: int = 180) -> DataFrame:
    """flt_observable: keep persons whose first order is at least H days before the data end.

    The bound is a scalar subquery (a global max with map-side partial max).
    """
    last = fct.select(F.max("purchased_at") - F.make_dt_interval(F.lit(horizon_days))).scalar()
    return features.filter(F.col("first_order_at") <= last)


def last_observable_date(fct: DataFrame, horizon_days: int = 180) -> Column:
    """Scalar: the calendar date of (data end - H days), used as eval_end."""
    return fct.select(F.to_date(F.max("purchased_at") - F.make_dt_interval(F.lit(horizon_days)))).scalar()


def split_label(date_col: str, train_end, eval_end=None) -> Column:
    """'train' if date < train_end; 'test' if train_end <= date (<= eval_end at midnight); else NULL.

    ``train_end``/``eval_end`` are date strings or Columns; a date bound means
    midnight, so later times on the eval_end day fall outside the test set.
    """
    d = F.col(date_col)
    te = F.to_timestamp_ntz(F.lit(train_end)) if isinstance(train_end, str) else train_end.cast("timestamp_ntz")
    test = d >= te
    if eval_end is not None:
        ee = F.to_timestamp_ntz(F.lit(eval_end)) if isinstance(eval_end, str) else eval_end.cast("timestamp_ntz")
        test = test & (d <= ee)
    return F.when(d < te, F.lit("train")).when(test, F.lit("test"))


def chronological_split(
    features: DataFrame, train_end: str, eval_end: str | None = None, date_col: str = "first_order_at"
) -> tuple[DataFrame, DataFrame]:
    """split_chrono: two filters over one frame (no shuffle)."""
    labelled = features.withColumn("_split", split_label(date_col, train_end, eval_end))
    train = labelled.filter(F.col("_split") == "train").drop("_split")
    test = labelled.filter(F.col("_split") == "test").drop("_split")
    return train, test


def propensity_frame(
    fct: DataFrame, horizon_days: int, train_end: str, strict: bool = False, carried: Sequence[str] = tuple(CARRIED[2:])
) -> DataFrame:
    """Features + label, observability filter and a split column (eval_end = last observable date)."""
    feats = add_repeat_target(first_and_second_orders(fct, strict, carried), fct, horizon_days)
    obs = observable(feats, fct, horizon_days)
    return obs.withColumn("split", split_label("first_order_at", train_end, last_observable_date(fct, horizon_days)))
