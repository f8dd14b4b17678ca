"""Serving aggregates over the stored marts, and the scoring input contract.

These were per-request reshapes of small marts; here they are batch frames
written next to the marts. Money totals over a mart are sums of values with two
decimals, so they are rounded back to two decimals (exact, order-free).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.operators.features import FEATURE_COLUMNS_CATEGORICAL, FEATURE_COLUMNS_NUMERIC


def _money_sum(c: str) -> Column:
    return F.round(F.sum(F.col(c)), 2)


def kpi_summary(monthly: DataFrame) -> DataFrame:
    """Totals over months; AOV = revenue / max(orders, 1).

    total_customers adds the monthly distinct counts, so a repeat buyer counts
    once per month in which they bought (as specified).
    """
    agg = monthly.agg(
        F.sum("orders").cast("double").alias("total_orders"),
        F.sum("customers").cast("double").alias("total_customers"),
        _money_sum("gross_revenue").alias("total_gross_revenue"),
        F.count(F.lit(1)).cast("double").alias("months_covered"),
    )
    return agg.select(
        "total_orders",
        "total_customers",
        "total_gross_revenue",
        (F.col("total_gross_revenue") / F.greatest(F.col("total_orders"), F.lit(1.0))).alias("avg_order_value"),
        "months_covered",
    )


def category_top(category_performance: DataFrame, limit: int = 20) -> DataFrame:
    """Per category over all months: sums, max distinct products; top ``limit`` by item revenue."""
    summed = category_performance.groupBy("category").agg(
        F.sum("orders").alias("orders"),
        _money_sum("items_revenue").alias("items_revenue"),
        _money_sum("freight_revenue").alias("freight_revenue"),
        F.max("unique_products_sold").alias("unique_products_sold"),
    )
    return summed.orderBy(F.col("items_revenue").desc(), F.col("category")).limit(limit)


def cluster_profile_api(clusters: DataFrame, rfm: DataFrame) -> DataFrame:
    """join_clusters_rfm + per cluster n and three means, sorted by cluster."""
    merged = clusters.join(rfm.select("customer_unique_id", "recency_days", "frequency", "monetary"), "customer_unique_id", "left")
    return (
        merged.groupBy("cluster")
        .agg(
            F.count("customer_unique_id").alias("n"),
            F.avg("recency_days").alias("mean_recency_days"),
            F.avg("frequency").alias("mean_frequency"),
            F.avg("monetary").alias("mean_monetary"),
        )
        .orderBy("cluster")
    )


# The scoring request contract, one rule per input field:
# (field, default or None, required, lower bound, lower inclusive, upper bound, nullable).
# customer_state must be exactly 2 characters (default 'SP').
CONTRACT = [
    ("items_total", None, True, 0, False, None, False),
    ("items_subtotal", None, True, 0, True, None, False),
    ("freight_total", 0.0, False, 0, True, None, False),
    ("payments_total", None, True, 0, False, None, False),
    ("max_installments", 1, False, 1, True, 24, False),
    ("payment_count", 1, False, 1, True, None, False),
    ("item_count", 1, False, 1, True, None, False),
    ("unique_products", 1, False, 1, True, None, False),
    ("unique_sellers", 1, False, 1, True, None, False),
    ("delivery_days", None, False, 0, True, None, True),
    ("was_late", 0, False, 0, True, 1, False),
    ("avg_review_score", None, False, 1, True, 5, True),
    ("first_order_month", None, True, 1, True, 12, False),
]
STATE_DEFAULT = "SP"
STATE_LENGTH = 2


def contract_checks(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """(filled value columns, reason columns) of the contract for frame ``df``."""
    values, reasons = [], []
    for field, default, required, lo, lo_incl, hi, nullable in CONTRACT:
        raw = F.col(field)
        v = F.coalesce(raw, F.lit(default)) if default is not None else raw
        values.append(v.alias(field))
        if required:
            reasons.append(F.when(raw.isNull(), F.lit(f"{field}: required")))
        elif not nullable and default is None:
            reasons.append(F.when(raw.isNull(), F.lit(f"{field}: required")))
        if lo is not None:
            bad = (v < lo) if lo_incl else (v <= lo)
            reasons.append(F.when(bad, F.lit(f"{field}: {'>=' if lo_incl else '>'} {lo}")))
        if hi is not None:
            reasons.append(F.when(v > hi, F.lit(f"{field}: <= {hi}")))
    state = F.coalesce(F.col("customer_state"), F.lit(STATE_DEFAULT))
    values.append(state.alias("customer_state"))
    reasons.append(F.when(F.length(state) != STATE_LENGTH, F.lit(f"customer_state: length {STATE_LENGTH}")))
    return values, reasons


def score_contract(requests: DataFrame, id_col: str = "customer_unique_id") -> DataFrame:
    """Apply the input contract: filled values, ``accepted`` and the list of violated rules."""
    values, reasons = contract_checks(requests)
    why = F.concat_ws("; ", *reasons)
    return requests.select(F.col(id_col), *values, why.alias("reasons")).withColumn(
        "accepted", F.col("reasons") == ""
    )


def contract_sql(table: str, id_col: str = "customer_unique_id") -> str:
    """The same contract as DuckDB SQL (id, accepted, reasons)."""
    parts = []
    for field, default, required, lo, lo_incl, hi, nullable in CONTRACT:
        v = f"COALESCE({field}, {default!r})" if default is not None else field
        if required or (not nullable and default is None):
            parts.append(f"CASE WHEN {field} IS NULL THEN '{field}: required' END")
        if lo is not None:
            op = "<" if lo_incl else "<="
            parts.append(f"CASE WHEN {v} {op} {lo} THEN '{field}: {'>=' if lo_incl else '>'} {lo}' END")
        if hi is not None:
            parts.append(f"CASE WHEN {v} > {hi} THEN '{field}: <= {hi}' END")
    st = f"COALESCE(customer_state, '{STATE_DEFAULT}')"
    parts.append(f"CASE WHEN LENGTH({st}) <> {STATE_LENGTH} THEN 'customer_state: length {STATE_LENGTH}' END")
    why = "concat_ws('; ', " + ", ".join(parts) + ")"
    return f"SELECT {id_col}, {why} AS reasons, {why} = '' AS accepted FROM {table}"


MODEL_INPUTS = FEATURE_COLUMNS_NUMERIC + FEATURE_COLUMNS_CATEGORICAL
