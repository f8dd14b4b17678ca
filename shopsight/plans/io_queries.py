"""Registry entries for sources and sinks (§2.1).

Each entry writes what the test tables bind to into a fresh folder under the
session's checkpoint folder (the shared, reliable location on a cluster) and
reads it back, so the round trip itself is what is checked.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsight.operators import features, marts
from shopsight.plans.modeling import clusters
from shopsight.plans.registry import register, wh
from shopsight.plans.warehouse import build
from shopsight.session import ensure_checkpoint_dir
from shopsight.sources import io
from shopsight.sources.schemas import RAW_SCHEMAS

RAW_ORDER = list(RAW_SCHEMAS)
MART_ORDER = [
    "fct_orders",
    "dim_customers",
    "dim_products",
    "monthly_revenue",
    "revenue_by_state",
    "category_performance",
    "customer_cohorts",
    "customer_rfm",
]
SERVING_SQL_MARTS = [n for n in io.SERVING_MARTS if n != "customer_clusters"]


def _scratch(spark: SparkSession, kind: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{kind}/{uuid.uuid4().hex}"


def _export_raw_csv(spark: SparkSession, sf: str) -> str:
    """Write the nine raw tables as CSV folders named <table>.csv (string ids, as in a CSV drop)."""
    folder = _scratch(spark, "raw_csv")
    raw = wh(spark, sf).raw
    for name in RAW_ORDER:
        df = raw[name]
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMAS[name].fields]
        out = df.select(*cast)
        io.write_csv(out, f"{folder}/{name}.csv")
    return folder


def _counts(spark: SparkSession, counts: dict[str, int], key: str) -> DataFrame:
    return spark.createDataFrame(list(counts.items()), f"{key} string, rows long")


def _counts_sql(names, key: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS {key}, COUNT(*) AS rows FROM {n if key == 'mart' else 'raw_' + n}" for n in names)


_RAW_CTE_NAME = {"product_category_translation": "translation"}


def _raw_counts_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS raw_table, COUNT(*) AS rows FROM raw_{_RAW_CTE_NAME.get(n, n)}" for n in RAW_ORDER
    )


@register(
    "src_csv",
    "SELECT CAST(order_id AS VARCHAR) AS order_id, payment_sequential, payment_type, payment_installments,"
    " CAST(payment_value AS DOUBLE) AS payment_value FROM raw_order_payments",
)
def q_src_csv(spark, sf):
    folder = _scratch(spark, "raw_csv")
    raw = wh(spark, sf).raw["order_payments"]
    cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMAS["order_payments"].fields]
    io.write_csv(raw.select(*cast), f"{folder}/order_payments.csv")
    return marts.to_output(io.load_csv(spark, f"{folder}/order_payments.csv", "order_payments"))


@register("src_map", _raw_counts_sql())
def q_src_map(spark, sf):
    # stored, so every field of every record is parsed, and the stored rows are counted
    folder = _scratch(spark, "raw_parquet")
    tables = io.load_raw_csv(spark, _export_raw_csv(spark, sf))
    return _counts(spark, {n: io.write_table(df, f"{folder}/{n}") for n, df in tables.items()}, "raw_table")


@register("src_count", _raw_counts_sql())
def q_src_count(spark, sf):
    folder = _scratch(spark, "raw_parquet")
    raw = wh(spark, sf).raw
    counts = {n: io.write_table(raw[n], f"{folder}/{n}") for n in RAW_ORDER}
    return _counts(spark, counts, "raw_table")


@register("sink_table", _counts_sql(MART_ORDER, "mart"))
def q_sink_table(spark, sf):
    counts = build(wh(spark, sf), _scratch(spark, "marts"))
    return _counts(spark, counts, "mart")


@register("sink_csv", _counts_sql(MART_ORDER, "mart"))
def q_sink_csv(spark, sf):
    folder = _scratch(spark, "marts")
    csv = folder + "_csv"
    build(wh(spark, sf), folder, csv)
    rows = {n: io.read_mart(spark, n, csv, source="csv").count() for n in MART_ORDER}
    return _counts(spark, rows, "mart")


@register(
    "sink_parquet",
    _counts_sql(SERVING_SQL_MARTS, "mart")
    + " UNION ALL SELECT 'customer_clusters' AS mart, COUNT(*) AS rows FROM rfm_base"
    + " WHERE recency_days IS NOT NULL AND frequency IS NOT NULL AND monetary IS NOT NULL",
)
def q_sink_parquet(spark, sf):
    folder = _scratch(spark, "serving")
    w = wh(spark, sf)
    frames = {
        "customer_clusters": clusters(spark, sf),
        "monthly_revenue": w.monthly_revenue(),
        "customer_cohorts": w.customer_cohorts(),
        "customer_rfm": w.customer_rfm(),
        "revenue_by_state": w.revenue_by_state(),
        "category_performance": w.category_performance(),
    }
    counts = {n: io.write_table(marts.to_output(df), os.path.join(folder, n)) for n, df in frames.items()}
    return _counts(spark, counts, "mart")


@register("src_mart", "SELECT * FROM monthly_revenue")
def q_src_mart(spark, sf):
    folder = _scratch(spark, "marts")
    w = wh(spark, sf)
    io.write_table(w.monthly_revenue(), os.path.join(folder, "monthly_revenue"))
    return io.read_mart(spark, "monthly_revenue", folder)


@register("src_parquet", "SELECT * FROM customer_cohorts")
def q_src_parquet(spark, sf):
    folder = _scratch(spark, "serving")
    io.write_table(wh(spark, sf).customer_cohorts(), os.path.join(folder, "customer_cohorts"))
    return io.read_mart(spark, "customer_cohorts", folder, source="parquet")


_FEATURE_SQL = ", ".join(features.FEATURE_COLUMNS_NUMERIC + features.FEATURE_COLUMNS_CATEGORICAL)


@register("feature_lists", f"SELECT customer_unique_id, {_FEATURE_SQL} FROM feat_first")
def q_feature_lists(spark, sf):
    cols = features.FEATURE_COLUMNS_NUMERIC + features.FEATURE_COLUMNS_CATEGORICAL
    return marts.to_output(features.first_order_features(wh(spark, sf).fct_orders).select("customer_unique_id", *cols))
