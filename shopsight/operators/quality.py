"""Declarative data-quality checks over staging tables and marts.

Each check counts failing rows (or failing keys) with the usual semantics of
schema tests: ``not_null`` counts NULL rows; ``unique`` counts non-NULL values
that occur more than once; ``unique_combination`` counts column combinations
(NULLs included) that occur more than once; ``relationships`` counts non-NULL
child keys without a parent; ``accepted_values`` counts distinct non-NULL values
outside the list. The result is one row per check: (check_id, model, test,
columns, severity, failures, status).

All NULL counts of one table are a single aggregate pass; key checks are hash
aggregates and anti joins over the checked columns.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.operators.marts import RFM_LABELS
from shopsight.session import materialize_many

# Accepted domains.
ORDER_STATUSES = ["created", "approved", "invoiced", "processing", "shipped", "delivered", "unavailable", "canceled"]
PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card", "not_defined"]
SCORES = [1, 2, 3, 4, 5]


@dataclass(frozen=True)
class Check:
    model: str
    test: str  # not_null | unique | unique_combination | relationships | accepted_values
    columns: tuple[str, ...]
    to_model: str | None = None
    to_field: str | None = None
    values: tuple = field(default_factory=tuple)
    severity: str = "error"

    @property
    def check_id(self) -> str:
        target = f"__{self.to_model}" if self.to_model else ""
        return f"{self.test}__{self.model}__{'__'.join(self.columns)}{target}"


def _nn(model, *cols):
    return [Check(model, "not_null", (c,)) for c in cols]


def _uq(model, col, severity="error"):
    return [Check(model, "unique", (col,), severity=severity)]


def _rel(model, col, to_model, to_field):
    return [Check(model, "relationships", (col,), to_model, to_field)]


def _acc(model, col, values):
    return [Check(model, "accepted_values", (col,), values=tuple(values))]


def _combo(model, *cols):
    return [Check(model, "unique_combination", tuple(cols))]


# The declared checks, per table, in declaration order.
CHECKS: list[Check] = [
    *_uq("stg_customers", "customer_id"), *_nn("stg_customers", "customer_id"),
    *_nn("stg_customers", "customer_unique_id", "zip_code_prefix"),
    *_uq("stg_orders", "order_id"), *_nn("stg_orders", "order_id"),
    *_nn("stg_orders", "customer_id"), *_rel("stg_orders", "customer_id", "stg_customers", "customer_id"),
    *_acc("stg_orders", "status", ORDER_STATUSES),
    *_nn("stg_orders", "purchased_at"),
    *_combo("stg_order_items", "order_id", "order_item_id"),
    *_nn("stg_order_items", "order_id"), *_rel("stg_order_items", "order_id", "stg_orders", "order_id"),
    *_nn("stg_order_items", "product_id"), *_rel("stg_order_items", "product_id", "stg_products", "product_id"),
    *_rel("stg_order_items", "seller_id", "stg_sellers", "seller_id"),
    *_nn("stg_order_items", "price"),
    *_combo("stg_order_payments", "order_id", "payment_sequential"),
    *_nn("stg_order_payments", "order_id"), *_rel("stg_order_payments", "order_id", "stg_orders", "order_id"),
    *_acc("stg_order_payments", "payment_type", PAYMENT_TYPES),
    *_uq("stg_order_reviews", "review_id", severity="warn"), *_nn("stg_order_reviews", "review_id"),
    *_nn("stg_order_reviews", "order_id"), *_rel("stg_order_reviews", "order_id", "stg_orders", "order_id"),
    *_nn("stg_order_reviews", "score"), *_acc("stg_order_reviews", "score", SCORES),
    *_uq("stg_products", "product_id"), *_nn("stg_products", "product_id"),
    *_uq("stg_sellers", "seller_id"), *_nn("stg_sellers", "seller_id"),
    *_uq("stg_geolocation", "zip_code_prefix"), *_nn("stg_geolocation", "zip_code_prefix"),
    *_uq("stg_translation", "category_name_pt"), *_nn("stg_translation", "category_name_pt"),
    *_nn("stg_translation", "category_name_en"),
    *_uq("dim_customers", "customer_unique_id"), *_nn("dim_customers", "customer_unique_id", "total_orders"),
    *_uq("dim_products", "product_id"), *_nn("dim_products", "product_id", "category"),
    *_uq("fct_orders", "order_id"), *_nn("fct_orders", "order_id"),
    *_rel("fct_orders", "customer_unique_id", "dim_customers", "customer_unique_id"),
    *_nn("fct_orders", "status", "purchased_at"),
    *_uq("monthly_revenue", "month"), *_nn("monthly_revenue", "month", "orders", "gross_revenue"),
    *_uq("customer_rfm", "customer_unique_id"), *_nn("customer_rfm", "customer_unique_id"),
    *_acc("customer_rfm", "r_score", SCORES), *_acc("customer_rfm", "f_score", SCORES),
    *_acc("customer_rfm", "m_score", SCORES), *_acc("customer_rfm", "rfm_segment_label", RFM_LABELS),
    *_combo("customer_cohorts", "cohort_month", "months_since_first"),
    *_nn("customer_cohorts", "cohort_month", "months_since_first"),
    *_uq("revenue_by_state", "state"), *_nn("revenue_by_state", "state"),
    *_combo("category_performance", "category", "month"),
]


def _failures(check: Check, tables: dict[str, DataFrame]) -> DataFrame:
    """One-row frame with the failure count of a key-type check."""
    t = tables[check.model]
    cols = list(check.columns)
    if check.test == "unique":
        c = cols[0]
        dup = t.filter(F.col(c).isNotNull()).groupBy(c).count().filter(F.col("count") > 1)
        return dup.agg(F.count(F.lit(1)).alias("failures"))
    if check.test == "unique_combination":
        dup = t.groupBy(*cols).count().filter(F.col("count") > 1)
        return dup.agg(F.count(F.lit(1)).alias("failures"))
    if check.test == "relationships":
        c = cols[0]
        # child keys are pre-aggregated to (key, rows) map-side, so a key held by
        # a third of the child rows is one row before the anti join
        parent = tables[check.to_model].select(F.col(check.to_field).alias("_to")).distinct()
        child = t.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_to")).agg(F.count(F.lit(1)).alias("_n"))
        orphans = child.join(parent, "_to", "left_anti")
        return orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("failures"))
    if check.test == "accepted_values":
        c = cols[0]
        bad = t.filter(F.col(c).isNotNull() & ~F.col(c).isin(*check.values)).select(c).distinct()
        return bad.agg(F.count(F.lit(1)).alias("failures"))
    raise ValueError(check.test)


def _touched(checks: list[Check]) -> dict[str, list[str]]:
    """The columns that the checks read of each table."""
    out: dict[str, list[str]] = {}
    for c in checks:
        out.setdefault(c.model, []).extend(c.columns)
        if c.to_model:
            out.setdefault(c.to_model, []).append(c.to_field)
    return {model: list(dict.fromkeys(cols)) for model, cols in out.items()}


def run_checks(tables: Mapping[str, DataFrame | Callable[[], DataFrame]], checks: list[Check] | None = None, stored: Collection[str] = ()) -> DataFrame:
    """Evaluate the checks; one result row per check.

    ``tables`` are frames or functions that make them; only those that the checks
    touch are made, with the columns they touch. Those named in ``stored`` are
    written once before the checks read them; the others are read where they lie.
    """
    checks = checks if checks is not None else CHECKS
    made = {model: tables[model]() if callable(tables[model]) else tables[model] for model in _touched(checks)}
    made = {model: df.select(*_touched(checks)[model]) for model, df in made.items()}
    tables = {**made, **materialize_many({model: df for model, df in made.items() if model in stored})}
    spark = next(iter(tables.values())).sparkSession
    parts: list[DataFrame] = []
    # all NULL counts of a table in one pass
    by_model: dict[str, list[Check]] = {}
    for c in checks:
        if c.test == "not_null":
            by_model.setdefault(c.model, []).append(c)
    for model, cs in by_model.items():
        row = tables[model].agg(*[F.count_if(F.col(c.columns[0]).isNull()).alias(c.check_id) for c in cs])
        parts.append(
            row.select(
                F.explode(
                    F.array(*[F.struct(F.lit(c.check_id).alias("check_id"), F.col(c.check_id).alias("failures")) for c in cs])
                ).alias("kv")
            ).select("kv.check_id", "kv.failures")
        )
    for c in checks:
        if c.test != "not_null":
            parts.append(_failures(c, tables).select(F.lit(c.check_id).alias("check_id"), "failures"))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    meta = spark.createDataFrame(
        [(c.check_id, c.model, c.test, ",".join(c.columns), c.severity) for c in checks],
        "check_id string, model string, test string, columns string, severity string",
    )
    return (
        meta.join(counts, "check_id")
        .withColumn("failures", F.col("failures").cast("long"))
        .withColumn(
            "status",
            F.when(F.col("failures") == 0, "pass").when(F.col("severity") == "warn", "warn").otherwise("fail"),
        )
    )


def _sql_lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def check_sql(c: Check) -> str:
    """DuckDB text of one check's failure count."""
    if c.test == "not_null":
        return f"SELECT COUNT(*) FROM {c.model} WHERE {c.columns[0]} IS NULL"
    if c.test == "unique":
        col = c.columns[0]
        return f"SELECT COUNT(*) FROM (SELECT {col} FROM {c.model} WHERE {col} IS NOT NULL GROUP BY {col} HAVING COUNT(*) > 1)"
    if c.test == "unique_combination":
        cols = ", ".join(c.columns)
        return f"SELECT COUNT(*) FROM (SELECT {cols} FROM {c.model} GROUP BY {cols} HAVING COUNT(*) > 1)"
    if c.test == "relationships":
        col = c.columns[0]
        return (
            f"SELECT COUNT(*) FROM {c.model} ch WHERE ch.{col} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {c.to_model} p WHERE p.{c.to_field} = ch.{col})"
        )
    if c.test == "accepted_values":
        col = c.columns[0]
        vals = ", ".join(_sql_lit(v) for v in c.values)
        return f"SELECT COUNT(DISTINCT {col}) FROM {c.model} WHERE {col} IS NOT NULL AND {col} NOT IN ({vals})"
    raise ValueError(c.test)


def results_sql(checks: list[Check] | None = None) -> str:
    checks = checks if checks is not None else CHECKS
    rows = []
    for c in checks:
        rows.append(
            f"SELECT '{c.check_id}' AS check_id, '{c.model}' AS model, '{c.test}' AS test, "
            f"'{','.join(c.columns)}' AS columns, '{c.severity}' AS severity, ({check_sql(c)}) AS failures"
        )
    body = "\nUNION ALL\n".join(rows)
    return (
        "SELECT check_id, model, test, columns, severity, CAST(failures AS BIGINT) AS failures, "
        "CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status "
        f"FROM ({body})"
    )
