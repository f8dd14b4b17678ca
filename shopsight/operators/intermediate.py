"""Per-order aggregates of items, payments and reviews.

Lines of one order lie far apart in their tables, so combining them before they
move holds a map of nearly all lines in each task and saves nothing. Each table's
lines move once instead, as they are and by ``order_id``; all levels of its aggregate
and the star join of ``fct_orders`` (no fan-out: one row per order) reuse that
partitioning. An order with very many lines is aggregated as they stream by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.functions import exact_avg, money_sum


def int_item_totals(items: DataFrame) -> DataFrame:
    """item_count, unique_products, unique_sellers and three money sums per order.

    Both distinct counts are counts of marked lines: the first of each (order,
    product) and of each (order, seller). No line is copied for them. A line's total,
    its price and freight, is added up after the line has moved.
    """
    lines = items.select("order_id", "product_id", "seller_id", "price", "freight_value").repartition("order_id")
    marked = lines.withColumns({f"_first_{c}": _first_of("order_id", c) for c in ("product_id", "seller_id")})
    return marked.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if("_first_product_id").alias("unique_products"),
        F.count_if("_first_seller_id").alias("unique_sellers"),
        money_sum("price").alias("items_subtotal"),
        money_sum("freight_value").alias("freight_total"),
        money_sum(F.col("price") + F.col("freight_value")).alias("items_total"),
    )


def _first_of(key: str, value: str) -> Column:
    """Whether a row is the first of its (key, value); never for a NULL value."""
    nth = F.row_number().over(Window.partitionBy(key, value).orderBy(value))
    return F.col(value).isNotNull() & (nth == 1)


def int_payment_totals(payments: DataFrame) -> DataFrame:
    """payment_count, max_installments, payments_total and the sorted distinct types.

    The type list is a set over a small fixed domain, sorted and joined with ','.
    """
    lines = payments.select("order_id", "installments", "payment_value", "payment_type").repartition("order_id")
    return lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payment_count"),
        F.max("installments").alias("max_installments"),
        money_sum("payment_value").alias("payments_total"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("payment_type")), ","), F.lit("")).alias("payment_types"),
    )


def int_review_aggregated(reviews: DataFrame) -> DataFrame:
    """review_count, avg/max/min score per order."""
    return reviews.select("order_id", "score").repartition("order_id").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("review_count"),
        exact_avg("score").alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
    )
