"""Query registry: one entry per operator id, each ``(spark, sf_dir) -> DataFrame``,
plus the DuckDB text of every entry that has an exact SQL equivalent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopsight.operators import intermediate, marts
from shopsight.plans.oracle import with_prelude
from shopsight.plans.warehouse import Warehouse

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_prelude(sql)
        return fn

    return deco


def wh(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse.from_test_tables(spark, sf_dir)


out = marts.to_output

# ----------------------------------------------------------------- staging (§2.2)


@register("stg_customers", "SELECT * FROM stg_customers")
def q_stg_customers(spark, sf):
    return wh(spark, sf).stg.customers


@register("stg_orders", "SELECT * FROM stg_orders")
def q_stg_orders(spark, sf):
    return wh(spark, sf).stg.orders


@register(
    "stg_order_items",
    "SELECT order_id, order_item_id, product_id, seller_id, shipping_limit_at, CAST(price AS DOUBLE) AS price,"
    " CAST(freight_value AS DOUBLE) AS freight_value, CAST(line_total AS DOUBLE) AS line_total FROM stg_order_items",
)
def q_stg_order_items(spark, sf):
    return out(wh(spark, sf).stg.order_items)


@register(
    "stg_order_payments",
    "SELECT order_id, payment_sequential, payment_type, installments, CAST(payment_value AS DOUBLE) AS payment_value"
    " FROM stg_order_payments",
)
def q_stg_order_payments(spark, sf):
    return out(wh(spark, sf).stg.order_payments)


@register("stg_order_reviews", "SELECT * FROM stg_order_reviews")
def q_stg_order_reviews(spark, sf):
    return wh(spark, sf).stg.order_reviews


@register("stg_products", "SELECT * FROM stg_products")
def q_stg_products(spark, sf):
    return wh(spark, sf).stg.products


@register("stg_sellers", "SELECT * FROM stg_sellers")
def q_stg_sellers(spark, sf):
    return wh(spark, sf).stg.sellers


@register("stg_translation", "SELECT * FROM stg_translation")
def q_stg_translation(spark, sf):
    return wh(spark, sf).stg.translation


@register("stg_geolocation", "SELECT * FROM stg_geolocation")
def q_stg_geolocation(spark, sf):
    return wh(spark, sf).stg.geolocation


# ----------------------------------------------------------------- intermediate + core (§2.5)


@register(
    "int_item_totals",
    "SELECT order_id, item_count, unique_products, unique_sellers, CAST(items_subtotal AS DOUBLE) AS items_subtotal,"
    " CAST(freight_total AS DOUBLE) AS freight_total, CAST(items_total AS DOUBLE) AS items_total FROM int_item_totals",
)
def q_int_item_totals(spark, sf):
    return out(intermediate.int_item_totals(wh(spark, sf).stg.order_items))


@register(
    "int_payment_totals",
    "SELECT order_id, payment_count, max_installments, CAST(payments_total AS DOUBLE) AS payments_total, payment_types"
    " FROM int_payment_totals",
)
def q_int_payment_totals(spark, sf):
    return out(intermediate.int_payment_totals(wh(spark, sf).stg.order_payments))


@register("int_review_aggregated", "SELECT * FROM int_review_aggregated")
def q_int_review_aggregated(spark, sf):
    return intermediate.int_review_aggregated(wh(spark, sf).stg.order_reviews)


FCT_OUT = (
    "SELECT order_id, customer_id, customer_unique_id, customer_state, status, purchased_at, purchased_date,"
    " purchased_month, approved_at, delivered_customer_at, estimated_delivery_at, delivery_days, was_late,"
    " item_count, unique_products, unique_sellers, CAST(items_subtotal AS DOUBLE) AS items_subtotal,"
    " CAST(freight_total AS DOUBLE) AS freight_total, CAST(items_total AS DOUBLE) AS items_total,"
    " payment_count, max_installments, CAST(payments_total AS DOUBLE) AS payments_total, payment_types,"
    " review_count, avg_review_score FROM fct_orders"
)


@register("fct_orders", FCT_OUT)
def q_fct_orders(spark, sf):
    return out(wh(spark, sf).fct_orders)


@register("join_fct_star", FCT_OUT)
def q_join_fct_star(spark, sf):
    return out(wh(spark, sf).fct_orders)


@register("dim_customers", "SELECT * FROM dim_customers")
def q_dim_customers(spark, sf):
    return wh(spark, sf).dim_customers


@register("join_left_cust_orders", "SELECT * FROM dim_customers")
def q_join_left_cust_orders(spark, sf):
    return wh(spark, sf).dim_customers


@register("dim_products", "SELECT * FROM dim_products")
def q_dim_products(spark, sf):
    return wh(spark, sf).dim_products


@register("join_left_translation", "SELECT product_id, category_name_pt, category FROM dim_products")
def q_join_left_translation(spark, sf):
    return wh(spark, sf).dim_products.select("product_id", "category_name_pt", "category")


# ----------------------------------------------------------------- analytic marts (§2.5, §2.6)


@register("monthly_revenue", "SELECT * FROM monthly_revenue ORDER BY month")
def q_monthly_revenue(spark, sf):
    return wh(spark, sf).monthly_revenue()


@register("revenue_by_state", "SELECT * FROM revenue_by_state ORDER BY gross_revenue DESC, state")
def q_revenue_by_state(spark, sf):
    return wh(spark, sf).revenue_by_state()


@register("category_performance", "SELECT * FROM category_performance ORDER BY category, month")
def q_category_performance(spark, sf):
    return wh(spark, sf).category_performance()


@register("join_inner_items", "SELECT * FROM category_performance ORDER BY category, month")
def q_join_inner_items(spark, sf):
    return wh(spark, sf).category_performance()


@register("customer_cohorts", "SELECT * FROM customer_cohorts ORDER BY cohort_month, months_since_first")
def q_customer_cohorts(spark, sf):
    return wh(spark, sf).customer_cohorts()


@register("join_cohort_self", "SELECT * FROM customer_cohorts ORDER BY cohort_month, months_since_first")
def q_join_cohort_self(spark, sf):
    return wh(spark, sf).customer_cohorts()


@register("rfm_base", "SELECT * FROM rfm_base")
def q_rfm_base(spark, sf):
    return marts.rfm_base(wh(spark, sf).fct_orders)


@register("join_cross_scalar", "SELECT * FROM rfm_base")
def q_join_cross_scalar(spark, sf):
    return marts.rfm_base(wh(spark, sf).fct_orders)


@register("customer_rfm", "SELECT * FROM customer_rfm")
def q_customer_rfm(spark, sf):
    return wh(spark, sf).customer_rfm()


@register(
    "flt_valid_orders",
    "SELECT order_id, status FROM fct_orders WHERE status NOT IN ('canceled', 'unavailable')",
)
def q_flt_valid_orders(spark, sf):
    return marts.valid_orders(wh(spark, sf).fct_orders).select("order_id", "status")


@register(
    "flt_state_case",
    "SELECT customer_unique_id, delivered_orders, canceled_orders FROM dim_customers",
)
def q_flt_state_case(spark, sf):
    return wh(spark, sf).dim_customers.select("customer_unique_id", "delivered_orders", "canceled_orders")


@register(
    "sort_mart",
    "SELECT month, orders FROM monthly_revenue ORDER BY month",
)
def q_sort_mart(spark, sf):
    return wh(spark, sf).monthly_revenue().select("month", "orders")



