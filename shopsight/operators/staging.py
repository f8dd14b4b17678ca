"""Staging: typed projections, renames and derived columns of the raw tables.

Every function is a pure ``DataFrame -> DataFrame`` projection; they stay lazy
and collapse into the scan (Catalyst prunes the columns later stages do not use).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.functions import exact_avg, whole_days


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        "customer_unique_id",
        F.col("customer_zip_code_prefix").alias("zip_code_prefix"),
        F.lower("customer_city").alias("city"),
        F.upper("customer_state").alias("state"),
    )


def stg_orders(raw: DataFrame) -> DataFrame:
    delivered = F.col("order_delivered_customer_date")
    return raw.select(
        "order_id",
        "customer_id",
        F.col("order_status").alias("status"),
        F.col("order_purchase_timestamp").alias("purchased_at"),
        F.col("order_approved_at").alias("approved_at"),
        F.col("order_delivered_carrier_date").alias("delivered_carrier_at"),
        delivered.alias("delivered_customer_at"),
        F.col("order_estimated_delivery_date").alias("estimated_delivery_at"),
        F.to_date("order_purchase_timestamp").alias("purchased_date"),
        whole_days("order_purchase_timestamp", delivered).alias("delivery_days"),
        # three-valued: NULL when not delivered; a NULL estimate falls to False
        F.when(delivered.isNull(), F.lit(None).cast("boolean"))
        .when(delivered > F.col("order_estimated_delivery_date"), F.lit(True))
        .otherwise(F.lit(False))
        .alias("was_late"),
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        F.col("shipping_limit_date").alias("shipping_limit_at"),
        "price",
        "freight_value",
        (F.col("price") + F.col("freight_value")).alias("line_total"),
    )


def stg_order_payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        "payment_sequential",
        "payment_type",
        F.col("payment_installments").alias("installments"),
        "payment_value",
    )


def stg_order_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(
        "review_id",
        "order_id",
        F.col("review_score").alias("score"),
        F.col("review_comment_title").alias("comment_title"),
        F.col("review_comment_message").alias("comment_message"),
        F.col("review_creation_date").alias("created_at"),
        F.col("review_answer_timestamp").alias("answered_at"),
    )


def stg_products(raw: DataFrame) -> DataFrame:
    return raw.select(
        "product_id",
        F.col("product_category_name").alias("category_name_pt"),
        F.col("product_name_lenght").alias("name_length"),
        F.col("product_description_lenght").alias("description_length"),
        F.col("product_photos_qty").alias("photos_count"),
        F.col("product_weight_g").alias("weight_g"),
        F.col("product_length_cm").alias("length_cm"),
        F.col("product_height_cm").alias("height_cm"),
        F.col("product_width_cm").alias("width_cm"),
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "seller_id",
        F.col("seller_zip_code_prefix").alias("zip_code_prefix"),
        F.lower("seller_city").alias("city"),
        F.upper("seller_state").alias("state"),
    )


def stg_translation(raw: DataFrame) -> DataFrame:
    """Positional rename: the source's first two columns are pt, en."""
    first, second = raw.columns[:2]
    return raw.select(F.col(first).alias("category_name_pt"), F.col(second).alias("category_name_en"))


def stg_geolocation(raw: DataFrame) -> DataFrame:
    """One row per zip prefix: mean coordinates, a fixed representative city/state.

    ``min`` replaces ``any_value`` so the result does not depend on task order;
    means are exact sums divided once (a hash aggregate with map-side combine, so
    a zip prefix holding a third of the rows is pre-reduced before the shuffle).
    """
    lat, lng = F.col("geolocation_lat"), F.col("geolocation_lng")
    return raw.groupBy(F.col("geolocation_zip_code_prefix").alias("zip_code_prefix")).agg(
        exact_avg(lat).alias("latitude"),
        exact_avg(lng).alias("longitude"),
        F.min(F.lower("geolocation_city")).alias("city"),
        F.min(F.upper("geolocation_state")).alias("state"),
    )


class Staging:
    """The nine staging frames over one set of raw tables (lazy, memoised)."""

    _FUNCS = {
        "customers": ("customers", stg_customers),
        "orders": ("orders", stg_orders),
        "order_items": ("order_items", stg_order_items),
        "order_payments": ("order_payments", stg_order_payments),
        "order_reviews": ("order_reviews", stg_order_reviews),
        "products": ("products", stg_products),
        "sellers": ("sellers", stg_sellers),
        "translation": ("product_category_translation", stg_translation),
        "geolocation": ("geolocation", stg_geolocation),
    }

    def __init__(self, raw):
        self.raw = raw
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._FUNCS:
            raise AttributeError(name)
        if name not in self._cache:
            source, fn = self._FUNCS[name]
            self._cache[name] = fn(self.raw[source])
        return self._cache[name]
