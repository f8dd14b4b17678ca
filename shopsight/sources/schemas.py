"""Explicit schemas of the nine raw retail tables.

Fixed by name, never inferred: inference once read a header row as data.
Money is a decimal, so sums are exact and independent of order; CSV money keeps
every digit it is written with, up to ten decimals.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_I = T.IntegerType()
_L = T.LongType()
_TS = T.TimestampNTZType()
_D = T.DoubleType()
MONEY = T.DecimalType(18, 2)
CSV_MONEY = T.DecimalType(24, 10)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# Keys are stored as strings in the CSV export; the test binding keeps them bigint.
RAW_SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        ("customer_id", _S),
        ("customer_unique_id", _S),
        ("customer_zip_code_prefix", _I),
        ("customer_city", _S),
        ("customer_state", _S),
    ),
    "orders": _struct(
        ("order_id", _S),
        ("customer_id", _S),
        ("order_status", _S),
        ("order_purchase_timestamp", _TS),
        ("order_approved_at", _TS),
        ("order_delivered_carrier_date", _TS),
        ("order_delivered_customer_date", _TS),
        ("order_estimated_delivery_date", _TS),
    ),
    "order_items": _struct(
        ("order_id", _S),
        ("order_item_id", _I),
        ("product_id", _S),
        ("seller_id", _S),
        ("shipping_limit_date", _TS),
        ("price", CSV_MONEY),
        ("freight_value", CSV_MONEY),
    ),
    "order_payments": _struct(
        ("order_id", _S),
        ("payment_sequential", _I),
        ("payment_type", _S),
        ("payment_installments", _I),
        ("payment_value", CSV_MONEY),
    ),
    "order_reviews": _struct(
        ("review_id", _S),
        ("order_id", _S),
        ("review_score", _I),
        ("review_comment_title", _S),
        ("review_comment_message", _S),
        ("review_creation_date", _TS),
        ("review_answer_timestamp", _TS),
    ),
    "products": _struct(
        ("product_id", _S),
        ("product_category_name", _S),
        ("product_name_lenght", _I),
        ("product_description_lenght", _I),
        ("product_photos_qty", _I),
        ("product_weight_g", _I),
        ("product_length_cm", _I),
        ("product_height_cm", _I),
        ("product_width_cm", _I),
    ),
    "sellers": _struct(
        ("seller_id", _S),
        ("seller_zip_code_prefix", _I),
        ("seller_city", _S),
        ("seller_state", _S),
    ),
    "geolocation": _struct(
        ("geolocation_zip_code_prefix", _I),
        ("geolocation_lat", _D),
        ("geolocation_lng", _D),
        ("geolocation_city", _S),
        ("geolocation_state", _S),
    ),
    # The translation file is read positionally (its header once came out as data).
    "product_category_translation": _struct(
        ("string_field_0", _S),
        ("string_field_1", _S),
    ),
}

# Free text may hold quoted line breaks: only this file cannot be split.
MULTILINE_TABLES = {"order_reviews"}
# Read by position, whatever the header says.
POSITIONAL_TABLES = {"product_category_translation"}

# File name of each raw table in a CSV drop; callers may pass their own mapping.
RAW_FILES: dict[str, str] = {name: f"{name}.csv" for name in RAW_SCHEMAS}

RAW_TABLES = tuple(RAW_SCHEMAS)
