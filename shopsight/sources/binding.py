"""Binding of the driver's star-schema test tables to the nine raw retail tables.

Nothing is written: each raw table is a lazy DataFrame over the parquet files,
so Catalyst prunes columns and pushes filters into the scans. Ids stay bigint.
Raw columns with no counterpart are typed NULLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight.sources.schemas import MONEY

# Fixed values of the binding.
# Order status from (o_orderstatus, o_orderpriority): F -> delivered, O -> shipped,
# P + '5-LOW' -> canceled, P + '4-NOT SPECIFIED' -> unavailable, other P -> processing.
# Payment type from l_returnflag: R -> credit_card, A -> boleto, N -> voucher.
# Translation rows: <name> -> en_<name> for the part types without a letter l.
# Estimated delivery = order date + 321 days; purchase time = order date + (orderkey % 24) hours.
PAYMENT_TYPE_BY_FLAG = {"R": "credit_card", "A": "boleto", "N": "voucher"}
ESTIMATED_DELIVERY_DAYS = 321
CATEGORY_NULL_SIZE = 50

TEST_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Catalyst prunes per use."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null(dtype: T.DataType) -> Column:
    return F.lit(None).cast(dtype)


def _price(lineitem_price: Column) -> Column:
    return lineitem_price.cast(T.DecimalType(12, 2)).cast(MONEY)


def _freight(price: Column, tax: Column) -> Column:
    return F.round(price * tax.cast(T.DecimalType(4, 2)), 2).cast(MONEY)


def bind_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        c.join(o, c.c_custkey == o.o_custkey, "left")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "inner")
        .select(
            F.coalesce(F.col("o_orderkey"), -(F.col("c_custkey") + 1)).alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.lower("n_name").alias("customer_state"),
        )
    )


def _status(orderstatus: Column, priority: Column) -> Column:
    return (
        F.when(orderstatus == "F", "delivered")
        .when(orderstatus == "O", "shipped")
        .when((orderstatus == "P") & (priority == "5-LOW"), "canceled")
        .when((orderstatus == "P") & (priority == "4-NOT SPECIFIED"), "unavailable")
        .when(orderstatus == "P", "processing")
    )


def bind_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    # First ship date on or after the order date, per order: join on the order key,
    # then aggregate on the same key (the join's partitioning is reused).
    delivered = (
        o.join(li, o.o_orderkey == li.l_orderkey, "left")
        .groupBy("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        .agg(F.min(F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate"))).alias("delivered"))
    )
    ts = T.TimestampNTZType()
    return delivered.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("customer_id"),
        _status(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("order_status"),
        F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate")).alias("order_purchase_timestamp"),
        _null(ts).alias("order_approved_at"),
        _null(ts).alias("order_delivered_carrier_date"),
        F.col("delivered").alias("order_delivered_customer_date"),
        F.timestamp_add("DAY", F.lit(ESTIMATED_DELIVERY_DAYS), F.col("o_orderdate")).alias(
            "order_estimated_delivery_date"
        ),
    )


def bind_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    price = _price(F.col("l_extendedprice"))
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        _freight(price, F.col("l_tax")).alias("freight_value"),
    )


def bind_order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    price = _price(F.col("l_extendedprice"))
    ptype = F.lit(None).cast("string")
    for flag, name in PAYMENT_TYPE_BY_FLAG.items():
        ptype = F.when(F.col("l_returnflag") == flag, name).otherwise(ptype)
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        ptype.alias("payment_type"),
        F.col("l_linenumber").alias("payment_installments"),
        (price + _freight(price, F.col("l_tax"))).cast(MONEY).alias("payment_value"),
    )


def bind_order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "F")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("review_score"),
        _null(T.StringType()).alias("review_comment_title"),
        _null(T.StringType()).alias("review_comment_message"),
        F.col("l_shipdate").alias("review_creation_date"),
        _null(T.TimestampNTZType()).alias("review_answer_timestamp"),
    )


def bind_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    i = T.IntegerType()
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_size") != CATEGORY_NULL_SIZE, F.lower("p_type")).alias("product_category_name"),
        F.length("p_name").cast(i).alias("product_name_lenght"),
        _null(i).alias("product_description_lenght"),
        _null(i).alias("product_photos_qty"),
        F.col("p_size").alias("product_weight_g"),
        _null(i).alias("product_length_cm"),
        _null(i).alias("product_height_cm"),
        _null(i).alias("product_width_cm"),
    )


def bind_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation for every category of the parts whose name has no letter l."""
    name = F.lower("p_type")
    names = read_table(spark, sf_dir, "part").select(name.alias("string_field_0")).where(~F.contains(name, F.lit("l"))).distinct()
    return names.select("string_field_0", F.concat(F.lit("en_"), "string_field_0").alias("string_field_1"))


def bind_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        F.lower("n_name").alias("seller_state"),
    )


def bind_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lat = F.col("c_acctbal").cast(T.DecimalType(12, 2))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
        lat.alias("geolocation_lat"),
        (-lat).alias("geolocation_lng"),
        F.col("c_mktsegment").alias("geolocation_city"),
        F.lower("n_name").alias("geolocation_state"),
    )


_BINDERS = {
    "customers": bind_customers,
    "orders": bind_orders,
    "order_items": bind_order_items,
    "order_payments": bind_order_payments,
    "order_reviews": bind_order_reviews,
    "products": bind_products,
    "sellers": bind_sellers,
    "geolocation": bind_geolocation,
    "product_category_translation": bind_translation,
}


class RawTables:
    """Lazy, memoised access to the nine raw tables of one test scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = _BINDERS[name](self.spark, self.sf_dir)
        return self._cache[name]

    def names(self) -> tuple[str, ...]:
        return tuple(_BINDERS)


def bind_raw(spark: SparkSession, sf_dir: str) -> RawTables:
    return RawTables(spark, sf_dir)
