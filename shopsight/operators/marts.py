"""Core and analytic marts.

Core: ``dim_customers`` (person), ``dim_products`` (product), ``fct_orders`` (order).
Analytic: ``monthly_revenue``, ``revenue_by_state``, ``category_performance``,
``customer_cohorts``, ``customer_rfm``.

Money stays decimal inside (exact, order-free sums) and is cast to double at the
edge by ``to_output``. Customers are always the person id ``customer_unique_id``.

Skew: any key (a month, a state, a person) may hold a large share of rows.
Decomposable aggregates rely on map-side partial aggregation. A single distinct
count per skewable key is planned in two levels (dedupe on (key, value) first,
which spreads a hot key by value, then count per key with partial merge).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight.functions import calendar_days, exact_sum, money_sum, month_start, safe_divide
from shopsight.operators.intermediate import int_item_totals, int_payment_totals, int_review_aggregated
from shopsight.operators.rank import tile_of
from shopsight.operators.staging import Staging
from shopsight.session import materialize

# Statuses excluded from every analytic mart.
INVALID_STATUSES = ("canceled", "unavailable")
# RFM labels, in rule order.
RFM_LABELS = ("Champions", "Loyal", "New", "At Risk", "Lost", "Other")


def to_output(df: DataFrame) -> DataFrame:
    """Cast decimal columns to double (the mart edge)."""
    cols = [
        F.col(f.name).cast(T.DoubleType()).alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def valid_orders(fct: DataFrame) -> DataFrame:
    """flt_valid_orders: status not in (canceled, unavailable); NULL status is dropped too."""
    return fct.filter(~F.col("status").isin(*INVALID_STATUSES))


# --------------------------------------------------------------------------- core


def fct_orders(stg: Staging) -> DataFrame:
    """One row per order: orders + person + item/payment/review aggregates (25 columns).

    Four left joins; the three aggregate sides are unique on ``order_id`` by
    construction and share its hash partitioning, so after the customer join
    the order side is shuffled once and the three joins reuse that partitioning.
    """
    o = stg.orders
    c = stg.customers.select("customer_id", "customer_unique_id", F.col("state").alias("customer_state"))
    items = int_item_totals(stg.order_items)
    pays = int_payment_totals(stg.order_payments)
    revs = int_review_aggregated(stg.order_reviews).select(
        "order_id", "review_count", F.col("avg_score").alias("avg_review_score")
    )
    joined = (
        o.join(c, "customer_id", "left")
        .join(items, "order_id", "left")
        .join(pays, "order_id", "left")
        .join(revs, "order_id", "left")
    )
    return joined.select(
        "order_id",
        "customer_id",
        "customer_unique_id",
        "customer_state",
        "status",
        "purchased_at",
        "purchased_date",
        month_start("purchased_date").alias("purchased_month"),
        "approved_at",
        "delivered_customer_at",
        "estimated_delivery_at",
        "delivery_days",
        "was_late",
        "item_count",
        "unique_products",
        "unique_sellers",
        "items_subtotal",
        "freight_total",
        "items_total",
        "payment_count",
        "max_installments",
        "payments_total",
        "payment_types",
        "review_count",
        "avg_review_score",
    )


def dim_customers(stg: Staging) -> DataFrame:
    """One row per person: representative place, order counts, first/last order, lifespan.

    Level 1 groups (person, order) so a person with very many orders is spread
    by order id; level 2 counts orders per person with map-side merge. The
    representative state/city/zip is the minimum (a fixed stand-in for any_value).
    """
    c = stg.customers
    o = stg.orders.select("order_id", "customer_id", "purchased_at", "status")
    joined = c.join(o, "customer_id", "left")
    per_order = joined.groupBy("customer_unique_id", "order_id").agg(
        F.min("state").alias("state"),
        F.min("city").alias("city"),
        F.min("zip_code_prefix").alias("zip_code_prefix"),
        F.max(F.col("status") == "delivered").alias("is_delivered"),
        F.max(F.col("status") == "canceled").alias("is_canceled"),
        F.min("purchased_at").alias("first_at"),
        F.max("purchased_at").alias("last_at"),
    )
    agg = per_order.groupBy("customer_unique_id").agg(
        F.min("state").alias("state"),
        F.min("city").alias("city"),
        F.min("zip_code_prefix").alias("zip_code_prefix"),
        F.count("order_id").alias("total_orders"),
        F.count(F.when(F.col("is_delivered"), F.col("order_id"))).alias("delivered_orders"),
        F.count(F.when(F.col("is_canceled"), F.col("order_id"))).alias("canceled_orders"),
        F.min("first_at").alias("first_order_at"),
        F.max("last_at").alias("last_order_at"),
    )
    return agg.withColumn(
        "lifespan_days", calendar_days(F.to_date("last_order_at"), F.to_date("first_order_at"))
    ).withColumn("is_repeat_buyer", F.col("total_orders") > 1)


def dim_products(stg: Staging) -> DataFrame:
    """Products with the English category: translation, else Portuguese, else 'unknown'.

    The translation side is a category lookup; the planner broadcasts it when
    its measured size is under the broadcast threshold, else sort-merges.
    """
    p = stg.products
    t = stg.translation
    return p.join(t, "category_name_pt", "left").select(
        "product_id",
        "category_name_pt",
        F.coalesce(F.col("category_name_en"), F.col("category_name_pt"), F.lit("unknown")).alias("category"),
        "name_length",
        "description_length",
        "photos_count",
        "weight_g",
        "length_cm",
        "height_cm",
        "width_cm",
    )


# --------------------------------------------------------------------------- analytic


def _per_customer(v: DataFrame, key, sums: dict[str, str]) -> DataFrame:
    """Orders and money per (key, customer): one row of the fact is one order.

    Grouping by the customer first leaves the distinct count of customers to a
    plain count, and spreads a hot key over tasks.
    """
    return v.groupBy(key, "customer_unique_id").agg(F.count("order_id").alias("orders"), *[money_sum(c).alias(out) for out, c in sums.items()])


def monthly_revenue(fct: DataFrame) -> DataFrame:
    """Per month: orders, customers, three revenue sums and AOV (safe divide)."""
    sums = {"gross_revenue": "items_total", "items_revenue": "items_subtotal", "freight_revenue": "freight_total"}
    per = _per_customer(valid_orders(fct), F.col("purchased_month").alias("month"), sums)
    return (
        per.groupBy("month")
        .agg(
            F.sum("orders").alias("orders"),
            F.count("customer_unique_id").alias("customers"),
            *[exact_sum(c).alias(c) for c in sums],
        )
        .withColumn("avg_order_value", safe_divide("gross_revenue", "orders"))
        .orderBy("month")
    )


def revenue_by_state(fct: DataFrame) -> DataFrame:
    """Per customer state: orders, customers, revenue, AOV, revenue per customer."""
    per = _per_customer(valid_orders(fct), F.col("customer_state").alias("state"), {"gross_revenue": "items_total"})
    return (
        per.groupBy("state")
        .agg(
            F.sum("orders").alias("orders"),
            F.count("customer_unique_id").alias("customers"),
            exact_sum("gross_revenue").alias("gross_revenue"),
        )
        .withColumn("avg_order_value", safe_divide("gross_revenue", "orders"))
        .withColumn("revenue_per_customer", safe_divide("gross_revenue", "customers"))
        .orderBy(F.col("gross_revenue").desc(), F.col("state"))
    )


def category_performance(stg: Staging, fct: DataFrame | None = None) -> DataFrame:
    """Per category x month: orders, item and freight revenue, distinct products sold.

    Lines are summed per (order, product) first; a distinct count is then a
    two-level count over that table, once by order and once by product.
    """
    fct = fct if fct is not None else fct_orders(stg)
    items = stg.order_items.select("order_id", "product_id", "price", "freight_value")
    orders = valid_orders(fct).select("order_id", F.col("purchased_month").alias("month"))
    products = dim_products(stg).select("product_id", "category")
    joined = items.join(orders, "order_id").join(products, "product_id")
    by_order = (
        joined.groupBy("category", "month", "order_id")
        .agg(money_sum("price").alias("price"), money_sum("freight_value").alias("freight_value"))
        .groupBy("category", "month")
        .agg(
            F.count("order_id").alias("orders"),
            exact_sum("price").alias("items_revenue"),
            exact_sum("freight_value").alias("freight_revenue"),
        )
    )
    sold = joined.select(F.col("category").alias("_c"), F.col("month").alias("_m"), "product_id").distinct()
    sold = sold.groupBy("_c", "_m").agg(F.count("product_id").alias("unique_products_sold"))
    same = F.col("category").eqNullSafe(F.col("_c")) & F.col("month").eqNullSafe(F.col("_m"))
    return by_order.join(sold, same).drop("_c", "_m").orderBy("category", "month")


def active_months(orders: DataFrame) -> DataFrame:
    """customer_unique_id and words: the months of a person's orders as bits.

    A month is a number (months since January 1970); word ``w`` holds the months 64 w
    to 64 w + 63, one bit each, and a person has the words with a bit set (one or two for
    most, any number for long spans). Bits are merged by ``bit_or`` in the tasks, so
    a person with a huge order history leaves a task as one row a word. A missing date is
    a null word; persons without an id are left out.
    """
    month = 12 * (F.year("purchased_date") - 1970) + F.month("purchased_date") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(month, F.lit(64)))
    words = (
        orders.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id", F.floor(month / 64).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    return words.groupBy("customer_unique_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _months_of(words: Column) -> Column:
    """The months of all bits, a null word as a null month."""
    bits = F.sequence(F.lit(0), F.lit(63))
    is_set = lambda w, i: F.call_function("shiftright", w["bits"], i).bitwiseAND(F.lit(1)) == 1
    of_word = lambda w: F.transform(F.filter(bits, lambda i: is_set(w, i)), lambda i: w["word"] * 64 + i)
    return F.flatten(F.transform(words, lambda w: F.when(w["word"].isNull(), F.array(F.lit(None).cast("int"))).otherwise(of_word(w))))


def customer_cohorts(fct: DataFrame) -> DataFrame:
    """Cohort retention: first purchase month per person, active persons per month offset.

    Persons are reduced to the bits of their active months, and equal bit patterns
    (all buyers of one month, say) to one row with their number before the bits
    are read: the lowest bit is the cohort, the others are offsets from it.
    """
    patterns = active_months(valid_orders(fct)).groupBy("words").agg(F.count("*").alias("n"))
    months = _months_of(F.col("words"))
    activity = (
        patterns.select("n", F.array_min(months).alias("first"), F.explode(months).alias("month"))
        .where("first IS NOT NULL")
        .groupBy("first", (F.col("month") - F.col("first")).cast("long").alias("months_since_first"))
        .agg(F.sum("n").alias("active_customers"))
    )
    size = F.max(F.when(F.col("months_since_first") == 0, F.col("active_customers"))).over(Window.partitionBy("first"))
    return (
        activity.withColumn("cohort_size", size)
        .select(
            F.add_months(F.lit("1970-01-01").cast("date"), F.col("first")).alias("cohort_month"),
            "cohort_size",
            "months_since_first",
            "active_customers",
            safe_divide("active_customers", "cohort_size").alias("retention_rate"),
        )
        .orderBy("cohort_month", "months_since_first")
    )


def rfm_per_person(fct: DataFrame) -> DataFrame:
    """Per person over valid orders: last purchase date, distinct orders, money spent.

    The distinct order count is planned in two levels: (person, order) first,
    which spreads a person with very many orders over tasks, then per person
    with map-side merge.
    """
    v = valid_orders(fct)
    per_order = v.groupBy("customer_unique_id", "order_id").agg(
        F.max("purchased_date").alias("last_date"),
        money_sum("items_total").alias("monetary"),
    )
    return per_order.groupBy("customer_unique_id").agg(
        F.max("last_date").alias("last_date"),
        F.count("order_id").alias("frequency"),
        money_sum("monetary").alias("monetary"),
    )


def rfm_recency(per_person: DataFrame) -> DataFrame:
    """recency_days = days from the last purchase to the day after the overall last purchase.

    The snapshot date is a scalar subquery (a global max over the per-person
    maxima, map-side partial max), evaluated once.
    """
    as_of = per_person.select(F.date_add(F.max("last_date"), 1)).scalar()
    return per_person.select(
        "customer_unique_id",
        calendar_days(as_of, "last_date").alias("recency_days"),
        "frequency",
        F.col("monetary").cast(T.DoubleType()).alias("monetary"),
    )


def rfm_base(fct: DataFrame) -> DataFrame:
    """Per person: recency, frequency, monetary."""
    return rfm_recency(rfm_per_person(fct))


def rfm_label(r, f, m):
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), RFM_LABELS[0])
        .when((r >= 3) & (f >= 3) & (m >= 3), RFM_LABELS[1])
        .when((r >= 4) & (f <= 2), RFM_LABELS[2])
        .when((r <= 2) & (f >= 3), RFM_LABELS[3])
        .when((r <= 2) & (f <= 2), RFM_LABELS[4])
        .otherwise(RFM_LABELS[5])
    )


def customer_rfm(fct: DataFrame, **rank_opts) -> DataFrame:
    """RFM scores: three global ntile(5) (recency desc, frequency asc, monetary asc).

    Each ntile ends with the person id as a tie-break. Per-person figures are
    stored once; the keys that begin each fifth are selected from them, the three
    orders side by side, and the scores are projections.
    """
    base = rfm_recency(materialize(rfm_per_person(fct)))
    n_rows = base.count()
    uid = ("customer_unique_id", "asc", "first")
    orders = {
        "r_score": [("recency_days", "desc", "last"), uid],
        "f_score": [("frequency", "asc", "first"), uid],
        "m_score": [("monetary", "asc", "first"), uid],
    }
    with ThreadPoolExecutor(max_workers=len(orders)) as pool:
        made = {out: pool.submit(tile_of, base, 5, keys, n_rows, **rank_opts) for out, keys in orders.items()}
        scored = base.withColumns({out: m.result() for out, m in made.items()})
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select(
        "customer_unique_id",
        "recency_days",
        "frequency",
        "monetary",
        "r_score",
        "f_score",
        "m_score",
        F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("rfm_segment_code"),
        rfm_label(r, f, m).alias("rfm_segment_label"),
    )
