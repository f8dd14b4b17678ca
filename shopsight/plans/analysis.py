"""Registry entries for features, metrics, EDA, serving and data-quality operators."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.operators import eda, features, marts, metrics, quality, serving
from shopsight.plans.oracle import register_ctes
from shopsight.plans.registry import register, wh
from shopsight.plans.warehouse import Warehouse
from shopsight.session import materialize

out = marts.to_output
PERSON = "customer_unique_id"

# Fixed parameters of the test fixtures: the label horizon of the reference (180 d),
# the short horizon that gives a rare label on the test data (7 d), and the split date.
HORIZON = 180
RARE_HORIZON = 7
TRAIN_END = "1995-07-01"

_CARRIED_SQL = [
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
_ORD = "ORDER BY purchased_at ASC NULLS LAST, order_id ASC"
_MONEY = {"items_subtotal", "freight_total", "items_total", "payments_total"}


def _first(c: str, alias: str | None = None) -> str:
    return f"first({c} {_ORD}) FILTER (WHERE {c} IS NOT NULL) AS {alias or c}"


def _feat_select(prefix: str = "") -> str:
    cols = []
    for c in _CARRIED_SQL:
        if c == "was_late":
            cols.append(f"CASE WHEN {prefix}was_late THEN 1 ELSE 0 END AS was_late")
        elif c in _MONEY:
            cols.append(f"CAST({prefix}{c} AS DOUBLE) AS {c}")
        else:
            cols.append(f"{prefix}{c}")
    return ", ".join(cols)


register_ctes(
    f"""
feat_raw AS (
  SELECT customer_unique_id, {_first('order_id', 'first_order_id')}, {_first('purchased_at', 'first_order_at')},
         {', '.join(_first(c) for c in _CARRIED_SQL)}
  FROM fct_orders WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id
),
feat_first AS (
  SELECT customer_unique_id, first_order_id, first_order_at, {_feat_select()},
         CAST(month(first_order_at) AS INTEGER) AS first_order_month
  FROM feat_raw
),
feat_ranked AS (
  SELECT customer_unique_id, purchased_at,
         ROW_NUMBER() OVER (PARTITION BY customer_unique_id {_ORD}) AS rn
  FROM fct_orders WHERE customer_unique_id IS NOT NULL
),
feat_second AS (
  SELECT customer_unique_id, purchased_at AS second_order_at FROM feat_ranked WHERE rn = 2
),
feat_target AS (
  SELECT f.*, s.second_order_at,
    CASE WHEN date_sub('day', f.first_order_at, s.second_order_at) BETWEEN 0 AND {HORIZON} THEN 1 ELSE 0 END
      AS repeat_within_{HORIZON}d
  FROM feat_first f LEFT JOIN feat_second s ON s.customer_unique_id = f.customer_unique_id
),
feat_target_rare AS (
  SELECT f.*, s.second_order_at,
    CASE WHEN date_sub('day', f.first_order_at, s.second_order_at) BETWEEN 0 AND {RARE_HORIZON} THEN 1 ELSE 0 END
      AS repeat_within_{RARE_HORIZON}d
  FROM feat_first f LEFT JOIN feat_second s ON s.customer_unique_id = f.customer_unique_id
),
feat_bounds AS (
  SELECT MAX(purchased_at) - to_days({HORIZON}) AS last_observable,
         CAST(CAST(MAX(purchased_at) - to_days({HORIZON}) AS DATE) AS TIMESTAMP) AS eval_end
  FROM fct_orders
),
feat_split AS (
  SELECT t.*, CASE WHEN t.first_order_at < TIMESTAMP '{TRAIN_END}' THEN 'train'
                   WHEN t.first_order_at >= TIMESTAMP '{TRAIN_END}' AND t.first_order_at <= b.eval_end THEN 'test'
              END AS split
  FROM feat_target t, feat_bounds b WHERE t.first_order_at <= b.last_observable
),
scored_fixture AS (
  SELECT customer_unique_id, repeat_within_{RARE_HORIZON}d AS label,
         (customer_unique_id * 7919 % 1000) / 1000.0 AS score
  FROM feat_target_rare
),
sf_table AS (
  SELECT score, pos, neg,
         SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
         SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg,
         SUM(pos) OVER () AS tot_pos, SUM(neg) OVER () AS tot_neg
  FROM (SELECT score, SUM(label) AS pos, COUNT(*) - SUM(label) AS neg FROM scored_fixture GROUP BY score)
),
sf_ranked AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC NULLS LAST, customer_unique_id ASC) AS rn,
         COUNT(*) OVER () AS n, SUM(label) OVER () AS p
  FROM scored_fixture
),
sf_counts AS (
  SELECT COUNT(*) AS n_samples, CAST(SUM(label) AS BIGINT) AS n_positives,
         CAST(SUM(label) AS DOUBLE) / COUNT(*) AS base_rate
  FROM scored_fixture
),
sf_auc AS (
  SELECT ROUND(SUM(CASE WHEN pos > 0 THEN (pos / tot_pos) * (cum_pos / (cum_pos + cum_neg)) END), 12) AS pr_auc,
         ROUND(SUM(pos * (tot_neg - cum_neg + 0.5 * neg)) / (FIRST(tot_pos) * FIRST(tot_neg)), 12) AS roc_auc
  FROM sf_table
),
sf_brier AS (
  SELECT ROUND(AVG(POW(score - label, 2)), 12) AS brier FROM scored_fixture
),
sf_topk AS (
  SELECT
    CASE WHEN MAX(p) > 0 THEN ROUND(SUM(CASE WHEN rn <= GREATEST(1, CEIL(n * 0.1)) THEN label ELSE 0 END) / MAX(p), 12) ELSE 0.0 END AS recall_top_10pct,
    CASE WHEN MAX(p) > 0 THEN ROUND(SUM(CASE WHEN rn <= GREATEST(1, CEIL(n * 0.2)) THEN label ELSE 0 END) / MAX(p), 12) ELSE 0.0 END AS recall_top_20pct,
    CASE WHEN MAX(p) > 0 THEN ROUND((SUM(CASE WHEN rn <= GREATEST(1, CEIL(n * 0.1)) THEN label ELSE 0 END) / MAX(GREATEST(1, CEIL(n * 0.1)))) / (MAX(p) / MAX(n)), 12) ELSE 0.0 END AS lift_top_10pct,
    CASE WHEN MAX(p) > 0 THEN ROUND((SUM(CASE WHEN rn <= GREATEST(1, CEIL(n * 0.2)) THEN label ELSE 0 END) / MAX(GREATEST(1, CEIL(n * 0.2)))) / (MAX(p) / MAX(n)), 12) ELSE 0.0 END AS lift_top_20pct
  FROM sf_ranked
)"""
)


def _fct(spark, sf) -> DataFrame:
    return wh(spark, sf).fct_orders


def _features(spark, sf, strict=False) -> DataFrame:
    return features.first_order_features(_fct(spark, sf), strict=strict)


def _scored_fixture(spark, sf) -> DataFrame:
    fct = _fct(spark, sf)
    labelled = features.add_repeat_target(features.first_and_second_orders(fct, carried=()), fct, RARE_HORIZON)
    return labelled.select(
        PERSON,
        F.col(f"repeat_within_{RARE_HORIZON}d").alias("label"),
        ((F.col(PERSON) * 7919 % 1000) / 1000.0).alias("score"),
    )


# ----------------------------------------------------------------- features (§2.9, §2.6, §2.7)


@register("first_order_features", "SELECT * FROM feat_first")
def q_first_order_features(spark, sf):
    return out(_features(spark, sf))


@register(
    "win_first_nonnull",
    "SELECT customer_unique_id, first_order_id, delivery_days, was_late, avg_review_score FROM feat_first",
)
def q_win_first_nonnull(spark, sf):
    taken = ("delivery_days", "was_late", "avg_review_score")
    return features.first_order_features(_fct(spark, sf), carried=taken).select(PERSON, "first_order_id", *taken)


@register("win_nth_order", "SELECT customer_unique_id, second_order_at FROM feat_second")
def q_win_nth_order(spark, sf):
    return features.second_orders(_fct(spark, sf))


@register("repeat_target", "SELECT * FROM feat_target")
def q_repeat_target(spark, sf):
    fct = _fct(spark, sf)
    return out(features.add_repeat_target(features.first_and_second_orders(fct), fct, HORIZON))


@register(
    "join_second_order",
    f"SELECT customer_unique_id, second_order_at, repeat_within_{HORIZON}d FROM feat_target",
)
def q_join_second_order(spark, sf):
    fct = _fct(spark, sf)
    t = features.add_repeat_target(features.first_and_second_orders(fct, carried=()), fct, HORIZON)
    return t.select(PERSON, "second_order_at", f"repeat_within_{HORIZON}d")


@register(
    "flt_observable",
    "SELECT customer_unique_id, first_order_at FROM feat_target t, feat_bounds b WHERE t.first_order_at <= b.last_observable",
)
def q_flt_observable(spark, sf):
    fct = _fct(spark, sf)
    return features.observable(features.first_order_features(fct, carried=()), fct, HORIZON).select(PERSON, "first_order_at")


@register("split_chrono", "SELECT customer_unique_id, split FROM feat_split WHERE split IS NOT NULL")
def q_split_chrono(spark, sf):
    fct = _fct(spark, sf)
    return features.propensity_frame(fct, HORIZON, TRAIN_END, carried=()).filter(F.col("split").isNotNull()).select(PERSON, "split")


@register(
    "split_distribution",
    "SELECT split, CAST(date_trunc('month', first_order_at) AS DATE) AS first_order_month_start, COUNT(*) AS customers"
    " FROM feat_split WHERE split IS NOT NULL GROUP BY 1, 2",
)
def q_split_distribution(spark, sf):
    fct = _fct(spark, sf)
    fr = features.propensity_frame(fct, HORIZON, TRAIN_END, carried=()).filter(F.col("split").isNotNull())
    return fr.groupBy("split", F.trunc("first_order_at", "MM").alias("first_order_month_start")).agg(
        F.count(F.lit(1)).alias("customers")
    )


@register(
    "positive_rate",
    f"""SELECT 'raw' AS stage, COUNT(*) AS customers, AVG(repeat_within_{HORIZON}d) AS positive_rate FROM feat_target
    UNION ALL SELECT 'observable', COUNT(*), AVG(repeat_within_{HORIZON}d) FROM feat_split
    UNION ALL SELECT split, COUNT(*), AVG(repeat_within_{HORIZON}d) FROM feat_split WHERE split IS NOT NULL GROUP BY split""",
)
def q_positive_rate(spark, sf):
    fct = _fct(spark, sf)
    col = f"repeat_within_{HORIZON}d"
    raw = features.add_repeat_target(features.first_and_second_orders(fct, carried=()), fct, HORIZON)
    fr = features.propensity_frame(fct, HORIZON, TRAIN_END, carried=())

    def rate(df, stage):
        return df.groupBy(stage).agg(F.count(F.lit(1)).alias("customers"), F.avg(col).alias("positive_rate"))

    return (
        rate(raw, F.lit("raw").alias("stage"))
        .unionByName(rate(fr, F.lit("observable").alias("stage")))
        .unionByName(rate(fr.filter(F.col("split").isNotNull()), F.col("split").alias("stage")))
    )


# ----------------------------------------------------------------- metrics (§2.9)


@register("m_counts", "SELECT * FROM sf_counts")
def q_m_counts(spark, sf):
    return metrics.counts(_scored_fixture(spark, sf))


@register("m_brier", "SELECT * FROM sf_brier")
def q_m_brier(spark, sf):
    return metrics.brier(_scored_fixture(spark, sf))


@register("m_pr_auc", "SELECT pr_auc FROM sf_auc")
def q_m_pr_auc(spark, sf):
    return metrics.auc_metrics(_scored_fixture(spark, sf)).select("pr_auc")


@register("m_roc_auc", "SELECT roc_auc FROM sf_auc")
def q_m_roc_auc(spark, sf):
    return metrics.auc_metrics(_scored_fixture(spark, sf)).select("roc_auc")


@register("m_recall_at_k", "SELECT recall_top_10pct, recall_top_20pct FROM sf_topk")
def q_m_recall_at_k(spark, sf):
    return metrics.recall_lift(_scored_fixture(spark, sf), PERSON).select("recall_top_10pct", "recall_top_20pct")


@register("m_lift_at_k", "SELECT lift_top_10pct, lift_top_20pct FROM sf_topk")
def q_m_lift_at_k(spark, sf):
    return metrics.recall_lift(_scored_fixture(spark, sf), PERSON).select("lift_top_10pct", "lift_top_20pct")


@register(
    "evaluate",
    "SELECT n_samples, n_positives, base_rate, roc_auc, pr_auc, brier, recall_top_10pct, recall_top_20pct,"
    " lift_top_10pct FROM sf_counts, sf_auc, sf_brier, sf_topk",
)
def q_evaluate(spark, sf):
    return metrics.evaluate(_scored_fixture(spark, sf), PERSON)


@register(
    "rank_top_frac",
    "SELECT customer_unique_id, label, score FROM sf_ranked WHERE rn <= GREATEST(1, CEIL(n * 0.1))",
)
def q_rank_top_frac(spark, sf):
    return metrics.top_fraction(_scored_fixture(spark, sf), 0.10, PERSON)


@register(
    "pr_curve",
    "SELECT score AS threshold, cum_pos / (cum_pos + cum_neg) AS precision,"
    " CAST(cum_pos AS DOUBLE) / NULLIF(tot_pos, 0) AS recall, tot_pos / (tot_pos + tot_neg) AS base_rate FROM sf_table",
)
def q_pr_curve(spark, sf):
    return metrics.pr_curve(_scored_fixture(spark, sf))


def _calibration_sql() -> str:
    edges = " + ".join(f"CAST(score > {e!r} AS INTEGER)" for e in metrics.CALIBRATION_EDGES)
    return (
        f"SELECT {edges} AS bin, ROUND(AVG(score), 12) AS prob_pred, ROUND(AVG(CAST(label AS DOUBLE)), 12) AS prob_true,"
        " COUNT(*) AS n FROM scored_fixture GROUP BY 1"
    )


@register("calibration_bins", _calibration_sql())
def q_calibration_bins(spark, sf):
    return metrics.calibration_bins(_scored_fixture(spark, sf))


@register(
    "score_decile",
    "SELECT customer_unique_id, score, LEAST(GREATEST(CAST(FLOOR(score * 10) AS INTEGER) + 1, 1), 10) AS decile"
    " FROM scored_fixture",
)
def q_score_decile(spark, sf):
    s = _scored_fixture(spark, sf)
    return s.select(PERSON, "score", metrics.score_decile(F.col("score")).alias("decile"))


@register(
    "class_weights",
    "SELECT label, COUNT(*) AS n, (SELECT COUNT(*) FROM feat_split WHERE split = 'train') / (2.0 * COUNT(*)) AS weight"
    f" FROM (SELECT repeat_within_{HORIZON}d AS label FROM feat_split WHERE split = 'train') GROUP BY label",
)
def q_class_weights(spark, sf):
    from shopsight.operators.propensity import class_weights

    fr = features.propensity_frame(_fct(spark, sf), HORIZON, TRAIN_END, carried=())
    train = fr.filter(F.col("split") == "train").select(F.col(f"repeat_within_{HORIZON}d").alias("label"))
    return class_weights(train, "label")


# ----------------------------------------------------------------- EDA (§2.3, §2.5)


@register("agg_nunique", "SELECT COUNT(DISTINCT customer_unique_id) AS nunique_customer_unique_id FROM dim_customers")
def q_agg_nunique(spark, sf):
    return eda.nunique(wh(spark, sf).dim_customers, PERSON)


@register(
    "repeat_rate",
    "SELECT COUNT(DISTINCT customer_unique_id) AS total_customers, COUNT(*) FILTER (WHERE is_repeat_buyer) AS repeat_customers,"
    " COUNT(*) FILTER (WHERE is_repeat_buyer) / NULLIF(COUNT(DISTINCT customer_unique_id), 0) AS repeat_rate FROM dim_customers",
)
def q_repeat_rate(spark, sf):
    return eda.repeat_rate(wh(spark, sf).dim_customers)


@register(
    "orders_per_customer",
    "SELECT total_orders, COUNT(*) AS n FROM dim_customers GROUP BY total_orders ORDER BY total_orders LIMIT 15",
)
def q_orders_per_customer(spark, sf):
    return eda.orders_per_customer(wh(spark, sf).dim_customers)


@register(
    "top_states",
    "SELECT state, COUNT(*) AS n FROM dim_customers WHERE state IS NOT NULL GROUP BY state ORDER BY n DESC, state LIMIT 15",
)
def q_top_states(spark, sf):
    return eda.top_states(wh(spark, sf).dim_customers)


@register(
    "topk",
    "SELECT state, COUNT(*) AS n FROM dim_customers WHERE state IS NOT NULL GROUP BY state ORDER BY n DESC, state LIMIT 5",
)
def q_topk(spark, sf):
    return eda.top_states(wh(spark, sf).dim_customers, n=5)


@register(
    "segment_counts",
    "SELECT COALESCE(rfm_segment_label, 'Unknown') AS rfm_segment_label, COUNT(*) AS n FROM customer_rfm GROUP BY 1",
)
def q_segment_counts(spark, sf):
    return eda.segment_counts(wh(spark, sf).customer_rfm())


@register(
    "late_rate",
    "SELECT COUNT(was_late) AS observed, COUNT(*) FILTER (WHERE was_late) AS late,"
    " COUNT(*) FILTER (WHERE was_late) / NULLIF(COUNT(was_late), 0) AS late_rate FROM fct_orders",
)
def q_late_rate(spark, sf):
    return eda.late_rate(_fct(spark, sf))


@register("flt_delivered", "SELECT order_id, delivery_days FROM fct_orders WHERE delivery_days IS NOT NULL AND delivery_days >= 0")
def q_flt_delivered(spark, sf):
    return eda.delivered(_fct(spark, sf)).select("order_id", "delivery_days")


@register("flt_late_observed", "SELECT order_id, was_late FROM fct_orders WHERE was_late IS NOT NULL")
def q_flt_late_observed(spark, sf):
    return eda.late_observed(_fct(spark, sf)).select("order_id", "was_late")


@register(
    "flt_dropna",
    "SELECT customer_unique_id FROM rfm_base WHERE recency_days IS NOT NULL AND frequency IS NOT NULL AND monetary IS NOT NULL",
)
def q_flt_dropna(spark, sf):
    rfm = wh(spark, sf).rfm_base()
    return rfm.na.drop(subset=["recency_days", "frequency", "monetary"]).select(PERSON)


@register(
    "delivery_quantiles",
    " UNION ALL ".join(
        f"SELECT CAST({q} AS DOUBLE) AS q, ROUND(quantile_cont(delivery_days, {q}), 12) AS value FROM fct_orders"
        " WHERE delivery_days IS NOT NULL AND delivery_days >= 0"
        for q in (0.5, 0.9)
    ),
)
def q_delivery_quantiles(spark, sf):
    return eda.delivery_quantiles(_fct(spark, sf))


@register(
    "delivery_histogram",
    """SELECT b.bin, r.lo + b.bin * ((r.hi - r.lo) / 60) AS bin_left,
       CASE WHEN b.bin = 59 THEN r.hi ELSE r.lo + (b.bin + 1) * ((r.hi - r.lo) / 60) END AS bin_right,
       COALESCE(c.n, 0) AS n
    FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(60)) b
    CROSS JOIN (SELECT MIN(x) AS lo, MAX(x) AS hi FROM (SELECT CAST(LEAST(delivery_days, 60) AS DOUBLE) AS x FROM fct_orders WHERE delivery_days IS NOT NULL AND delivery_days >= 0)) r
    LEFT JOIN (
      SELECT CAST(CASE WHEN r2.hi = r2.lo THEN 0 ELSE LEAST(FLOOR((x - r2.lo) / ((r2.hi - r2.lo) / 60)), 59) END AS INTEGER) AS bin, COUNT(*) AS n
      FROM (SELECT CAST(LEAST(delivery_days, 60) AS DOUBLE) AS x FROM fct_orders WHERE delivery_days IS NOT NULL AND delivery_days >= 0) v,
           (SELECT MIN(x) AS lo, MAX(x) AS hi FROM (SELECT CAST(LEAST(delivery_days, 60) AS DOUBLE) AS x FROM fct_orders WHERE delivery_days IS NOT NULL AND delivery_days >= 0)) r2
      GROUP BY 1) c ON c.bin = b.bin""",
)
def q_delivery_histogram(spark, sf):
    return eda.delivery_histogram(_fct(spark, sf))


_PREVIEW_SQL = ", ".join(
    f"CAST(SUM({c}) AS DOUBLE) / COUNT({c}) AS {c}" for c in eda.PREVIEW_COLUMNS
)


@register(
    "repeat_feature_means",
    f"""WITH_M AS (SELECT 1) SELECT feature, ROUND(one_time, 12) AS one_time, ROUND("repeat", 12) AS "repeat",
       ROUND("repeat" - one_time, 12) AS repeat_minus_onetime FROM (
      SELECT feature, MAX(CASE WHEN NOT is_repeat_buyer THEN m END) AS one_time, MAX(CASE WHEN is_repeat_buyer THEN m END) AS "repeat"
      FROM (UNPIVOT (SELECT d.is_repeat_buyer, {_PREVIEW_SQL}
                     FROM feat_raw f JOIN dim_customers d ON d.customer_unique_id = f.customer_unique_id
                     GROUP BY d.is_repeat_buyer)
            ON {', '.join(eda.PREVIEW_COLUMNS)} INTO NAME feature VALUE m)
      GROUP BY feature)""".replace("WITH_M AS (SELECT 1) ", ""),
)
def q_repeat_feature_means(spark, sf):
    w = wh(spark, sf)
    return eda.repeat_feature_means(features.first_order_features(w.fct_orders), w.dim_customers)


@register(
    "join_first_repeat",
    "SELECT f.customer_unique_id, f.first_order_id, d.is_repeat_buyer FROM feat_first f"
    " JOIN dim_customers d ON d.customer_unique_id = f.customer_unique_id",
)
def q_join_first_repeat(spark, sf):
    w = wh(spark, sf)
    first = features.first_order_features(w.fct_orders, carried=()).select(PERSON, "first_order_id")
    return first.join(w.dim_customers.select(PERSON, "is_repeat_buyer"), PERSON)


def _describe_sql(cols) -> str:
    parts = []
    wide, fine = eda.MEAN_DIGITS
    for c in cols:
        mean = f"FAVG(CAST({c} AS DOUBLE))"
        parts.append(
            f"SELECT '{c}' AS column, COUNT({c}) AS count,"
            f" CASE WHEN ABS({mean}) >= 1 THEN ROUND({mean}, {wide}) ELSE ROUND({mean}, {fine}) END AS mean,"
            f" ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 4) AS std, MIN(CAST({c} AS DOUBLE)) AS min,"
            f" ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.25), 12) AS p25,"
            f" ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 12) AS p50,"
            f" ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.75), 12) AS p75, MAX(CAST({c} AS DOUBLE)) AS max"
            " FROM rfm_base WHERE recency_days IS NOT NULL AND frequency IS NOT NULL AND monetary IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


@register("rfm_describe", _describe_sql(["recency_days", "frequency", "monetary"]))
def q_rfm_describe(spark, sf):
    return eda.rfm_describe(wh(spark, sf).rfm_base())


# Months between the first and the last order of the test tables, for the SQL only: the query reads them from its orders.
COHORT_OFFSETS = range(80)


@register(
    "cohort_pivot",
    "SELECT cohort_month, "
    + ", ".join(f'MAX(CASE WHEN months_since_first = {i} THEN retention_rate END) AS "{i}"' for i in COHORT_OFFSETS)
    + " FROM customer_cohorts GROUP BY cohort_month",
)
def q_cohort_pivot(spark, sf):
    w = wh(spark, sf)
    return eda.cohort_pivot(w.customer_cohorts(), eda.month_offsets(marts.valid_orders(w.fct_orders)))


# ----------------------------------------------------------------- serving (§2.5, §2.9)


@register(
    "kpi_summary",
    "SELECT CAST(SUM(orders) AS DOUBLE) AS total_orders, CAST(SUM(customers) AS DOUBLE) AS total_customers,"
    " ROUND(SUM(gross_revenue), 2) AS total_gross_revenue,"
    " ROUND(SUM(gross_revenue), 2) / GREATEST(CAST(SUM(orders) AS DOUBLE), 1.0) AS avg_order_value,"
    " CAST(COUNT(*) AS DOUBLE) AS months_covered FROM monthly_revenue",
)
def q_kpi_summary(spark, sf):
    return serving.kpi_summary(wh(spark, sf).monthly_revenue())


@register(
    "category_top",
    "SELECT category, CAST(SUM(orders) AS BIGINT) AS orders, ROUND(SUM(items_revenue), 2) AS items_revenue,"
    " ROUND(SUM(freight_revenue), 2) AS freight_revenue, MAX(unique_products_sold) AS unique_products_sold"
    " FROM category_performance GROUP BY category ORDER BY items_revenue DESC, category LIMIT 20",
)
def q_category_top(spark, sf):
    return serving.category_top(wh(spark, sf).category_performance())


@register("score_contract", serving.contract_sql("feat_first"))
def q_score_contract(spark, sf):
    return serving.score_contract(_features(spark, sf)).select(PERSON, "reasons", "accepted")


# ----------------------------------------------------------------- data quality (§2.12)


def _dq_tables(spark, sf) -> dict:
    """The checked tables as functions: a run builds those that its checks touch."""
    w = wh(spark, sf)
    s = w.stg

    @cache
    def from_fact():
        """Marts over the order fact, which is stored once with the columns they read."""
        fact = w.fct_orders.select(
            "order_id", "customer_unique_id", "customer_state", "status", "purchased_at", "purchased_date", "purchased_month",
            "items_total", "items_subtotal", "freight_total",
        )
        return Warehouse(w.raw, spark).with_fact(materialize(fact))

    return {
        "stg_customers": lambda: s.customers,
        "stg_orders": lambda: s.orders,
        "stg_order_items": lambda: s.order_items,
        "stg_order_payments": lambda: s.order_payments,
        "stg_order_reviews": lambda: s.order_reviews,
        "stg_products": lambda: s.products,
        "stg_sellers": lambda: s.sellers,
        "stg_geolocation": lambda: s.geolocation,
        "stg_translation": lambda: s.translation,
        "dim_customers": lambda: w.dim_customers,
        "dim_products": lambda: w.dim_products,
        "fct_orders": lambda: from_fact().fct_orders,
        "monthly_revenue": lambda: from_fact().monthly_revenue(),
        "customer_rfm": lambda: from_fact().customer_rfm(),
        "customer_cohorts": lambda: from_fact().customer_cohorts(),
        "revenue_by_state": lambda: from_fact().revenue_by_state(),
        "category_performance": lambda: from_fact().category_performance(),
    }


# Tables that are more than a scan and are read by several checks.
DQ_STORED = {
    "stg_geolocation", "dim_customers", "monthly_revenue", "customer_rfm", "customer_cohorts", "revenue_by_state", "category_performance",
}


def _dq(kind: str | None):
    checks = [c for c in quality.CHECKS if kind is None or c.test == kind]

    def run(spark, sf):
        return quality.run_checks(_dq_tables(spark, sf), checks, stored=DQ_STORED)

    return run, quality.results_sql(checks)


for _name, _kind in [
    ("dq_not_null", "not_null"),
    ("dq_unique", "unique"),
    ("dq_unique_combo", "unique_combination"),
    ("dq_relationships", "relationships"),
    ("dq_accepted_values", "accepted_values"),
    ("dq_severity", None),
]:
    _fn, _sql = _dq(_kind)
    register(_name, _sql)(_fn)


@register(
    "join_anti_fk",
    "SELECT i.order_id, i.order_item_id FROM stg_order_items i WHERE NOT EXISTS"
    " (SELECT 1 FROM stg_orders o WHERE o.order_id = i.order_id)",
)
def q_join_anti_fk(spark, sf):
    s = wh(spark, sf).stg
    return s.order_items.select("order_id", "order_item_id").join(s.orders.select("order_id"), "order_id", "left_anti")
