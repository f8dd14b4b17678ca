"""Ranking and calibration metrics over any ``(id, label, score)`` frame.

All metrics are DataFrame plans. Threshold metrics (average precision, ROC AUC,
the PR curve) first collapse rows to distinct scores (hash aggregate, map-side
combine), then take running sums along the score order with the distributed
``prefix_sums`` (range buckets, no single-partition window). Top-fraction
metrics select the key at the cut, with the id as tie-break.
Sums of float terms are rounded to 12 decimals so results do not depend on the
order in which partitions are added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.operators.rank import in_top, keys_at, prefix_sums, sort_key
from shopsight.session import materialize

DIGITS = 12
METRIC_NAMES = (
    "n_samples",
    "n_positives",
    "base_rate",
    "roc_auc",
    "pr_auc",
    "brier",
    "recall_top_10pct",
    "recall_top_20pct",
    "lift_top_10pct",
)


def _r(c: Column) -> Column:
    return F.round(c, DIGITS)


def counts(df: DataFrame, label: str = "label") -> DataFrame:
    """m_counts: n_samples, n_positives, base_rate (one row)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.col(label)).cast("long").alias("n_positives"),
        F.try_divide(F.sum(F.col(label)).cast("double"), F.count(F.lit(1)).cast("double")).alias("base_rate"),
    )


def brier(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """m_brier: mean squared difference of probability and label (one row)."""
    return df.agg(_r(F.avg(F.pow(F.col(score) - F.col(label), 2))).alias("brier"))


def score_table(df: DataFrame, label: str = "label", score: str = "score", **rank_opts) -> DataFrame:
    """Per distinct score (descending): positives, negatives and running totals.

    Adds cum_pos/cum_neg (rows with score >= this one) and tot_pos/tot_neg.
    """
    grouped = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label)).cast("long").alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col(label))).cast("long").alias("neg"),
    )
    # read by the count, the cut-point sample, the bucket totals and the ranked pass
    grouped = materialize(grouped)
    return prefix_sums(grouped, [("score", "desc", "last")], {"pos": F.col("pos"), "neg": F.col("neg")}, **rank_opts)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", **rank_opts) -> DataFrame:
    """Precision and recall at every distinct score threshold, plus the base rate."""
    t = score_table(df, label, score, **rank_opts)
    return t.select(
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("tot_pos").cast("double")).alias("recall"),
        (F.col("tot_pos") / (F.col("tot_pos") + F.col("tot_neg"))).alias("base_rate"),
    )


def auc_metrics(df: DataFrame, label: str = "label", score: str = "score", **rank_opts) -> DataFrame:
    """m_pr_auc (average precision, step-wise) and m_roc_auc (ties count one half); one row."""
    t = score_table(df, label, score, **rank_opts)
    ap_term = (F.col("pos") / F.col("tot_pos")) * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    # negatives ranked strictly below this score = all negatives - those at or above it
    roc_term = F.col("pos") * (F.col("tot_neg") - F.col("cum_neg") + 0.5 * F.col("neg"))
    return t.agg(
        _r(F.sum(F.when(F.col("pos") > 0, ap_term))).alias("pr_auc"),
        _r(
            F.try_divide(
                F.sum(roc_term),
                (F.first("tot_pos") * F.first("tot_neg")).cast("double"),
            )
        ).alias("roc_auc"),
    )


def top_fraction(df: DataFrame, frac: float, id_col: str, score: str = "score", **rank_opts) -> DataFrame:
    """rank_top_frac: rows ranked in the top ceil(n * frac) (at least 1) by score, id as tie-break."""
    df = materialize(df)
    n = df.count()
    n_top = max(1, int(np.ceil(n * frac)))
    return df.filter(in_top(df, [(score, "desc", "last"), (id_col, "asc", "first")], n_top, n, **rank_opts))


def recall_lift(
    df: DataFrame, id_col: str, label: str = "label", score: str = "score", fracs=(0.10, 0.20), **rank_opts
) -> DataFrame:
    """m_recall_at_k / m_lift_at_k for several fractions in one pass (one row).

    recall = positives in the top / all positives (0 if none);
    lift = precision in the top / base rate (0 if the base rate is 0).
    """
    df = materialize(df)
    n = df.count()
    order = [(score, "desc", "last"), (id_col, "asc", "first")]
    tops = {frac: max(1, int(np.ceil(n * frac))) for frac in fracs}
    last = keys_at(df, order, [k - 1 for k in tops.values()], n, **rank_opts)
    key = sort_key(df, order)
    aggs = [F.sum(F.col(label)).alias("_p"), F.count(F.lit(1)).alias("_n")]
    for frac in fracs:
        k = tops[frac]
        tag = f"{int(round(frac * 100))}"
        within = key <= last[k - 1] if k - 1 in last else F.lit(True)
        aggs.append(F.sum(F.when(within, F.col(label)).otherwise(0)).alias(f"_hit{tag}"))
        aggs.append(F.lit(k).alias(f"_k{tag}"))
    agg = df.agg(*aggs)
    cols = []
    for frac in fracs:
        tag = f"{int(round(frac * 100))}"
        hit, k = F.col(f"_hit{tag}"), F.col(f"_k{tag}")
        base = F.col("_p") / F.col("_n")
        cols.append(F.when(F.col("_p") > 0, _r(hit / F.col("_p"))).otherwise(0.0).alias(f"recall_top_{tag}pct"))
        cols.append(F.when(base > 0, _r((hit / k) / base)).otherwise(0.0).alias(f"lift_top_{tag}pct"))
    return agg.select(*cols)


def evaluate(df: DataFrame, id_col: str, label: str = "label", score: str = "score", **rank_opts) -> DataFrame:
    """All nine metrics in one row (the reference's evaluate)."""
    df = materialize(df)
    parts = [
        counts(df, label),
        auc_metrics(df, label, score, **rank_opts),
        brier(df, label, score),
        recall_lift(df, id_col, label, score, **rank_opts),
    ]
    # one-row frames: the later three are scalar subqueries (structs) on the first
    row = parts[0]
    for p in parts[1:]:
        s = p.select(F.struct(*p.columns)).scalar()
        row = row.select("*", *[s.getField(c).alias(c) for c in p.columns])
    return row.select(*METRIC_NAMES)


def evaluate_table(results: dict[str, DataFrame]) -> DataFrame:
    """evaluate_table: metric x model, rounded to 4 decimals (half-even, as pandas)."""
    longs = []
    for model, row in results.items():
        stacked = row.select(
            F.lit(model).alias("model"),
            F.explode(
                F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRIC_NAMES])
            ).alias("kv"),
        ).select("model", "kv.metric", "kv.value")
        longs.append(stacked)
    out = longs[0]
    for other in longs[1:]:
        out = out.unionByName(other)
    return out.groupBy("metric").pivot("model", list(results)).agg(F.first(F.bround("value", 4)))


# uniform calibration bins: the 9 inner edges of linspace(0, 1, 11)
CALIBRATION_EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)[1:-1]]


def calibration_bin(score: str = "score") -> Column:
    """Bin index 0..9: number of inner edges strictly below the score."""
    s = F.col(score)
    out = F.lit(0)
    for e in CALIBRATION_EDGES:
        out = out + (s > F.lit(e)).cast("int")
    return out


def calibration_bins(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mean predicted vs. observed rate per equal-width bin; empty bins are absent."""
    return df.groupBy(calibration_bin(score).alias("bin")).agg(
        _r(F.avg(F.col(score))).alias("prob_pred"),
        _r(F.avg(F.col(label).cast("double"))).alias("prob_true"),
        F.count(F.lit(1)).alias("n"),
    )


def score_decile(p: Column) -> Column:
    """clip(int(p*10)+1, 1, 10): fixed-width score bins, not population deciles."""
    return F.least(F.greatest(F.floor(p * 10).cast("int") + 1, F.lit(1)), F.lit(10))
