"""Registry entries for segmentation and propensity modelling (Spark ML).

Fitted parameters of Spark ML differ from other libraries' bit for bit, so most
of these have a rows-only check; the preprocessing statistics have an oracle.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.operators import features, metrics, propensity, segment, serving
from shopsight.plans.analysis import HORIZON, TRAIN_END
from shopsight.plans.registry import register, wh
from shopsight.session import ensure_checkpoint_dir, materialize
from shopsight.sources import io

PERSON = "customer_unique_id"
LABEL = f"repeat_within_{HORIZON}d"
NUMERIC = features.FEATURE_COLUMNS_NUMERIC
CATEGORICAL = features.FEATURE_COLUMNS_CATEGORICAL
# Fixed parameters of the reference workflow.
SWEEP_KS = range(2, 9)
SWEEP_RESTARTS = 10
FINAL_K = 4
FINAL_RESTARTS = 20
SILHOUETTE_SAMPLE = 10_000
SCATTER_SAMPLE = 5_000
PERM_REPEATS = 10


def _rfm(spark, sf) -> DataFrame:
    return wh(spark, sf).rfm_base()


def _clusters(spark, sf, scored: bool = False) -> tuple[DataFrame, DataFrame]:
    rfm = materialize(wh(spark, sf).customer_rfm() if scored else _rfm(spark, sf))
    return materialize(segment.kmeans_fit(rfm, FINAL_K, FINAL_RESTARTS)), rfm


def clusters(spark, sf) -> DataFrame:
    """The customer_clusters mart: person, cluster and the fit's own cluster number."""
    return _clusters(spark, sf)[0].select(PERSON, "cluster", "kmeans_cluster")


def _split(spark, sf) -> tuple[DataFrame, DataFrame]:
    fr = features.propensity_frame(wh(spark, sf).fct_orders, HORIZON, TRAIN_END).withColumn("label", F.col(LABEL))
    fr = materialize(fr)
    return fr.filter(F.col("split") == "train"), fr.filter(F.col("split") == "test")


def _kept_split(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The stored train and test rows, the same for all models and their metadata."""
    splits = spark.sparkContext.__dict__.setdefault("_shopsight_splits", {})
    if sf not in splits:
        splits[sf] = _split(spark, sf)
    return splits[sf]


def _model(spark, sf, kind: str):
    """The fitted model and the test rows, kept with the Spark application that fitted them."""
    models = spark.sparkContext.__dict__.setdefault("_shopsight_models", {})
    if (sf, kind) not in models:
        train, test = _kept_split(spark, sf)
        models[sf, kind] = (propensity.fit_model(train, kind, NUMERIC, CATEGORICAL), test)
    return models[sf, kind]


# ----------------------------------------------------------------- segmentation (§2.9, §2.7, §2.4)


@register(
    "rfm_log_scale",
    """SELECT customer_unique_id,
       ROUND((r - AVG(r) OVER ()) / COALESCE(NULLIF(STDDEV_POP(r) OVER (), 0), 1), 9) AS x_recency,
       ROUND((f - AVG(f) OVER ()) / COALESCE(NULLIF(STDDEV_POP(f) OVER (), 0), 1), 9) AS x_log_frequency,
       ROUND((m - AVG(m) OVER ()) / COALESCE(NULLIF(STDDEV_POP(m) OVER (), 0), 1), 9) AS x_log_monetary
    FROM (SELECT customer_unique_id, CAST(recency_days AS DOUBLE) AS r, LN(1 + frequency) AS f, LN(1 + monetary) AS m
          FROM customer_rfm WHERE recency_days IS NOT NULL AND frequency IS NOT NULL AND monetary IS NOT NULL)""",
)
def q_rfm_log_scale(spark, sf):
    return segment.rfm_log_scale(_rfm(spark, sf))


@register("kmeans_sweep")
def q_kmeans_sweep(spark, sf):
    return segment.kmeans_sweep(materialize(_rfm(spark, sf)), SWEEP_KS, SWEEP_RESTARTS, SILHOUETTE_SAMPLE)


@register("kmeans_fit")
def q_kmeans_fit(spark, sf):
    return _clusters(spark, sf)[0]


@register("sink_clusters")
def q_sink_clusters(spark, sf):
    """The customer_clusters mart, written and read back."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/serving/{uuid.uuid4().hex}"
    io.write_table(clusters(spark, sf), f"{folder}/customer_clusters")
    return io.read_mart(spark, "customer_clusters", folder)


@register("cluster_rank")
def q_cluster_rank(spark, sf):
    clusters, _ = _clusters(spark, sf)
    return clusters.select("kmeans_cluster", "cluster").distinct()


@register("cluster_profile")
def q_cluster_profile(spark, sf):
    clusters, rfm = _clusters(spark, sf)
    return segment.cluster_profile(clusters, rfm)


@register("cluster_profile_api")
def q_cluster_profile_api(spark, sf):
    clusters, rfm = _clusters(spark, sf)
    return serving.cluster_profile_api(clusters, rfm)


@register("join_clusters_rfm")
def q_join_clusters_rfm(spark, sf):
    clusters, rfm = _clusters(spark, sf)
    return clusters.join(rfm.select(PERSON, "recency_days", "frequency", "monetary"), PERSON, "left")


@register("cluster_crosstab")
def q_cluster_crosstab(spark, sf):
    clusters, rfm = _clusters(spark, sf, scored=True)
    return segment.cluster_crosstab(clusters, rfm)


@register("silhouette_sample")
def q_silhouette_sample(spark, sf):
    rfm = materialize(_rfm(spark, sf))
    vectors = materialize(segment._vectors(segment.rfm_log_scale(rfm)))
    model, _ = segment.fit_kmeans(vectors, FINAL_K, 1)
    ids = segment.sample_fixed(vectors.select(PERSON), SILHOUETTE_SAMPLE)
    pts = model.transform(vectors.join(ids, PERSON)).select(*segment.SCALED, "prediction")
    return spark.createDataFrame([(FINAL_K, segment.silhouette(pts))], "k int, silhouette double")


@register("sample_fixed")
def q_sample_fixed(spark, sf):
    return segment.sample_fixed(wh(spark, sf).customer_rfm(), SCATTER_SAMPLE)


# ----------------------------------------------------------------- propensity (§2.9)


_MEDIAN_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS col, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 12) AS value FROM feat_split WHERE split = 'train'"
    for c in NUMERIC
)


@register("impute_median", _MEDIAN_SQL)
def q_impute_median(spark, sf):
    train, _ = _split(spark, sf)
    model = propensity.MedianImputer(inputCols=NUMERIC).fit(train)
    fills = model.getOrDefault(model.fill)
    return spark.createDataFrame([(c, float(v)) for c, v in zip(NUMERIC, fills)], "col string, value double")


@register("scale_standard")
def q_scale_standard(spark, sf):
    train, _ = _split(spark, sf)
    imputed = propensity.MedianImputer(inputCols=NUMERIC).fit(train).transform(train)
    model = propensity.PopulationScaler(inputCols=NUMERIC).fit(imputed)
    rows = list(zip(NUMERIC, model.getOrDefault(model.center), model.getOrDefault(model.scale)))
    return spark.createDataFrame(rows, "col string, mean double, std double")


@register("onehot_ignore")
def q_onehot_ignore(spark, sf):
    model, test = _model(spark, sf, "logreg")
    return model.transform(test).select(PERSON, "customer_state", F.col("customer_state__level_vec").cast("string").alias("state_vec"))


@register("fit_logreg")
def q_fit_logreg(spark, sf):
    model, test = _model(spark, sf, "logreg")
    return metrics.evaluate(propensity.score(model, test, PERSON).join(test.select(PERSON, "label"), PERSON).withColumnRenamed("propensity", "score"), PERSON)


@register("fit_boost")
def q_fit_boost(spark, sf):
    model, test = _model(spark, sf, "boost")
    return metrics.evaluate(propensity.score(model, test, PERSON).join(test.select(PERSON, "label"), PERSON).withColumnRenamed("propensity", "score"), PERSON)


@register("build_pipeline")
def q_build_pipeline(spark, sf):
    model, _ = _model(spark, sf, "logreg")
    return spark.createDataFrame([(i, type(s).__name__) for i, s in enumerate(model.stages)], "stage int, kind string")


@register("score_batch")
def q_score_batch(spark, sf):
    model, test = _model(spark, sf, "logreg")
    return propensity.score(model, test, PERSON)


@register("evaluate_table")
def q_evaluate_table(spark, sf):
    results = {}
    for kind in propensity.MODEL_TYPES:
        model, test = _model(spark, sf, kind)
        scored = propensity.score(model, test, PERSON).join(test.select(PERSON, "label"), PERSON)
        results[kind] = metrics.evaluate(scored.withColumnRenamed("propensity", "score"), PERSON)
    return metrics.evaluate_table(results)


@register("perm_importance")
def q_perm_importance(spark, sf):
    model, test = _model(spark, sf, "boost")
    return propensity.perm_importance(model, test, NUMERIC + CATEGORICAL, PERSON, "label", PERM_REPEATS)


def _eval_end(spark, sf) -> str | None:
    """The last observable date, as text."""
    last = features.last_observable_date(wh(spark, sf).fct_orders, HORIZON)
    return spark.range(1).select(last.cast("string")).first()[0]


def _meta(spark, sf) -> DataFrame:
    train, test = _kept_split(spark, sf)
    m = {}
    for kind in propensity.MODEL_TYPES:
        model, tst = _model(spark, sf, kind)
        scored = propensity.score(model, tst, PERSON).join(tst.select(PERSON, "label"), PERSON)
        m[kind] = metrics.evaluate(scored.withColumnRenamed("propensity", "score"), PERSON).first().asDict()
    meta = {
        "horizon_days": HORIZON,
        "target_column": LABEL,
        "numeric_features": NUMERIC,
        "categorical_features": CATEGORICAL,
        "train_end": TRAIN_END,
        "eval_end": _eval_end(spark, sf),
        "train_size": train.count(),
        "test_size": test.count(),
        "metrics_test": m,
        "default_model": max(m, key=lambda k: m[k]["pr_auc"] or 0.0),
    }
    return propensity.metadata_frame(spark, meta)


@register("model_metrics_view")
def q_model_metrics_view(spark, sf):
    return propensity.model_metrics_view(_meta(spark, sf))


@register("model_default")
def q_model_default(spark, sf):
    return spark.createDataFrame([(propensity.default_model(_meta(spark, sf)),)], "default_model string")


@register("sink_model")
def q_sink_model(spark, sf):
    folder = os.path.join(ensure_checkpoint_dir(spark), "models")
    for kind in propensity.MODEL_TYPES:
        propensity.save_model(_model(spark, sf, kind)[0], os.path.join(folder, f"repeat_purchase_{kind}"))
    meta = _meta(spark, sf)
    meta.write.mode("overwrite").json(os.path.join(folder, "repeat_purchase.meta"))
    return spark.read.json(os.path.join(folder, "repeat_purchase.meta"))
