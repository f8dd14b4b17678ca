"""Repeat-purchase propensity with Spark ML: preprocessing, models, scoring, importance.

Pipeline: NULL category -> explicit level; exact median imputation; standard
scaling with the population deviation; one-hot state (unknown level -> all
zeros); assembled vector; logistic regression or gradient-boosted trees, both
with 'balanced' class weights. The two custom estimators are thin Spark ML
stages whose statistics are computed by DataFrame aggregations.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsight.operators import metrics
from shopsight.operators.eda import exact_quantiles
from shopsight.operators.rank import DEFAULT_ROWS_PER_BUCKET, global_row_number
from shopsight.session import ensure_checkpoint_dir, materialize

MISSING_LEVEL = "__missing__"
MODEL_TYPES = ("logreg", "boost")
#: Ranges that a 64-bit hash is told apart by (its leading 16 bits).
HASH_LEVELS = 1 << 16


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """'balanced' class weights n / (2 * n_class): class counts plus a one-row total."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()  # scalar subquery, computed once
    return per.select(label, "n", (total / (2.0 * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (two classes: a broadcast of two rows)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight))
    return df.join(F.broadcast(w), label)


class _FillParams(Params):
    fill = Param(Params._dummy(), "fill", "per-column fill values", typeConverter=TypeConverters.toListFloat)
    center = Param(Params._dummy(), "center", "per-column centers", typeConverter=TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "per-column scales", typeConverter=TypeConverters.toListFloat)


class MedianImputerModel(Model, HasInputCols, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, fill=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        fills = self.getOrDefault(self.fill)
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in zip(cols, fills)})


class MedianImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """impute_median: exact medians of all input columns in one grouped quantile pass."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        cols = self.getInputCols()
        long = df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("x")) for c in cols])).alias(
                "kv"
            )
        ).select("kv.col", "kv.x")
        med = {r["col"]: r["value"] for r in exact_quantiles(long, "x", [0.5], by=["col"]).collect()}  # one row per column
        return MedianImputerModel(inputCols=cols, fill=[float(med.get(c) or 0.0) for c in cols])


class PopulationScalerModel(Model, HasInputCols, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, center=None, scale=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        mus, sds = self.getOrDefault(self.center), self.getOrDefault(self.scale)
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, mus, sds)})


class PopulationScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """scale_standard: (x - mean) / population std (a zero std leaves the column unscaled)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        mus = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        sds = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(cols))]
        return PopulationScalerModel(inputCols=cols, center=mus, scale=sds)


def build_pipeline(
    model_type: str,
    numeric: list[str],
    categorical: list[str],
    n_train: int | None = None,
    label: str = "label",
    weight: str = "weight",
    boost_iter: int = 400,
    seed: int = 42,
) -> Pipeline:
    """build_pipeline: preprocessing + classifier; unknown model type -> ValueError."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"Unknown model_type: {model_type!r}")
    levels = [f"{c}__level" for c in categorical]
    fill_sql = ", ".join(f"COALESCE({c}, '{MISSING_LEVEL}') AS {lv}" for c, lv in zip(categorical, levels))
    stages = [SQLTransformer(statement=f"SELECT *, {fill_sql} FROM __THIS__")] if categorical else []
    stages += [MedianImputer(inputCols=numeric), PopulationScaler(inputCols=numeric)]
    vecs = []
    for lv in levels:
        stages.append(StringIndexer(inputCol=lv, outputCol=f"{lv}_idx", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{lv}_idx"], outputCols=[f"{lv}_vec"], dropLast=True))
        vecs.append(f"{lv}_vec")
    stages.append(VectorAssembler(inputCols=numeric + vecs, outputCol="features"))
    if model_type == "logreg":
        reg = 1.0 / n_train if n_train else 0.0
        clf = LogisticRegression(
            featuresCol="features", labelCol=label, weightCol=weight, maxIter=1000, regParam=reg,
            elasticNetParam=0.0, standardization=False,
        )
    else:
        clf = GBTClassifier(
            featuresCol="features", labelCol=label, weightCol=weight, maxIter=boost_iter, stepSize=0.05,
            maxDepth=5, maxBins=255, checkpointInterval=10, seed=seed,
        )
    return Pipeline(stages=stages + [clf])


def fit_model(train: DataFrame, model_type: str, numeric, categorical, label: str = "label", **opts) -> PipelineModel:
    """fit_logreg / fit_boost: balanced weights, materialised training frame, fitted pipeline."""
    ensure_checkpoint_dir(train.sparkSession)
    weighted = materialize(with_class_weights(train, label))
    n = weighted.count()
    return build_pipeline(model_type, list(numeric), list(categorical), n_train=n, label=label, **opts).fit(weighted)


def score(model: PipelineModel, df: DataFrame, id_col: str) -> DataFrame:
    """score_batch: propensity of the positive class and its fixed-width decile."""
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(df).select(id_col, p.alias("propensity")).withColumn(
        "decile", metrics.score_decile(F.col("propensity"))
    )


def perm_importance(
    model: PipelineModel,
    test: DataFrame,
    features: list[str],
    id_col: str,
    label: str = "label",
    n_repeats: int = 10,
    seed: int = 42,
    **rank_opts,
) -> DataFrame:
    """Mean and (population) std drop of average precision when one feature is shuffled.

    All (feature, repeat) copies are scored in one pass. A copy pairs the row at
    id-rank i with the value held by the row at rank i of a seeded hash order.
    Only the donated value travels for each copy: it is ranked within its copy's
    range of hashes (hashes are spread evenly, so equal ranges have equal shares of
    the rows) and meets the whole row by its id-rank.
    """
    spark = test.sparkSession
    base = materialize(test.select(id_col, label, *features))
    n = base.count()
    types = dict(test.dtypes)
    num_feats = [c for c in features if types[c] != "string"]
    per_task = rank_opts.get("rows_per_bucket", DEFAULT_ROWS_PER_BUCKET)
    parts = min(HASH_LEVELS, max(1, math.ceil(n / per_task)))

    def given(i: int, c: str, rep: int):
        num, text = (F.col(c).cast("double"), F.lit(None).cast("string")) if c in num_feats else (F.lit(None).cast("double"), F.col(c))
        return F.struct(F.lit(i).alias("f"), F.lit(rep).alias("rep"), num.alias("_dnum"), text.alias("_dstr"))

    copies = F.array(*[given(i, c, rep) for i, c in enumerate(features) for rep in range(n_repeats)])
    donors = base.select(id_col, F.explode(copies).alias("_c")).select(id_col, "_c.*")
    donors = donors.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed), F.col("f"), F.col("rep")))
    level = F.call_function("shiftright", F.col("_h"), F.lit(48)) + HASH_LEVELS // 2
    donors = donors.withColumn("_part", F.floor(level * parts / HASH_LEVELS).cast("int"))
    copy = ["f", "rep"]
    sizes = donors.groupBy(*copy, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*copy).orderBy("_part")) - F.col("_size")
    starts = sizes.select(*copy, "_part", before.alias("_start"))  # a row per copy and range
    place = F.row_number().over(Window.partitionBy(*copy, "_part").orderBy("_h", id_col))
    ranked = donors.withColumn("_place", place).join(F.broadcast(starts), [*copy, "_part"])
    ranked = ranked.select(*copy, (F.col("_start") + F.col("_place")).alias("_rid"), "_dnum", "_dstr")
    by_id = global_row_number(base, [(id_col, "asc", "first")], "_rid", stats=base, n_rows=n, **rank_opts)
    permuted = ranked.join(by_id, "_rid")
    for i, c in enumerate(features):
        donor = F.col("_dnum") if c in num_feats else F.col("_dstr")
        permuted = permuted.withColumn(c, F.when(F.col("f") == i, donor.cast(types[c])).otherwise(F.col(c)))
    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(permuted).select(*copy, F.col(label).alias("label"), p.alias("score"))
    base_scores = materialize(model.transform(base).select(F.col(label).alias("label"), p.alias("score")))
    baseline = metrics.auc_metrics(base_scores, **rank_opts).first()["pr_auc"]
    # a shuffled feature moves scores, not their range: the unshuffled scores part the copies
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(base_scores.approxQuantile("score", shares, 0.01))) if shares else []
    ap = grouped_average_precision(scored, copy, cuts)
    drops = ap.withColumn("drop", F.lit(baseline) - F.col("ap"))
    names = spark.createDataFrame(list(enumerate(features)), "f int, feature string")
    return (
        drops.groupBy("f")
        .agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
        .join(F.broadcast(names), "f")
        .select("feature", F.round("importance_mean", 12).alias("importance_mean"), F.round("importance_std", 12).alias("importance_std"))
        .orderBy(F.col("importance_mean").desc(), "feature")
    )


def grouped_average_precision(scored: DataFrame, by: list[str], cuts: Sequence[float] = ()) -> DataFrame:
    """Average precision per group, from running sums along (group, score desc).

    ``cuts`` part each group's scores into ranges that are summed side by side;
    any cuts give the same result.
    """
    part = reduce(lambda n, cut: n + (F.col("score") <= cut).cast("int"), cuts, F.lit(0))  # 0 holds the highest scores
    rows = scored.withColumn("_part", part).repartition(*by, "_part")
    grouped = materialize(
        rows.groupBy(*by, "_part", "score").agg(
            F.sum("label").cast("long").alias("pos"), (F.count(F.lit(1)) - F.sum("label")).cast("long").alias("neg")
        )
    )
    sums = grouped.groupBy(*by, "_part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    group = Window.partitionBy(*by)
    starts = sums.select(
        *by,
        "_part",
        (F.sum("p").over(group.orderBy("_part")) - F.col("p")).alias("_p0"),
        (F.sum("n").over(group.orderBy("_part")) - F.col("n")).alias("_n0"),
        F.sum("p").over(group).alias("_P"),
    )
    down = Window.partitionBy(*by, "_part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = grouped.withColumns({"_cp": F.sum("pos").over(down), "_cn": F.sum("neg").over(down)}).join(F.broadcast(starts), [*by, "_part"])
    cp, cn = F.col("_p0") + F.col("_cp"), F.col("_n0") + F.col("_cn")
    term = (F.col("pos") / F.col("_P")) * (cp / (cp + cn))
    return run.groupBy(*by).agg(F.round(F.sum(F.when(F.col("pos") > 0, term)), 12).alias("ap"))


def save_model(model: PipelineModel, path: str) -> None:
    """sink_model: Spark ML persistence (overwrite)."""
    model.write().overwrite().save(path)


def metadata_frame(spark, meta: dict) -> DataFrame:
    """One-row frame holding the run metadata as JSON (written next to the models)."""
    return spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string")


def default_model(meta_df: DataFrame) -> str:
    """model_default: the model name recorded in the metadata (logreg if absent)."""
    meta = json.loads(meta_df.first()["meta"])
    return meta.get("default_model", "logreg")


def model_metrics_view(meta_df: DataFrame) -> DataFrame:
    """Flatten stored metrics into (model, metric, value) rows, with the default model, the horizon, the ends of training and evaluation and both sizes.

    What the metadata lacks is NULL; a metric without a value stays as a NULL.
    """
    meta = json.loads(meta_df.first()["meta"])
    spark = meta_df.sparkSession
    rows = [(m, k, None if v is None else float(v)) for m, d in meta.get("metrics_test", {}).items() for k, v in d.items()]
    df = spark.createDataFrame(rows, "model string, metric string, value double")
    return df.withColumns(
        {
            "default_model": F.lit(meta.get("default_model", "logreg")),
            "horizon_days": F.lit(int(meta.get("horizon_days", 0))),
            "train_end": F.lit(meta.get("train_end")).cast("string"),
            "eval_end": F.lit(meta.get("eval_end")).cast("string"),
            "train_size": F.lit(meta.get("train_size")).cast("long"),
            "test_size": F.lit(meta.get("test_size")).cast("long"),
        }
    )
