"""Models: boosted-tree champion / challenger, batch scoring,
evaluation, attribution shift, persistence.

Boosted trees are grown over histograms (``vigil.operators.boosting``; xgboost
is not part of the stack) by the rules of ``GBTClassifier``: class weighting,
``subsample`` -> ``subsampling_rate``, column sampling -> ``feature_subset``.  They
are stages of a Spark ML ``PipelineModel``, with its persistence.  Evaluation reuses
the aggregation metrics of ``vigil.operators.metrics`` (PR-AUC starting at
precision 1, not Spark ML's ``areaUnderPR``).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.features import encoded_column
from vigil.operators import boosting
from vigil.operators import metrics as M
from vigil.session import cut_lineage


def model_frame(df: DataFrame, canonical: list[str], predictive: list[str], label: str | None = "is_fraud",
                keep: list[str] | None = None) -> DataFrame:
    """Canonical features encoded + predictive raw (double), label as double."""
    cols = [F.col(k) for k in (keep or [])]
    cols += [encoded_column(df, f).cast("double").alias(f) for f in canonical]
    cols += [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in predictive]
    if label:
        cols.append(F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("label"))
    return df.select(*cols)


def train_gbt(df: DataFrame, features: list[str], max_iter: int = 100, max_depth: int = 5,
              step_size: float = 0.1, pos_weight: float = 1.0, seed: int = 42,
              subsampling_rate: float = 1.0, feature_subset: str = "all") -> PipelineModel:
    """Boosted trees (``operators.boosting``) on all rows; positives weighted ``pos_weight``."""
    return PipelineModel([boosting.fit(df, features, max_iter, max_depth, step_size, pos_weight, seed, subsampling_rate, feature_subset)])


def score_batch(model: PipelineModel, df: DataFrame, out_col: str = "p") -> DataFrame:
    """P(class 1) for every row (columns of ``df`` kept)."""
    return model.transform(df).withColumnRenamed("probability", out_col)


def evaluate_model(scored: DataFrame, threshold: float = 0.5, score: str = "p", label: str = "label",
                   keys=None) -> DataFrame:
    """Confusion, accuracy, precision, recall, F1 at the threshold, plus ROC-AUC and PR-AUC."""
    keys = list(keys or [])
    scored = cut_lineage(scored.select(*keys, score, label), "scored")  # the model runs once, not for every metric
    cm = M.class_metrics(scored, score, label, threshold, keys)
    auc = M.roc_auc(scored, score, label, keys).select(*keys, "roc_auc")
    pr = M.pr_auc(scored, score, label, keys)
    if keys:
        return cm.join(auc, keys, "left").join(pr, keys, "left")
    return cm.withColumn("roc_auc", auc.select("roc_auc").scalar()).withColumn("pr_auc", pr.select("pr_auc").scalar())


def importances(spark: SparkSession, model: PipelineModel, features: list[str], name: str = "importance") -> DataFrame:
    """Gain importances of the boosted trees as rows (bounded by the feature count)."""
    vec = model.stages[-1].featureImportances.toArray().tolist()
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField(name, T.DoubleType())])
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, vec)], schema)


def top_importance(spark: SparkSession, model: PipelineModel, features: list[str], k: int = 15) -> DataFrame:
    return importances(spark, model, features).orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


def permuted(df: DataFrame, features: list[str], key_cols: list[str], seed: int = 7) -> DataFrame:
    """The frame with ``_p_<feature>``: the features of another row, each row's taken once, deterministically.

    Rows are ranked twice — by key and by a seeded hash — and each row meets the row with the same rank in the
    other order (one join on ranks computed by the distributed ``dense_sequence``, for all features).
    """
    from vigil.operators.sequence import dense_sequence
    h = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))
    # keys may repeat: all other columns break the ties
    rest = sorted(c for c, kind in df.dtypes if c not in key_cols and not kind.startswith(("struct", "map", "array")) and kind != "vector")
    a = dense_sequence(df, [*key_cols, *rest], name="_ra")
    b = dense_sequence(df.select(*key_cols, *rest).withColumn("_h", h), ["_h", *key_cols, *rest], name="_rb") \
        .select(F.col("_rb").alias("_ra"), *[F.col(f).alias(f"_p_{f}") for f in features])
    return a.join(b, "_ra").drop("_ra")


def attribution_shift(spark: SparkSession, champion: PipelineModel, challenger: PipelineModel, df: DataFrame,
                      features: list[str], key_cols: list[str]) -> DataFrame:
    """How attributions move champion -> challenger: gain importances side by side, and
    permutation importance (AUC drop when a feature is permuted), for every feature.

    One long frame (feature permuted, model, p, label), written once, and one keyed AUC over it."""
    gains = importances(spark, champion, features, "champion_gain").join(
        importances(spark, challenger, features, "challenger_gain"), "feature")
    mixed = cut_lineage(permuted(df.select(*key_cols, *features, "label"), features, key_cols), "permuted")
    scored = None
    for name, model in (("champion", champion), ("challenger", challenger)):
        for f in [None, *features]:
            one = mixed.select(*[F.col(f"_p_{c}").alias(c) if c == f else F.col(c) for c in features], "label")
            part = score_batch(model, one).select(F.lit(f or "").alias("feature"), F.lit(name).alias("model"), "p", "label")
            scored = part if scored is None else scored.unionByName(part)
    auc = cut_lineage(M.roc_auc(cut_lineage(scored, "permuted-scores"), "p", "label", ["feature", "model"]).select("feature", "model", "roc_auc"), "permuted-auc")
    base = auc.where("feature = ''").select(F.col("model").alias("_m"), F.col("roc_auc").alias("_base"))
    drops = auc.where("feature <> ''").join(base, F.col("model") == F.col("_m")).groupBy("feature").agg(
        *[F.max(F.when(F.col("model") == m, F.coalesce("_base", F.lit(0.0)) - F.coalesce("roc_auc", F.lit(0.0)))).alias(f"{m}_auc_drop") for m in ("champion", "challenger")])
    return gains.join(drops, "feature", "left")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
