"""Registered queries: models on Spark ML and the closed loop.
All rows-only (trained models are not SQL-expressible).

Data: the transaction table; baseline period = champion data, current
period = drifted data.  Rows are split 70/15/15 by a stable hash.  The
encoded, split frame is written once, and trained models are saved once; both are
runs of a registry (``sources.registry``) under the shared checkpoint folder, where the
other queries of the application find them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import config as C
from vigil.operators import drift as D
from vigil.operators import metrics as M
from vigil.operators import models as ML
from vigil.operators.sampling import hash_split
from vigil.plans.q_features import CANONICAL, PREDICTIVE
from vigil.plans.registry import query
from vigil.functions.features import cohort_rewrite, hash_share, rule_label
from vigil.operators.loop import closed_loop
from vigil.session import cut_lineage, ensure_checkpoint_dir, scratch_path
from vigil.sources.registry import register_run, run_table
from vigil.sources.tables import transactions

FEATURES = CANONICAL + PREDICTIVE
SCHEMA_VERSION = "1"
KEYS = ["order_key", "line_number"]


def registry_of(spark, sf) -> str:
    """The registry folder of this application and these tables."""
    name = hashlib.md5(f"{spark.sparkContext.applicationId}:{sf}".encode()).hexdigest()[:12]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-{name}"


def registered(spark, sf, role: str, make) -> str:
    """Path of a finished run ``role``; ``make(path)`` writes it if there is none yet."""
    folder = registry_of(spark, sf)
    run = {r["run_id"]: r for r in run_table(spark, folder).collect()}.get(role)  # a handful of roles
    if run is None or run["status"] != "FINISHED":
        path = scratch_path(spark, f"run-{role}")
        metrics = make(path)
        register_run(spark, folder, role, "fraud", "FINISHED", {
            "path": path, "model_type": "gbt", "canonical_features": ",".join(CANONICAL), "predictive_features": ",".join(PREDICTIVE),
            "adapter": "transactions", "schema_version": SCHEMA_VERSION}, metrics)
        return path
    return run["params"]["path"]


def frames(spark, sf):
    def make(path):
        t = transactions(spark, sf)
        mf = ML.model_frame(t, CANONICAL, PREDICTIVE, keep=[*KEYS, "is_current"])
        hash_split(mf, KEYS, {"train": 0.70, "val": 0.15, "test": 0.15}, seed=42).write.mode("overwrite").parquet(path)

    return spark.read.parquet(registered(spark, sf, "frames", make))


def _params(p: dict) -> dict:
    return dict(max_iter=p["max_iter"], max_depth=p["max_depth"], step_size=p["step_size"],
                pos_weight=p["pos_weight"], seed=p["seed"])


def trained(spark, sf, role: str):
    """Train once per application and register; later calls load what the registry names."""
    def make(path):
        data = frames(spark, sf)
        if role == "champion":
            train, params = data.where(~F.col("is_current") & (F.col("part") == "train")), C.CHAMPION_PARAMS
        else:
            train, params = data.where(F.col("is_current") & (F.col("part") == "train")), C.CHALLENGER_PARAMS
        ML.save_model(ML.train_gbt(train, FEATURES, **_params(params)), path)

    return ML.load_model(registered(spark, sf, role, make))


@query("train_champion")
def q_train_champion(spark, sf):
    """Boosted trees (100 x depth 5, rate 0.1, positives weighted 15) on the baseline period;
    threshold tuned on the validation part; metrics on the test part."""
    data = frames(spark, sf).where(~F.col("is_current"))
    model = trained(spark, sf, "champion")
    val = ML.score_batch(model, data.where(F.col("part") == "val"))
    th = M.best_threshold_grid(val, "p", "label").select("threshold").first()[0]
    test = ML.score_batch(model, data.where(F.col("part") == "test"))
    return ML.evaluate_model(test, th).withColumn("decision_threshold", F.lit(th)) \
             .withColumn("n_trees", F.lit(len(model.stages[-1].trees)))


@query("train_challenger")
def q_train_challenger(spark, sf):
    """Challenger (100 x depth 4) on the drifted period vs the champion, by AUC on drifted validation rows."""
    data = frames(spark, sf).where(F.col("is_current"))
    val = data.where(F.col("part") == "val")
    champ = ML.evaluate_model(ML.score_batch(trained(spark, sf, "champion"), val))
    chall = ML.evaluate_model(ML.score_batch(trained(spark, sf, "challenger"), val))
    return champ.select(F.lit("champion").alias("model"), "f1", "roc_auc", "pr_auc").unionByName(
        chall.select(F.lit("challenger").alias("model"), "f1", "roc_auc", "pr_auc"))


@query("score_batch")
def q_score_batch(spark, sf):
    """P(fraud) for every transaction from the champion model."""
    data = frames(spark, sf)
    return ML.score_batch(trained(spark, sf, "champion"), data).select(*KEYS, "label", "p")


@query("evaluate_model")
def q_evaluate_model(spark, sf):
    """All metrics at threshold 0.5, per period (baseline / current)."""
    data = frames(spark, sf)
    scored = ML.score_batch(trained(spark, sf, "champion"), data.where(F.col("part") == "test"))
    return ML.evaluate_model(scored, 0.5, keys=["is_current"])


@query("top_importance")
def q_top_importance(spark, sf):
    """Top 10 gain importances of the champion."""
    return ML.top_importance(spark, trained(spark, sf, "champion"), FEATURES, k=10)


@query("attribution_shift")
def q_attribution_shift(spark, sf):
    """Champion vs challenger attributions on the drifted test rows: gains and permutation AUC drops."""
    data = frames(spark, sf).where(F.col("is_current") & (F.col("part") == "test"))
    return ML.attribution_shift(spark, trained(spark, sf, "champion"), trained(spark, sf, "challenger"),
                                data, FEATURES, KEYS)


@query("save_load_model")
def q_save_load_model(spark, sf):
    """Persist the champion with its feature lists and medians; reload; predictions must agree."""
    model = trained(spark, sf, "champion")
    path = ML.save_model(model, scratch_path(spark, "saved-model"))
    folder = scratch_path(spark, "saved-registry")
    register_run(spark, folder, "saved", "fraud", "FINISHED", {"path": path, "model_type": "gbt", "canonical_features": ",".join(CANONICAL),
                                                               "predictive_features": ",".join(PREDICTIVE), "schema_version": SCHEMA_VERSION})
    again = ML.load_model(run_table(spark, folder).where("is_active").first()["params"]["path"])
    data = frames(spark, sf).where(F.col("part") == "test")
    a = ML.score_batch(model, data).select(*KEYS, "label", F.col("p").alias("p1"))
    b = ML.score_batch(again, data).select(*KEYS, "label", F.col("p").alias("p2"))
    # keys may repeat: compare the multiset of predictions per key through sums
    sa = a.groupBy(*KEYS).agg(F.sum("p1").alias("s1"))
    sb = b.groupBy(*KEYS).agg(F.sum("p2").alias("s2"))
    meds = D.quantiles(D.to_long(data, PREDICTIVE), "value", [0.5], keys=["feature"], out_col="m")
    diff = sa.join(sb, KEYS).agg(F.count_if(F.abs(F.col("s1") - F.col("s2")) > 1e-12).alias("mismatches"),
                                 F.count(F.lit(1)).alias("rows_"))
    meta = spark.createDataFrame([(path, ",".join(CANONICAL), ",".join(PREDICTIVE))],
                                 T.StructType([T.StructField("path", T.StringType()),
                                               T.StructField("canonical", T.StringType()),
                                               T.StructField("predictive", T.StringType())]))
    return meta.withColumns({"mismatches": diff.select("mismatches").scalar(),
                             "rows_": diff.select("rows_").scalar(),
                             "medians": meds.select(F.map_from_entries(F.collect_list(
                                 F.struct("feature", F.col("m")[0])))).scalar()})


def drifted(spark, sf):
    """The current period as a what-if replay: 60 % of the rows become cheap-risk, high-discount mobile ones at three times
    the price, and labels follow the shifted rule."""
    t = transactions(spark, sf).where(F.col("is_current"))
    moved = cohort_rewrite(t, [(hash_share("order_key", 7, 0.6), {"device_type": F.lit("mobile"), "merchant_risk_score": F.lit(0.05), "discount_pct": F.lit(0.45),
                                                                  "price": F.col("price") * 3.0})])
    moved = moved.withColumn("is_fraud", rule_label(concept_shift=True))
    return hash_split(ML.model_frame(moved, CANONICAL, PREDICTIVE, keep=[*KEYS, "is_current"]), KEYS, {"train": 0.70, "val": 0.15, "test": 0.15}, seed=42)


@query("closed_loop")
def q_closed_loop(spark, sf):
    """encode -> monitor (PSI) -> gate -> retrain -> compare -> register -> switch, on a period that has drifted;
    the decision row beside the run that is active afterwards in the run table."""
    trained(spark, sf, "champion")
    folder = scratch_path(spark, "loop")
    own = {r["run_id"]: r for r in run_table(spark, registry_of(spark, sf)).collect()}["champion"]
    register_run(spark, f"{folder}/registry", "champion", "fraud", "FINISHED", own["params"])
    base = frames(spark, sf).where(~F.col("is_current"))
    row = closed_loop(base, cut_lineage(drifted(spark, sf), "loop-current"), FEATURES, f"{folder}/registry", f"{folder}/jobs", f"{folder}/models",
                      now="1999-01-01 00:00:00", monitored=C.MONITORED_FEATURES, challenger=_params(C.CHALLENGER_PARAMS), strong=_params(C.STRONG_CHALLENGER_PARAMS))
    active = run_table(spark, f"{folder}/registry").where("is_active").select(F.col("run_id").alias("active_run"), F.col("params")["decision_threshold"].alias("active_threshold"))
    return row.withColumns({c: active.select(c).scalar() for c in active.columns})
