"""The scored-stream monitoring pipeline shared by the rolling queries.

One DataFrame keyed by (scenario, seq) holds every scenario's series, so all
scenarios run in the same Spark jobs:

    stream_transactions -> score -> seq per scenario -> timeline (threshold, model)
      -> rolling confusion / metrics / PSI -> smoothing -> scenario statistics

Scenario = event type; the recurring scenario (second drift cycle) is
``RECURRING_SCENARIO``.  Timeline: champion threshold 0.5 from the start; at
the retrain step the threshold becomes the best grid threshold of the drifted
rows seen so far; at the deploy step the model label switches.  A change at
step s acts from s + 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.features import scorecard
from vigil.operators import metrics as M
from vigil.operators import rolling as R
from vigil.operators.sequence import attach, dense_sequence
from vigil.session import cut_lineage
from vigil.sources.tables import stream_transactions

RECURRING_SCENARIO = "signup"
FEATURES = C.MONITORED_FEATURES


def scored_stream(spark, sf) -> DataFrame:
    s = stream_transactions(spark, sf).withColumn("scenario", F.col("event_type")) \
        .withColumn("p", scorecard()).withColumnRenamed("is_fraud", "y")
    s = s.select("scenario", "step", "event_time", "p", "y", *FEATURES, "device_type", "is_current")
    # the scored log every monitoring statistic reads (several times per query):
    # written once, so the sequence numbering is not recomputed for each use
    return cut_lineage(dense_sequence(s, ["step"], keys=["scenario"], name="seq"), "scored-log")


def timeline_changes(scored: DataFrame) -> DataFrame:
    """(scenario, change_step, threshold, model) derived from the scored rows."""
    seq = F.col("seq")
    first = M.best_threshold_grid(scored.where((seq >= C.DRIFT_START) & (seq < C.RETRAIN_TRIGGER)),
                                  "p", "y", keys=["scenario"]).select("scenario", F.col("threshold").alias("t1"))
    second = M.best_threshold_grid(scored.where((seq >= C.SECOND_DRIFT_START) & (seq < C.SECOND_RETRAIN_TRIGGER)),
                                   "p", "y", keys=["scenario"]).select("scenario", F.col("threshold").alias("t2"))
    keys = scored.select("scenario").distinct()
    both = keys.join(first, "scenario", "left").join(second, "scenario", "left")
    rec = F.col("scenario") == F.lit(RECURRING_SCENARIO)
    def change(step: int, threshold, model: str):
        return F.struct(F.lit(step).alias("change_step"), threshold.cast("double").alias("threshold"),
                        F.lit(model).alias("model"))

    rows = F.array(
        change(-1, F.lit(0.5), "champion"),
        change(C.RETRAIN_TRIGGER, F.coalesce("t1", F.lit(0.5)), "champion"),
        change(C.MODEL_DEPLOYED, F.coalesce("t1", F.lit(0.5)), "challenger"),
        F.when(rec, change(C.SECOND_RETRAIN_TRIGGER, F.coalesce("t2", F.lit(0.5)), "challenger")),
        F.when(rec, change(C.SECOND_MODEL_DEPLOYED, F.coalesce("t2", F.lit(0.5)), "challenger_v2")),
    )
    return both.select("scenario", F.explode(F.array_compact(rows)).alias("c")).select(
        "scenario", F.col("c.change_step").alias("change_step"), F.col("c.threshold").alias("threshold"),
        F.col("c.model").alias("model"))


def with_timeline(scored: DataFrame) -> DataFrame:
    return R.model_timeline(scored, timeline_changes(scored), step="seq", keys=["scenario"])


def rolling_frame(spark, sf) -> DataFrame:
    """Per (scenario, seq): threshold, model, rolling confusion and metrics, rolling PSI."""
    scored = scored_stream(spark, sf)
    tl = with_timeline(scored)
    conf = R.rolling_confusion(tl, "p", "y", "threshold", step="seq", keys=["scenario"])
    met = R.rolling_metrics(conf)
    baseline = scored.where(~F.col("is_current"))
    return R.rolling_psi(met, baseline, FEATURES, step="seq", keys=["scenario"])


def scenario_stats(spark, sf) -> DataFrame:
    """One row per scenario with the 19 benchmark statistics (measured, not fixed)."""
    frame = rolling_frame(spark, sf)
    # four statistics read it: the windows behind it run once, not for each of them
    frame = cut_lineage(R.smooth(frame, "f1", step="seq", keys=["scenario"]), "scenario-frame")
    rec = F.col("scenario") == F.lit(RECURRING_SCENARIO)
    stats = R.recovery_stats(frame.withColumn("_rec", rec), "f1_smooth", step="seq", keys=["scenario"],
                             recurring=F.col("_rec"))
    # measured: where the monitored price changed, the first breach from there on, the steps at which the
    # threshold and the model in use changed, the models that were in use
    change = R.change_point(frame, "price", step="seq", keys=["scenario"]).select("scenario", F.col("change_step").alias("injected"))
    marked = attach(frame, change, ["scenario"], ["injected"], "left")
    det = marked.groupBy("scenario").agg(
        F.max("injected").alias("injected"),
        F.min(F.when((F.col("psi") > C.PSI_ALERT) & (F.col("seq") >= F.greatest("injected", F.lit(C.WINDOW_SIZE))), F.col("seq"))).alias("detection_step"),
        F.max("psi").alias("peak_psi"),
        F.min(F.when(F.col("threshold") != F.lit(0.5), F.col("seq"))).alias("retuned"),
        F.min(F.when(F.col("model") != "champion", F.col("seq"))).alias("deployed"),
        (F.count_distinct("model") - F.lit(1)).alias("cycles"))
    drifted = frame.where(F.col("seq") >= C.DRIFT_START)
    chall = M.best_f1_all_thresholds(drifted, "p", "y", keys=["scenario"]).select(
        "scenario", F.col("best_f1").alias("chall_f1"), F.col("roc_auc").alias("chall_auc"))
    out = stats.join(det, "scenario").join(chall, "scenario", "left")
    took = F.col("deployed") - F.col("retuned")
    return out.select(
        "scenario",
        F.col("injected").alias("drift_injection_time"),
        F.col("detection_step").alias("drift_detection_time"),
        (F.col("detection_step") - F.col("injected")).alias("detection_latency"),
        "peak_psi",
        F.col("cycles").alias("retraining_cycles"),
        took.alias("retraining_duration"),
        F.col("deployed").alias("model_deployment_time"),
        "chall_f1", "chall_auc", "f1_before_drift", "lowest_f1", "f1_after_recovery",
        "absolute_recovery", "relative_recovery",
        F.col("injected").alias("drift_step"),
        F.col("detection_step"),
        F.col("deployed").alias("deployment_step"),
        took.alias("retraining_time"))
