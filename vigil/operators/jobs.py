"""Job, run-registry and decision tables.

Jobs are kept as an append-only event table (partial updates: only the
given fields change); the current state of a job is, per field, the value of
its latest event that set the field.  Decisions (expiry, gate, champion vs
challenger) are ``when`` chains over aggregated rows.  Run tables carry
``MapType`` params / metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config as C
from vigil.operators.rolling import stage_changes, stage_of_step, with_detection

JOB_FIELDS = ["start_time", "status", "champion_f1", "challenger_f1", "decision", "shap_path",
              "psi_score", "ks_stat", "ks_p", "adwin_change"]


def job_current(events: DataFrame, job_key: str = "job_id", order_cols=("event_time", "event_seq"),
                fields: list[str] | None = None) -> DataFrame:
    """Current job rows: per job and field, the latest non-NULL value."""
    fields = [f for f in (fields or JOB_FIELDS) if f in events.columns]
    order = [F.col(c) for c in order_cols]
    aggs = [F.max(F.when(F.col(f).isNotNull(), F.struct(*order, F.col(f).alias("v"))))["v"].alias(f)
            for f in fields]
    return events.groupBy(job_key).agg(*aggs)


def job_expire(jobs: DataFrame, now: Column, timeout_seconds: int = C.JOB_TIMEOUT_SECONDS) -> DataFrame:
    """Unfinished jobs that started more than ``timeout`` before ``now`` become FAILED /
    ORPHANED_TIMEOUT."""
    unfinished = F.coalesce(~F.col("status").isin(C.FINISHED_JOB_STATES), F.lit(False))  # a NULL status is no job
    stale = F.col("start_time") < (now - F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS"))
    hit = unfinished & F.coalesce(stale, F.lit(False))
    # one select: both new values read the *old* status
    return jobs.withColumns({"status": F.when(hit, F.lit("FAILED")).otherwise(F.col("status")),
                             "decision": F.when(hit, F.lit("ORPHANED_TIMEOUT")).otherwise(F.col("decision"))})


def job_gate(jobs: DataFrame, now: Column, psi: Column, change: Column, keys=None,
             cooldown_seconds: int = C.JOB_COOLDOWN_SECONDS,
             timeout_seconds: int = C.JOB_TIMEOUT_SECONDS) -> DataFrame:
    """Expire first, then: an active job -> SKIP_ACTIVE; last start < cooldown ago ->
    COOLDOWN; else OPEN a PENDING job carrying the PSI and the change flag."""
    keys = list(keys or [])
    exp = job_expire(jobs, now, timeout_seconds)
    active = F.coalesce(~F.col("status").isin(C.FINISHED_JOB_STATES), F.lit(False))
    agg = exp.groupBy(*keys).agg(F.count_if(active).alias("active_jobs"),
                                 F.max("start_time").alias("last_start"))
    since = F.unix_timestamp(now) - F.unix_timestamp(F.col("last_start"))
    decision = (F.when(F.col("active_jobs") > 0, F.lit("SKIP_ACTIVE"))
                .when(F.col("last_start").isNotNull() & (since < cooldown_seconds), F.lit("COOLDOWN"))
                .otherwise(F.lit("OPEN")))
    return agg.select(*keys, "active_jobs", "last_start", decision.alias("decision"),
                      F.when(decision == "OPEN", F.lit("PENDING")).alias("new_status"),
                      F.when(decision == "OPEN", psi).alias("psi_score"),
                      F.when(decision == "OPEN", change.cast("int")).alias("adwin_change"))


def ready_to_retrain(df: DataFrame, keys=None, min_rows: int = C.MIN_RETRAIN_ROWS) -> DataFrame:
    """< ``min_rows`` rows -> REJECTED ('Insufficient drifted data'), else READY."""
    keys = list(keys or [])
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    few = F.col("n_rows") < min_rows
    return out.withColumn("status", F.when(few, F.lit("REJECTED")).otherwise(F.lit("READY"))) \
              .withColumn("decision", F.when(few, F.lit("Insufficient drifted data")))


def champion_challenger(champ_auc: Column, chall_auc: Column, strong_auc: Column | None = None,
                        force: bool = False) -> Column:
    """Decision by AUC (F1 is only recorded); forced rotation is off by default."""
    d = F.when(chall_auc > champ_auc, F.lit("CHALLENGER_WINS"))
    if strong_auc is not None:
        d = d.when(strong_auc > champ_auc, F.lit("CHALLENGER_WINS_AFTER_RETRAIN"))
    return d.otherwise(F.lit("CHALLENGER_FORCED_ROTATE" if force else "CHAMPION_HELD"))


def top_runs(runs: DataFrame, n: int = 20, prefix: str | None = None, status: str | None = None) -> DataFrame:
    """Newest ``n`` runs (optionally of experiments with a name prefix / one status)."""
    r = runs
    if prefix is not None:
        r = r.where(F.col("experiment").startswith(prefix))
    if status is not None:
        r = r.where(F.col("status") == status)
    return r.orderBy(F.col("start_time").desc(), F.col("run_id").desc()).limit(n)


def active_model(runs: DataFrame, prefix: str, fallback: str = "fallback") -> DataFrame:
    """Newest FINISHED run of prefixed experiments, else one fallback row."""
    newest = top_runs(runs, 1, prefix=prefix, status="FINISHED").select(
        "run_id", "experiment", "start_time", F.col("params")["model_type"].alias("model_type"),
        F.col("params")["decision_threshold"].alias("decision_threshold"), F.col("params")["adapter"].alias("adapter"),
        F.col("params")["schema_version"].alias("schema_version"))
    stub = runs.sparkSession.range(1).select(
        F.lit(fallback).alias("run_id"), F.lit(None).cast("string").alias("experiment"),
        F.lit(None).cast("timestamp").alias("start_time"), F.lit("linear_score").alias("model_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("decision_threshold", "adapter", "schema_version")])
    both = newest.withColumn("_rank", F.lit(0)).unionByName(stub.withColumn("_rank", F.lit(1)))
    return both.orderBy("_rank").limit(1).drop("_rank")


def model_info(active: DataFrame, canonical: list[str], predictive: list[str]) -> DataFrame:
    return active.select(
        F.col("run_id").alias("model_run_id"), F.coalesce(F.col("experiment"), F.lit("none")).alias("dataset_name"),
        F.coalesce("adapter", F.lit("none")).alias("adapter_class"), F.coalesce("schema_version", F.lit("none")).alias("feature_schema_version"),
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss").alias("training_timestamp"),
        F.lit(len(canonical)).alias("canonical_features_count"),
        F.lit(len(predictive)).alias("predictive_features_count"),
        F.lit(len(canonical) + len(predictive)).alias("model_features_count"))


def run_flatten(runs: DataFrame, metric_prefix: str = "baseline_") -> DataFrame:
    """Run table for display: short id, time text, params with "N/A" defaults, prefixed metrics."""
    m = F.col("metrics")
    prefixed = F.map_filter(m, lambda k, v: k.startswith(metric_prefix))
    return runs.select(
        F.substring("run_id", 1, 8).alias("short_id"), "run_id",
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_text"), "status",
        F.coalesce(F.col("params")["model_type"], F.lit("N/A")).alias("model_type"),
        F.coalesce(F.col("params")["decision_threshold"], F.lit("N/A")).alias("threshold"),
        F.coalesce(m["f1_score"], F.lit(None).cast("double")).alias("f1_score"),
        F.size(prefixed).alias("baseline_metric_count"))


def live_status(frame: DataFrame, keys=None, step: str = "step") -> DataFrame:
    """Latest step's state per key: stage and labels from the measured PSI and the model in use."""
    keys = list(keys or [])
    marked = with_detection(frame.select(*keys, step, "psi", "f1", "model"), step, "psi", keys)
    last = marked.groupBy(*keys).agg(F.max_by(F.struct(F.col(step).alias("s"), "psi", "f1", "model", "detected"),
                                              F.col(step)).alias("x"))
    model, replaced = F.col("x.model"), F.col("x.model") != "champion"
    return last.select(
        *keys, F.col("x.s").alias("step"), F.col("x.psi").alias("psi"), F.col("x.f1").alias("f1"),
        model.alias("active_model"), stage_of_step(F.col("x.s"), F.col("x.psi"), F.col("x.detected")).alias("stage"),
        F.col("x.detected").alias("detected_step"),
        F.when(F.col("x.detected").isNotNull(), F.lit("Detected")).otherwise(F.lit("Monitoring")).alias("detection_status"),
        F.when(replaced, F.lit("Deployed")).otherwise(F.lit("Champion Active")).alias("deployment_status"),
        F.when(F.col("x.psi") >= 0.2, F.lit("CRITICAL")).otherwise(F.lit("STABLE")).alias("drift_status"))


def event_trace(frame: DataFrame, keys=None, step: str = "step", time_col: str = "event_time",
                component: str = "monitor") -> DataFrame:
    """Trace lines at each change of the measured stage: 'HH:mm:ss | component | stage | step=n | reason'."""
    keys = list(keys or [])
    staged = with_detection(frame.select(*keys, step, time_col, "psi"), step, "psi", keys).select(*keys, step, time_col, stage_of_step(step).alias("stage"))
    changes = stage_changes(staged, "stage", step=step, keys=keys)
    reasons = F.create_map(*[F.lit(x) for pair in C.STAGES.items() for x in pair])
    line = F.concat_ws(" | ", F.date_format(time_col, "HH:mm:ss"), F.lit(component), F.col("stage"),
                       F.concat(F.lit("step="), F.col(step).cast("string")), F.try_element_at(reasons, F.col("stage")))
    return changes.select(*keys, F.col(step).alias("seq"), "stage", line.alias("line"))
