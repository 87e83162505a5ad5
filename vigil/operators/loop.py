"""The closed loop: monitor -> gate -> retrain -> compare -> switch, over tables.

Everything that lasts is a commit: job events in one log, runs and the active model in the registry.
A loop that dies leaves a job that expires and the old model active; of two loops that promote
at once, the one that finds the active model it compared with still active wins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import config as C
from vigil.operators import drift as D
from vigil.operators import jobs as J
from vigil.operators import metrics as M
from vigil.operators import models as ML
from vigil.session import cut_lineage
from vigil.sources import registry as R
from vigil.sources.commits import CommitLog

JOB_EVENT = "job_id string, status string, decision string, start_time timestamp, psi_score double, champion_f1 double, challenger_f1 double, event_time timestamp, event_seq long"


def job_events(spark: SparkSession, jobs: str) -> DataFrame:
    rows = [(e["job_id"], e.get("status"), e.get("decision"), e.get("start_time"), e.get("psi_score"), e.get("champion_f1"), e.get("challenger_f1"), e["event_time"], i)
            for i, e in enumerate(CommitLog(spark, jobs).entries())]
    texts = JOB_EVENT.replace("timestamp", "string")
    return spark.createDataFrame(rows, texts).withColumns({c: F.col(c).cast("timestamp") for c in ("start_time", "event_time")})


def open_job(spark: SparkSession, jobs: str, now: str, psi: float) -> tuple[str, str | None]:
    """(decision of the gate, id of the job that it opened).  Asked again if another loop opens one meanwhile."""
    log = CommitLog(spark, jobs)
    result: dict = {}

    def decide(entries: list[dict]) -> dict | None:
        current = J.job_current(job_events(spark, jobs))
        row = J.job_gate(current, F.lit(now).cast("timestamp"), F.lit(psi), F.lit(False)).first()
        result.update(decision=row["decision"], job_id=None)
        if row["decision"] != "OPEN":
            return None
        result["job_id"] = f"job_{len(entries)}"
        return {"job_id": result["job_id"], "status": "PENDING", "start_time": now, "event_time": now, "psi_score": psi}

    log.update(decide)
    return result["decision"], result["job_id"]


def _better(scores: dict[str, dict], a: str, b: str) -> bool:
    return (scores[b]["roc_auc"] or 0.0) > (scores[a]["roc_auc"] or 0.0)


def closed_loop(baseline: DataFrame, current: DataFrame, features: list[str], registry: str, jobs: str, models: str, now: str,
                split: str = "part", monitored: list[str] | None = None, experiment: str = "fraud",
                challenger: dict | None = None, strong: dict | None = None, extra_params: dict | None = None) -> DataFrame:
    """One row: psi, alert, gate, job and its status, AUC and F1 of the models compared, decision, active model
    before and after.

    ``baseline`` and ``current`` are model frames (features, ``label``) with a ``split`` column; the challenger is
    trained on the ``train`` rows of ``current`` and compared with the active model on its ``val`` rows; the
    stronger one is trained on all rows but those.  Nothing is trained without an alert and an open gate."""
    spark = current.sparkSession
    active = R.active_run(spark, registry)
    rep = D.psi_report(baseline, current, monitored).first()
    out = {"psi": rep["psi"] if rep else 0.0, "alert": bool(rep and rep["alert"]), "gate": None, "job_id": None, "job_status": None,
           "champion_auc": None, "champion_f1": None, "challenger_auc": None, "challenger_f1": None, "strong_auc": None,
           "decision": "NO_DRIFT", "active_before": active["run_id"], "active_after": active["run_id"]}

    def done() -> DataFrame:
        kinds = {"psi": "double", "alert": "boolean", **{c: "double" for c in out if c.endswith(("_auc", "_f1"))}}
        return spark.createDataFrame([tuple(out.values())], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in out))

    if not out["alert"]:
        return done()
    out["gate"], out["job_id"] = open_job(spark, jobs, now, out["psi"])
    out["decision"] = out["gate"]
    if out["job_id"] is None:
        return done()
    log = CommitLog(spark, jobs)

    def event(**fields) -> None:
        log.update(lambda entries: {"job_id": out["job_id"], "event_time": now, **fields})
        out["job_status"] = fields["status"]

    ready = J.ready_to_retrain(current).first()
    if ready["status"] == "REJECTED":
        event(status="REJECTED", decision=ready["decision"])
        out["decision"] = "REJECTED"
        return done()
    val = cut_lineage(current.where(F.col(split) == "val"), "loop-val")
    event(status="EVALUATING")

    def judged(model) -> dict:
        scored = cut_lineage(ML.score_batch(model, val).select("p", "label"), "loop-scored")
        return ML.evaluate_model(scored).select("roc_auc", "f1").first().asDict()

    scores = {"champion": judged(ML.load_model(active["params"]["path"]))}
    event(status="TRAINING_CHALLENGER", champion_f1=scores["champion"]["f1"])
    model = ML.train_gbt(current.where(F.col(split) == "train"), features, **(challenger or C.CHALLENGER_PARAMS))
    scores["challenger"], winner = judged(model), "challenger"
    if not _better(scores, "champion", "challenger"):  # one stronger retrain on all rows that it is not judged on
        model, winner = ML.train_gbt(current.where(F.col(split) != "val"), features, **(strong or C.STRONG_CHALLENGER_PARAMS)), "strong"
        scores["strong"] = judged(model)
        out["strong_auc"] = scores["strong"]["roc_auc"]
    event(status="COMPARING", challenger_f1=scores[winner]["f1"])
    out.update(champion_auc=scores["champion"]["roc_auc"], champion_f1=scores["champion"]["f1"],
               challenger_auc=scores["challenger"]["roc_auc"], challenger_f1=scores["challenger"]["f1"])
    lits = [F.lit(out[c]).cast("double") for c in ("champion_auc", "challenger_auc", "strong_auc")]
    out["decision"] = spark.range(1).select(J.champion_challenger(*lits).alias("d")).first()["d"]
    if out["decision"] != "CHAMPION_HELD":
        run = f"{winner}-{uuid.uuid4().hex[:8]}"
        path = ML.save_model(model, f"{models.rstrip('/')}/{run}")
        scored = ML.score_batch(model, val)
        threshold = M.best_threshold_grid(scored, "p", "label").select("threshold").first()["threshold"]
        R.register_run(spark, registry, run, experiment, "FINISHED",
                       {"path": path, "model_type": "gbt", "decision_threshold": threshold, **(extra_params or {})}, scores[winner])
        if R.switch_active(spark, registry, run, replaces=active["run_id"] if active.get("switched") else None):
            out["active_after"] = run
        else:
            out["decision"] = "SUPERSEDED"
    event(status="COMPLETED", decision=out["decision"])
    return done()
