"""The run registry: runs and the active model, as commits of one log (``sources.commits``).

A run is one entry, with its status, parameters and metrics; a switch of the active model is one entry
that names a run and the one it replaces.  A switch happens only if the model it replaces is
still the active one, so of two loops that promote a model at the same time one wins.  A run is
registered before it can be switched to, so a writer that dies in between leaves the old model
active.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vigil.sources.commits import CommitLog

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("experiment", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("start_time", T.TimestampType()), T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())), T.StructField("is_active", T.BooleanType())])


def register_run(spark: SparkSession, folder: str, run_id: str, experiment: str, status: str, params: dict, metrics: dict | None = None,
                 start_time: dt.datetime | None = None) -> None:
    """Adds a run, or its latest state if it is there already."""
    at = (start_time or dt.datetime.now(dt.timezone.utc)).isoformat()
    run = {"run_id": run_id, "experiment": experiment, "status": status, "start_time": at,
           "params": {k: str(v) for k, v in params.items()}, "metrics": {k: float(v) for k, v in (metrics or {}).items() if v is not None}}
    CommitLog(spark, folder).update(lambda entries: {"run": run})


def _state(entries: list[dict]) -> tuple[dict[str, dict], str | None]:
    runs, active = {}, None
    for e in entries:
        if "run" in e:
            runs[e["run"]["run_id"]] = {**e["run"], "start_time": runs.get(e["run"]["run_id"], e["run"])["start_time"]}
        else:
            active = e["active"]
    return runs, active


def active_run(spark: SparkSession, folder: str) -> dict | None:
    """The run that was switched to last (``switched``); where none was, the newest finished one."""
    runs, active = _state(CommitLog(spark, folder).entries())
    if active is not None:
        return {**runs[active], "switched": True}
    done = [r for r in runs.values() if r["status"] == "FINISHED"]
    return max(done, key=lambda r: (dt.datetime.fromisoformat(r["start_time"]), r["run_id"]), default=None)


def switch_active(spark: SparkSession, folder: str, run_id: str, replaces: str | None) -> bool:
    """Makes a finished run the active model if ``replaces`` (None: no switch so far) still is; False if not."""
    def decide(entries: list[dict]) -> dict | None:
        runs, active = _state(entries)
        if run_id not in runs or runs[run_id]["status"] != "FINISHED":
            raise ValueError(f"{run_id} is not a finished run")
        return {"active": run_id, "replaces": replaces} if active == replaces else None

    return CommitLog(spark, folder).update(decide) is not None


def run_table(spark: SparkSession, folder: str) -> DataFrame:
    """All runs (the shape that ``operators.jobs`` reads) and which one is active."""
    entries = CommitLog(spark, folder).entries()
    runs, _ = _state(entries)
    active = (active_run(spark, folder) or {}).get("run_id")
    rows = [(r["run_id"], r["experiment"], r["status"], dt.datetime.fromisoformat(r["start_time"]), r["params"], r["metrics"], r["run_id"] == active)
            for r in runs.values()]
    return spark.createDataFrame(rows, RUN_SCHEMA)
