import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import jobs as J
from vigil.operators import loop as O
from vigil.operators import models as ML
from vigil.session import scratch_path
from vigil.sources import registry as R

SMALL = {"max_iter": 3, "max_depth": 2}


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.RandomState(4)

    def frame(n, shift, flip):
        rows = []
        for i in range(n):
            a, b = rng.normal(shift), rng.normal()
            rows.append((i, float(a), float(b), float((b if flip else a - shift) > 0), ("train", "train", "val")[i % 3]))
        return spark.createDataFrame(rows, "id long, price double, session_duration double, label double, part string")

    base, calm, moved = frame(400, 0.0, False), frame(400, 0.0, False), frame(400, 5.0, True)
    path = ML.save_model(ML.train_gbt(base, ["price", "session_duration"], **SMALL), scratch_path(spark, "champion"))
    return base.cache(), calm.cache(), moved.cache(), path


def run(spark, world, current, folder, now="2025-01-01 00:00:00"):
    base, _, _, path = world
    if R.active_run(spark, f"{folder}/registry") is None:
        R.register_run(spark, f"{folder}/registry", "champion", "fraud", "FINISHED", {"path": path})
    return O.closed_loop(base, current, ["price", "session_duration"], f"{folder}/registry", f"{folder}/jobs", f"{folder}/models", now,
                         monitored=["price", "session_duration"], challenger=SMALL, strong=SMALL).first()


def test_drift_opens_a_job_and_switches_the_model(spark, world):
    folder = scratch_path(spark, "loop")
    r = run(spark, world, world[2], folder)
    assert r.alert and r.gate == "OPEN" and r.decision == "CHALLENGER_WINS" and r.job_status == "COMPLETED"
    assert r.challenger_auc > r.champion_auc and r.active_before == "champion" and r.active_after.startswith("challenger-")
    table = {x.run_id: x for x in R.run_table(spark, f"{folder}/registry").collect()}
    assert table[r.active_after].is_active and not table["champion"].is_active and table[r.active_after].metrics["roc_auc"] == pytest.approx(r.challenger_auc)
    job = J.job_current(O.job_events(spark, f"{folder}/jobs")).first()
    assert (job.status, job.decision, job.psi_score) == ("COMPLETED", "CHALLENGER_WINS", pytest.approx(r.psi))
    ML.load_model(table[r.active_after].params["path"])
    again = run(spark, world, world[2], folder, now="2025-01-01 00:00:10")  # too soon after the last start
    assert again.gate == again.decision == "COOLDOWN" and again.active_after == r.active_after
    later = run(spark, world, world[2], folder, now="2025-01-01 01:00:00")  # now the challenger is the one to beat
    assert later.active_before == r.active_after and later.gate == "OPEN"


def test_without_drift_nothing_happens(spark, world):
    folder = scratch_path(spark, "loop")
    r = run(spark, world, world[1], folder)
    assert not r.alert and r.decision == "NO_DRIFT" and r.job_id is None and r.active_after == "champion"
    assert O.job_events(spark, f"{folder}/jobs").count() == 0


def test_few_rows_are_rejected_and_a_running_job_blocks(spark, world):
    folder = scratch_path(spark, "loop")
    r = run(spark, world, world[2].limit(40), folder)
    assert (r.decision, r.job_status) == ("REJECTED", "REJECTED")
    O.CommitLog(spark, f"{folder}/jobs").update(lambda e: {"job_id": "other", "status": "STARTED", "start_time": "2025-01-01 00:02:00", "event_time": "2025-01-01 00:02:00"})
    assert run(spark, world, world[2], folder, now="2025-01-01 00:03:00").decision == "SKIP_ACTIVE"


def test_a_loop_that_finds_another_model_active_does_not_switch(spark, world, monkeypatch):
    folder = scratch_path(spark, "loop")
    save = ML.save_model

    def meanwhile(model, path):
        R.register_run(spark, f"{folder}/registry", "rival", "fraud", "FINISHED", {"path": path})
        assert R.switch_active(spark, f"{folder}/registry", "rival", None)
        return save(model, path)

    monkeypatch.setattr(ML, "save_model", meanwhile)
    r = run(spark, world, world[2], folder)
    assert r.decision == "SUPERSEDED" and R.active_run(spark, f"{folder}/registry")["run_id"] == "rival"


def test_attribution_is_one_keyed_auc(spark, world):
    base, _, moved, path = world
    a = ML.load_model(path)
    out = {r.feature: r for r in ML.attribution_shift(spark, a, a, moved.select("id", "price", "session_duration", "label"), ["price", "session_duration"], ["id"]).collect()}
    assert set(out) == {"price", "session_duration"}
    mixed = ML.permuted(base.select("id", "price", "label"), ["price"], ["id"])
    assert sorted(r["_p_price"] for r in mixed.collect()) == sorted(r.price for r in base.collect())
    assert out["price"].champion_auc_drop == out["price"].challenger_auc_drop
