import datetime as dt

from pyspark.sql import functions as F

from vigil.operators import jobs as J


def test_job_current_partial_updates(spark):
    ev = spark.createDataFrame([
        ("j1", dt.datetime(2025, 1, 1, 0, 0, 0), 1, "PENDING", 0.3, None),
        ("j1", dt.datetime(2025, 1, 1, 0, 0, 5), 2, "STARTED", None, None),
        ("j1", dt.datetime(2025, 1, 1, 0, 0, 9), 3, None, None, "CHALLENGER_WINS"),
    ], "job_id string, event_time timestamp, event_seq int, status string, psi_score double, decision string")
    r = J.job_current(ev).first()
    assert (r.status, r.psi_score, r.decision) == ("STARTED", 0.3, "CHALLENGER_WINS")


def test_expire_and_gate_boundaries(spark):
    now = dt.datetime(2025, 1, 1, 1, 0, 0)
    jobs = spark.createDataFrame([
        ("a", now - dt.timedelta(minutes=5), "STARTED", None),          # exactly 5 min: not expired
        ("b", now - dt.timedelta(minutes=5, seconds=1), "PENDING", None),
        ("c", now - dt.timedelta(hours=1), "COMPLETED", "CHALLENGER_WINS"),
    ], "job_id string, start_time timestamp, status string, decision string")
    out = {r.job_id: r for r in J.job_expire(jobs, F.lit(now)).collect()}
    assert out["a"].status == "STARTED" and out["b"].status == "FAILED" and out["b"].decision == "ORPHANED_TIMEOUT"
    assert out["c"].status == "COMPLETED"
    gate = J.job_gate(jobs, F.lit(now), F.lit(0.4), F.lit(True)).first()
    assert gate.decision == "SKIP_ACTIVE"
    done = jobs.where(F.col("job_id") == "c").withColumn("start_time", F.lit(now - dt.timedelta(seconds=40)))
    assert J.job_gate(done, F.lit(now), F.lit(0.4), F.lit(True)).first().decision == "OPEN"      # exactly 40 s
    done39 = done.withColumn("start_time", F.lit(now - dt.timedelta(seconds=39)))
    assert J.job_gate(done39, F.lit(now), F.lit(0.4), F.lit(True)).first().decision == "COOLDOWN"


def test_ready_to_retrain_49_and_50(spark):
    df = spark.createDataFrame([("a", i) for i in range(49)] + [("b", i) for i in range(50)], "k string, i int")
    out = {r.k: r.status for r in J.ready_to_retrain(df, keys=["k"]).collect()}
    assert out == {"a": "REJECTED", "b": "READY"}


def test_champion_challenger_table(spark):
    df = spark.createDataFrame([(0.8, 0.9, None), (0.8, 0.7, 0.85), (0.8, 0.7, 0.75)],
                               "champ double, chall double, strong double")
    got = [r[0] for r in df.select(J.champion_challenger(F.col("champ"), F.col("chall"), F.col("strong"))).collect()]
    assert got == ["CHALLENGER_WINS", "CHALLENGER_WINS_AFTER_RETRAIN", "CHAMPION_HELD"]


def test_a_null_status_neither_blocks_nor_expires(spark):
    t = dt.datetime(2025, 1, 1, 12)
    old = t - dt.timedelta(hours=2)
    df = spark.createDataFrame([("a", old, None, None), ("b", None, None, None), ("c", old, "COMPLETED", None)],
                               "job_id string, start_time timestamp, status string, decision string")
    now = F.lit(t)
    assert {r.status for r in J.job_expire(df, now).collect()} == {None, "COMPLETED"}
    g = J.job_gate(df, now, F.lit(0.3), F.lit(True)).first()
    assert (g.active_jobs, g.decision, g.new_status, g.psi_score, g.adwin_change) == (0, "OPEN", "PENDING", 0.3, 1)


def test_event_trace_evaluates_its_frame_once(spark):
    """the frame behind the trace is written before its detection and changes are read from it"""
    psi = F.when(F.col("id").between(60, 61), 0.4).otherwise(0.1)
    frame = spark.range(70).select(F.col("id").alias("seq"), psi.alias("psi"), F.timestamp_seconds("id").alias("at"))
    out = J.event_trace(frame, step="seq", time_col="at")
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.seq, r.stage) for r in out.orderBy("seq").collect()] == [
        (0, "Warm-up"), (50, "Monitoring"), (60, "Drift Detected"), (61, "Drift Active"), (62, "Recovered")]
