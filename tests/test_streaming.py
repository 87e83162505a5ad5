import json

import numpy as np

from pyspark.sql import functions as F

from vigil import config as C
from vigil.operators import models as ML
from vigil.operators.adwin import Adwin
from vigil.session import scratch_path
from vigil.sources import logs as L
from vigil.sources import registry as R
from vigil.streaming import adwin_stream as A
from vigil.streaming import streams as S


def test_stream_psi_window_equals_batch(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "ts", "value", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    edges = S.window_psi_edges(ev.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp")), ["value", "k"])
    batch = {r.window_start: (r.n_rows, round(r.psi, 9)) for r in
             S.windowed_psi_frame(ev, edges, "ts", "1 day").collect()}
    land = scratch_path(spark, "t-land")
    ev.repartition(3).write.parquet(land)
    out = scratch_path(spark, "t-out")
    S.stream_psi_window(spark, land, ev.schema, edges, out, scratch_path(spark, "t-ck")).awaitTermination()
    res = spark.read.parquet(out).groupBy("window_start").agg(F.max_by(F.struct("n_rows", "psi"), "batch_id").alias("x"))
    stream = {r.window_start: (r.x.n_rows, round(r.x.psi, 9)) for r in res.collect()}
    assert stream == batch


def test_stream_score_restart_is_idempotent(spark):
    src = scratch_path(spark, "t-src")
    rows = [json.dumps({"event_time": "2025-01-01 00:00:00", "price": 600.0 + i, "is_fraud": i % 2 == 0,
                        "is_high_value": False, "event_type": "purchase"}) for i in range(20)]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(src)
    log, ck = scratch_path(spark, "t-log"), scratch_path(spark, "t-ck")
    S.stream_score(spark, src, log, ck).awaitTermination()
    S.stream_score(spark, src, log, ck).awaitTermination()   # restart from the checkpoint: nothing new
    out = L.read_log(spark, log)
    assert out.count() == 20
    assert out.where(F.col("is_high_value") != 1).count() == 0   # price > 500 flags


def _log(spark, path, batch, start, prices):
    rows = [(f"2025-01-01 {start // 60:02d}:{start % 60:02d}:{i % 60:02d}", float(p), 100.0, 0.1, 0.1, 1.0) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "timestamp string, price double, session_duration double, merchant_risk_score double, "
                                     "discount_pct double, fraud_probability double")
    L.log_append(df, path, batch_id=batch)


def test_monitor_over_several_triggers(spark):
    """Quiet, alert, active job, expired job: the gate opens once and a quiet trigger blocks nothing."""
    log, jobs, ck = (scratch_path(spark, n) for n in ("m-log", "m-jobs", "m-ck"))
    base = spark.createDataFrame([(float(i % 50), 100.0, 0.1, 0.1) for i in range(500)],
                                 "price double, session_duration double, merchant_risk_score double, discount_pct double")
    seen = []
    for batch, (minute, shift) in enumerate([(0, 0.0), (10, 900.0), (11, 900.0), (30, 900.0)]):
        _log(spark, log, batch, minute, [float(i % 50) + shift for i in range(200)])
        S.stream_monitor(spark, log, base, jobs, ck).awaitTermination()
        now = {(r.job_id, r.decision, r.status) for r in spark.read.schema(S.JOB_EVENT_SCHEMA).parquet(jobs).where(F.col("monitor_batch") == batch).collect()}
        seen.append(now)
    assert seen[0] == {("job_0", "OPEN", None)}
    assert seen[1] == {("job_1", "OPEN", "PENDING")}
    assert seen[2] == {("job_2", "SKIP_ACTIVE", None)}
    assert seen[3] == {("job_3", "OPEN", "PENDING"), ("job_1", "ORPHANED_TIMEOUT", "FAILED")}


def test_scoring_follows_the_active_model(spark):
    src, log, ck, runs = (scratch_path(spark, n) for n in ("a-src", "a-log", "a-ck", "a-runs"))

    def finish(name, day, kind):
        spark.sql(f"SELECT '{name}' run_id, 'fraud' experiment, 'FINISHED' status, timestamp'2025-01-0{day}' start_time, "
                  f"map('model_type', '{kind}') params, map('f1', 0.5D) metrics").write.mode("append").parquet(runs)

    def constant(p):
        return lambda df: df.withColumn("fraud_probability", F.lit(p)).withColumn("model_version", F.lit(str(p)))

    lookup = S.active_scorer(spark, runs, "fraud", {"old": constant(0.25), "new": constant(0.75)})
    for day, kind in ((1, "old"), (2, "new")):
        finish(f"r{day}", day, kind)
        rows = [(json.dumps({"event_time": f"2025-01-0{day} 00:00:00", "price": 5.0}),)]
        spark.createDataFrame(rows, "value string").write.mode("append").text(src)
        S.stream_score(spark, src, log, ck, lookup).awaitTermination()
    out = {r.batch: r.fraud_probability for r in L.read_log(spark, log).collect()}
    assert out == {"0": 0.25, "1": 0.75}


def test_window_edges_leave_out_nan(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(float("nan"),)] * 100, "x double")
    assert S.window_psi_edges(df, ["x"])["x"][1] == [0.1] * 10


def test_kafka_options():
    assert S.kafka_options("h:1", "t", 5) == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest",
                                              "failOnDataLoss": "true", "maxOffsetsPerTrigger": "5"}


def test_adwin_stream_equals_one_value_at_a_time_over_restarts(spark):
    A.use_rocksdb(spark)
    rng = np.random.RandomState(1)
    series = {"jump": np.concatenate([rng.normal(0, 1, 300), rng.normal(4, 1, 300)]), "calm": rng.normal(0, 1, 600), None: rng.normal(9, 1, 90)}
    src, out, ck = (scratch_path(spark, n) for n in ("w-src", "w-out", "w-ck"))
    for part in range(3):
        rows = [(k, i, float(v)) for k, xs in series.items() for i, v in enumerate(xs) if i * 3 // len(xs) == part] + [("calm", 10_000 + part, float("nan"))]
        spark.createDataFrame(rows, "s string, i long, x double").repartition(3).write.mode("append").parquet(src)
        stream = spark.readStream.schema("s string, i long, x double").parquet(src)
        A.adaptive_window_stream(stream, "x", "i", "s").writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(out)) \
            .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = {(r.series, r.n_seen): r for r in spark.read.parquet(out).collect()}
    for k, xs in series.items():
        own = Adwin()
        for i, v in enumerate(xs):
            own.add(v)
            if (i + 1) % (len(xs) // 3) == 0:
                r = got[(k or "", i + 1)]
                assert (r.width, r.n_changes, r.last_change) == (own.width, own.changes, own.last_change if own.last_change >= 0 else None)
                assert abs(r.window_mean - own.mean()) < 1e-9
    assert got[("jump", 600)].n_changes >= 1 and got[("calm", 600)].n_changes == 0


def test_adwin_memory_is_logarithmic_and_its_moments_are_right():
    rng = np.random.RandomState(2)
    own, values = Adwin(delta=1e-9), rng.normal(5, 2, 20_000)
    for v in values:
        own.add(v)
    assert own.width == 20_000 and sum(map(len, own.rows)) < 100 and len(own.dumps()) < 5000
    assert abs(own.mean() - values.mean()) < 1e-9
    again = Adwin.loads(own.dumps())
    assert again.dumps() == own.dumps() and again.mean() == own.mean()


def test_sliding_windows_in_append_mode(spark):
    """each window comes out once, after the watermark has passed it, equal to its batch twin; a late row is dropped and counted"""
    minutes = [(f"2025-01-01 00:{m:02d}:00", float(m % 7)) for m in range(60)]
    late, far = ("2025-01-01 00:01:00", 3.0), ("2025-01-01 06:00:00", 1.0)
    frame = lambda rows: spark.createDataFrame(rows, "t string, x double").select(F.to_timestamp("t").alias("ts"), "x")
    edges = S.window_psi_edges(frame([(t, x) for t, x in minutes]), ["x"])
    src, out, ck = (scratch_path(spark, n) for n in ("sl-src", "sl-out", "sl-ck"))
    dropped = 0
    for rows in (minutes, [far], [late], [("2025-01-01 12:00:00", 1.0)]):
        frame(rows).coalesce(1).write.mode("append").parquet(src)
        q = S.stream_psi_window(spark, src, frame(rows).schema, edges, out, ck, window="20 minutes", slide="10 minutes", watermark="30 minutes", mode="append")
        q.awaitTermination()
        dropped += S.late_rows(q)
    batch = {r.window_start: (r.n_rows, round(r.psi, 9)) for r in S.windowed_psi_frame(frame([*minutes, far]), edges, "ts", "20 minutes", slide="10 minutes").collect()}
    got = [(r.window_start, (r.n_rows, round(r.psi, 9))) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(dict(got)) and dict(got) == batch
    assert len(batch) == 9 and sum(n for n, _ in batch.values()) == 2 * 61
    assert dropped == 2  # the late row, in both of its windows


def test_the_stream_encodes_and_scores_with_the_active_run(spark):
    """a switch in the registry between two triggers: each batch is encoded and scored by the model active then"""
    src, log, ck, reg = (scratch_path(spark, n) for n in ("r-src", "r-log", "r-ck", "r-reg"))
    rows = [(float(i % 40), float(i % 2), float(i % 2)) for i in range(80)]
    frame = spark.createDataFrame(rows, "price double, device_type double, label double")
    for name, path in (("one", scratch_path(spark, "m1")), ("two", scratch_path(spark, "m2"))):
        ML.save_model(ML.train_gbt(frame if name == "one" else frame.withColumn("label", 1 - F.col("label")), ["price", "device_type"], max_iter=2, max_depth=2), path)
        R.register_run(spark, reg, name, "fraud", "FINISHED", {"path": path, "canonical_features": "price,device_type", "predictive_features": ""})
    assert R.switch_active(spark, reg, "one", None)
    lookup = S.registry_scorer(spark, reg)
    codes = list(C.CATEGORY_MAPS["device_type"])
    for day, active in ((1, "one"), (2, "two")):
        if active == "two":
            assert R.switch_active(spark, reg, "two", "one")
        lines = [(json.dumps({"event_time": f"2025-01-0{day} 00:00:00", "price": 5.0, "device_type": codes[k % 2], "user_id": k}),) for k in range(4)]
        spark.createDataFrame(lines, "value string").write.mode("append").text(src)
        S.stream_score(spark, src, log, ck, lookup).awaitTermination()
    out = L.read_log(spark, log)
    assert {(r.batch, r.model_version) for r in out.select("batch", "model_version").distinct().collect()} == {("0", "one"), ("1", "two")}
    p = {(r.batch, r.device_type): r.fraud_probability for r in out.collect()}
    assert p[("0", codes[1])] > 0.5 > p[("0", codes[0])] and p[("1", codes[1])] < 0.5 < p[("1", codes[0])]
