import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.operators import rolling as R
from vigil.session import cut_lineage


@pytest.fixture(scope="module")
def stream(spark):
    rng = np.random.RandomState(3)
    n = 130
    p = np.round(rng.rand(n), 2)
    y = rng.randint(0, 2, n)
    rows = [("s", i, float(p[i]), int(y[i]), float(rng.rand())) for i in range(n)]
    return spark.createDataFrame(rows, "scenario string, seq long, p double, y int, price double"), p, y


def test_rolling_confusion_threshold_change_inside_window(spark, stream):
    df, p, y = stream
    changes = spark.createDataFrame([("s", -1, 0.5, "champion"), ("s", 60, 0.3, "challenger")],
                                    "scenario string, change_step long, threshold double, model string")
    tl = R.model_timeline(df, changes, step="seq", keys=["scenario"])
    conf = {r.seq: r for r in R.rolling_confusion(tl, "p", "y", "threshold", step="seq", keys=["scenario"],
                                                   chunk_rows=64).collect()}
    for s in (0, 49, 50, 51, 60, 61, 100, 129):
        t = 0.5 if s <= 60 else 0.3          # a change at 60 acts from 61
        if s < 50:
            assert (conf[s].tp, conf[s].fp, conf[s].fn, conf[s].tn) == (0, 0, 0, 0)
            continue
        wp, wy = p[s - 49:s + 1] >= t, y[s - 49:s + 1]
        assert conf[s].tp == int((wp & (wy == 1)).sum()) and conf[s].fp == int((wp & (wy == 0)).sum())
        assert conf[s].fn == int((~wp & (wy == 1)).sum()) and conf[s].tn == int((~wp & (wy == 0)).sum())
        assert conf[s].threshold == t


def test_smooth_min_one_row(spark, stream):
    df, p, _ = stream
    got = {r.seq: r.p_smooth for r in R.smooth(df, "p", step="seq", keys=["scenario"], chunk_rows=40).collect()}
    ref = pd.Series(p).rolling(15, min_periods=1).mean()
    assert all(abs(got[i] - ref[i]) < 1e-12 for i in range(len(p)))


def test_rank_pct_matches_pandas(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, None, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")
    got = {r.i: r.v_rank_pct for r in R.rank_pct(df, "v").collect()}
    ref = pd.Series(vals).rank(pct=True)
    for i, v in enumerate(vals):
        assert (got[i] is None) if v is None else got[i] == pytest.approx(ref[i])


def test_rolling_psi_brute_force(spark, stream):
    df, _, _ = stream
    base = spark.createDataFrame([(float(x),) for x in np.random.RandomState(9).rand(400)], "price double")
    out = {r.seq: r.psi for r in R.rolling_psi(df, base, ["price"], step="seq", keys=["scenario"],
                                                  chunk_rows=64).collect()}
    b = np.array([r[0] for r in base.collect()])
    edges = np.percentile(b, np.arange(1, 10) * 10)
    e = np.bincount(np.searchsorted(edges, b, side="right"), minlength=10) / len(b)
    price = np.array([r.price for r in df.orderBy("seq").collect()])
    for s in (10, 49, 50, 77, 129):
        if s < 50:
            assert out[s] == 0.0
            continue
        w = price[s - 49:s + 1]
        a = np.bincount(np.searchsorted(edges, w, side="right"), minlength=10) / len(w)
        a, ee = np.where(a == 0, 1e-4, a), np.where(e == 0, 1e-4, e)
        assert out[s] == pytest.approx(float(np.sum((a - ee) * np.log(a / ee))), abs=1e-9)


def test_stage_of_step_and_progress(spark):
    psi = {49: 9.0, 50: 0.1, 60: 0.3, 61: 0.4, 62: 0.1}
    df = spark.createDataFrame([("s", i, psi.get(i, 0.0)) for i in range(64)] + [("calm", 70, 0.1)], "k string, seq long, psi double")
    marked = R.with_detection(df, "seq", "psi", ["k"])
    out = {(r.k, r.seq): r.stage for r in marked.select("k", "seq", R.stage_of_step("seq").alias("stage")).collect()}
    assert [out["s", i] for i in (49, 50, 60, 61, 62)] == ["Warm-up", "Monitoring", "Drift Detected", "Drift Active", "Recovered"]
    assert out["calm", 70] == "Monitoring"
    prog = spark.createDataFrame([("Drift Detected",), ("?",)], "stage string").select(R.stage_progress("stage").alias("x")).collect()
    assert [s.state for s in prog[0].x] == ["done", "done", "active", "future", "future"]
    assert {s.state for s in prog[1].x} == {"future"}


def test_recovery_stats_arithmetic(spark):
    rows = [("s", i, 0.9 if i < 300 else (0.4 if i < 650 else 0.8)) for i in range(1000)]
    df = spark.createDataFrame(rows, "scenario string, seq long, f1 double")
    r = R.recovery_stats(df, "f1", step="seq", keys=["scenario"]).first()
    assert (r.f1_before_drift, r.lowest_f1, r.f1_after_recovery) == pytest.approx((0.9, 0.4, 0.8))
    assert r.absolute_recovery == pytest.approx(0.4) and r.relative_recovery == pytest.approx(100.0)


def test_rolling_confusion_with_a_threshold_for_every_row(spark):
    rng = np.random.RandomState(4)
    rows = [("s" if i % 2 else None, i // 2, None if i == 80 else float(rng.rand()), int(rng.rand() < 0.4), None if i == 90 else float(rng.rand()))
            for i in range(160)]
    df = spark.createDataFrame(rows, "k string, seq long, p double, y int, t double")
    got = {(r.k, r.seq): (r.tn, r.fp, r.fn, r.tp) for r in R.rolling_confusion(df, "p", "y", "t", step="seq", keys=["k"], window=20, chunk_rows=32).collect()}
    for k in ("s", None):
        series = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for n, (_, step, _, _, t) in enumerate(series):
            seen = [(r[2] >= t, r[3]) for r in series[n - 19:n + 1] if r[2] is not None] if step >= 20 and t is not None else []
            assert got[k, step] == tuple(seen.count(c) for c in ((False, 0), (True, 0), (False, 1), (True, 1)))



def test_timeline_with_many_changes_of_one_key(spark, monkeypatch):
    """10^5 changes of one key over blocks of 2^13 rows: no array of changes anywhere"""
    import vigil.operators.sequence as Q
    monkeypatch.setattr(Q.prefix_sum, "__defaults__", (None, "_cum", "sum", 1 << 13, False, None))
    n = 100_000
    changes = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 3).alias("change_step"), (F.col("id") * 0.5).alias("threshold"),
                                    F.when(F.col("id") % 7 != 0, F.concat(F.lit("m"), F.col("id").cast("string"))).alias("model"))
    rows = spark.range(3 * n).select(F.lit("hot").alias("k"), (F.col("id") - 1).alias("step")).unionByName(spark.sql("SELECT 'none' k, 5L step UNION ALL SELECT NULL, 9L"))
    out = R.model_timeline(rows, changes.unionByName(spark.sql("SELECT NULL k, 2L change_step, 0.25D threshold, 'x' model")), step="step", keys=["k"])
    assert out.count() == 3 * n + 2
    at = F.floor((F.col("step") - 1) / 3)  # the latest change before the step
    wrong = out.where("k = 'hot'").where(~F.when(F.col("step") <= 0, F.col("threshold").isNull()).otherwise(
        (F.col("threshold") == at * 0.5) & F.col("model").eqNullSafe(F.when(at % 7 != 0, F.concat(F.lit("m"), at.cast("string"))))))
    assert wrong.count() == 0
    assert {(r.k, r.threshold, r.model) for r in out.where("k IS NULL OR k = 'none'").collect()} == {("none", None, None), (None, 0.25, "x")}


def test_ranks_with_one_hot_value(spark):
    """90 % equal values: ranks as pandas gives them, and their rows in no single task"""
    rng = np.random.RandomState(8)
    values = np.where(rng.rand(20_000) < 0.9, 0.0, np.round(rng.normal(size=20_000), 4))
    rows = [(i, "a" if i % 3 else None, float(v)) for i, v in enumerate(values)] + [(-1, "a", None)]
    df = spark.createDataFrame(rows, "i long, k string, x double").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = cut_lineage(R.rank_pct(df, "x", keys=["k"]).withColumn("task", F.spark_partition_id()))
        per_task = [r["count"] for r in out.groupBy("task").count().collect()]
        got = {r.i: r.x_rank_pct for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(per_task) <= 2 * np.median(per_task)
    ref = pd.DataFrame(rows, columns=["i", "k", "x"])
    want = ref.groupby(ref.k.fillna("~")).x.rank(pct=True)
    assert all((got[i] is None) if pd.isna(w) else got[i] == pytest.approx(w, abs=1e-12) for i, w in zip(ref.i, want))


def test_change_point_of_a_jump(spark):
    rng = np.random.RandomState(9)
    rows = [("up", i, float(rng.normal(0 if i < 400 else 2))) for i in range(1000)] + [("flat", i, 3.0) for i in range(50)] + [(None, i, float(i >= 7)) for i in range(20)]
    rows += [("up", 2000, None), ("up", 2001, float("nan"))]
    got = {r.k: r for r in R.change_point(spark.createDataFrame(rows, "k string, seq long, x double").repartition(3), "x", step="seq", keys=["k"]).collect()}
    assert abs(got["up"].change_step - 400) <= 5 and got["flat"].change_step is None and got[None].change_step == 7
