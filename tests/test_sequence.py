import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.operators.sequence import dense_sequence, halo_window, prefix_sum
from vigil.operators import sequence as Q


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.RandomState(11)
    rows = [(int(i), ["a", "b", "c"][rng.randint(0, 3) if i % 5 else 0], float(rng.rand())) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(7)


def test_prefix_sum_equals_window(spark, series):
    got = prefix_sum(series, ["id"], ["v"], keys=["k"], block_rows=100)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ref = series.withColumn("r", F.sum("v").over(w))
    bad = got.join(ref, ["id", "k"]).where(F.abs(F.col("v_cum") - F.col("r")) > 1e-9).count()
    assert bad == 0 and got.count() == 2000


def test_prefix_max_and_keyless(spark, series):
    got = prefix_sum(series, ["id"], ["v"], how="max", block_rows=300)
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ref = series.withColumn("r", F.max("v").over(w))
    assert got.join(ref, ["id"]).where(F.col("v_cum") != F.col("r")).count() == 0


def test_dense_sequence(spark, series):
    got = dense_sequence(series, ["id"], keys=["k"], name="seq")
    w = Window.partitionBy("k").orderBy("id")
    ref = series.withColumn("r", F.row_number().over(w) - 1)
    assert got.join(ref, ["id", "k"]).where(F.col("seq") != F.col("r")).count() == 0


def test_halo_window_equals_plain_window(spark, series):
    seq = dense_sequence(series, ["id"], keys=["k"], name="seq")

    def build(frame, w):
        return frame.withColumn("ma", F.avg("v").over(w)).withColumn("n", F.count("v").over(w))

    got = halo_window(seq, "seq", 50, build, keys=["k"], chunk_rows=64)
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(-49, 0)
    ref = seq.withColumn("ma_r", F.avg("v").over(w)).withColumn("n_r", F.count("v").over(w))
    j = got.join(ref, ["k", "seq"])
    assert got.count() == 2000
    assert j.where((F.abs(F.col("ma") - F.col("ma_r")) > 1e-9) | (F.col("n") != F.col("n_r"))).count() == 0


def test_halo_window_reads_its_input_once(spark):
    """nested windows, too: the halo is copied in passing, not by a second evaluation"""
    frame = spark.range(200).withColumnRenamed("id", "seq")
    for c in ("a", "b"):
        frame = halo_window(frame, "seq", 7, lambda f, w, c=c: f.withColumn(c, F.sum("seq").over(w)), chunk_rows=16)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    got = {r.seq: (r.a, r.b) for r in frame.collect()}
    assert got == {i: (s := sum(range(max(0, i - 6), i + 1)), s) for i in range(200)}


@pytest.mark.parametrize("how", ["sum", "max"])
def test_prefix_blocked_many_blocks_with_nulls(spark, how):
    """Tiny blocks: offsets across many blocks, a hot key, NULL/NaN/inf order values, NULL values
    and a NULL key, against a plain window (the brute force)."""
    import vigil.operators.sequence as S
    rng = np.random.RandomState(5)
    rows = []
    for i in range(600):
        o = float(rng.randint(-300, 300)) + i * 1e-3
        o = None if i in (0, 97) else (float("nan") if i in (131, 393) else (float("inf") if i == 7 else o))
        k = None if i % 50 == 3 else ("hot" if i % 3 else "cold")
        rows.append((i, k, o, None if i % 11 == 0 else float(rng.rand())))
    df = spark.createDataFrame(rows, "id long, k string, o double, v double")
    got = S.prefix_sum(df, ["o"], ["v"], ["k"], how=how, block_rows=17)
    agg = F.max if how == "max" else F.sum
    v = F.col("v") if how == "max" else F.coalesce("v", F.lit(0.0))
    w = Window.partitionBy("k").orderBy(F.asc_nulls_first("o")).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("r", agg(v).over(w))
    j = got.join(ref, ["id"])
    assert got.count() == 600
    bad = j.where(~F.col("v_cum").eqNullSafe(F.col("r")) & ~(F.abs(F.col("v_cum") - F.col("r")) < 1e-9))
    assert bad.count() == 0


@pytest.mark.parametrize("block_rows", [1, 7, 10_000])
@pytest.mark.parametrize("order", ["ties", "outlier", "text", "two"])
def test_prefix_sum_is_the_plain_window_at_any_block_size(spark, order, block_rows):
    rng = np.random.RandomState(3)
    rows = []
    for i in range(120):
        o = {"ties": 5.0, "outlier": 1e18 if i == 60 else float(i % 40), "two": float(i % 3), "text": 0.0}[order]
        rows.append((i, None if i % 4 == 0 else "k", o, f"ß{rng.randint(50):02d}" if i % 9 else None, None, float(i)))
    df = spark.createDataFrame(rows, "id long, k string, o double, t string, empty double, v double")
    cols = ["t", "id"] if order == "text" else ["o", "id"]
    got = prefix_sum(df, cols, ["empty", "v"], ["k"], block_rows=block_rows)
    w = Window.partitionBy("k").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("r", F.sum("v").over(w)).select("id", "r")
    out = got.join(ref, "id")
    assert got.count() == 120
    assert out.where((F.col("v_cum") != F.col("r")) | (F.col("empty_cum") != 0)).count() == 0


def test_text_order_with_a_long_common_beginning(spark):
    """keys that share their first bytes are still cut into blocks, and the sums are right"""
    rows = [(f"https://example.org/a/very/long/path/{i * 7919 % 5000:05d}", float(i % 11), None if i % 3 else i) for i in range(5000)] + [(None, 1.0, 5)]
    df = spark.createDataFrame(rows, "t string, x double, y int").repartition(4)
    block = Q._text_block(df, "t", 20)
    sizes = [r["count"] for r in df.groupBy(block.alias("b")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 1500
    for how, col in (("sum", "x"), ("max", "x"), ("last", "y")):
        got = {r.t: r[f"{col}_cum"] for r in Q.prefix_sum(df, ["t"], [col], how=how, block_rows=250).collect()}
        total = None
        for t, x, y in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
            total = (total or 0) + x if how == "sum" else max(total or 0, x) if how == "max" else y if y is not None else total
            assert got[t] == total
