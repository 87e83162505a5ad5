import numpy as np
import pytest

from pyspark.sql import functions as F

from vigil.operators import metrics as M


def scored(spark, p, y, key="m"):
    return spark.createDataFrame([(key, float(a), int(b)) for a, b in zip(p, y)], "m string, p double, y int")


def brute_auc(p, y):
    pos = [a for a, b in zip(p, y) if b == 1]
    neg = [a for a, b in zip(p, y) if b == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def brute_pr_auc(p, y):
    p, y = np.asarray(p), np.asarray(y)
    th = np.unique(p)[::-1]
    prec, rec = [1.0], [0.0]
    for t in th:
        tp = ((p >= t) & (y == 1)).sum()
        fp = ((p >= t) & (y == 0)).sum()
        prec.append(tp / (tp + fp))
        rec.append(tp / y.sum())
    return float(sum((rec[i] - rec[i - 1]) * (prec[i] + prec[i - 1]) / 2 for i in range(1, len(rec))))


def f1(tp, fp, fn):
    return 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)


@pytest.fixture(scope="module")
def data():
    rng = np.random.RandomState(7)
    y = rng.randint(0, 2, 300)
    p = np.round(np.clip(0.3 * y + rng.rand(300) * 0.7, 0, 1), 2)  # rounded: many ties
    return p, y


def test_auc_with_ties(spark, data):
    p, y = data
    got = M.roc_auc(scored(spark, p, y), "p", "y", keys=["m"]).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(p, y), abs=1e-12)


def test_auc_invariant_under_monotone_map(spark, data):
    p, y = data
    a = M.roc_auc(scored(spark, p, y), "p", "y").first()["roc_auc"]
    b = M.roc_auc(scored(spark, np.exp(3 * p), y), "p", "y").first()["roc_auc"]
    assert a == pytest.approx(b, abs=1e-12)


def test_pr_auc_starts_at_precision_one(spark, data):
    p, y = data
    got = M.pr_auc(scored(spark, p, y), "p", "y").first()["pr_auc"]
    assert got == pytest.approx(brute_pr_auc(p, y), abs=1e-12)


def test_threshold_curve_matches_loop(spark, data):
    p, y = data
    curve = {round(r["threshold"], 12): r for r in M.threshold_curve(scored(spark, p, y), "p", "y").collect()}
    best_t, best = 0.5, 0.0
    for t in np.arange(0.01, 1.0, 0.01):  # the grid the reference loops over
        pred = p >= t
        tp, fp, fn = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum()), int((~pred & (y == 1)).sum())
        r = curve[round(float(t), 12)]
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
        assert r["f1"] == pytest.approx(f1(tp, fp, fn), abs=1e-12)
        if f1(tp, fp, fn) > best:
            best, best_t = f1(tp, fp, fn), float(t)
    got = M.best_threshold_grid(scored(spark, p, y), "p", "y").first()
    assert got["threshold"] == pytest.approx(best_t, abs=1e-12) and got["best_f1"] == pytest.approx(best)


def test_zero_denominators_and_one_class(spark):
    df = scored(spark, [0.1, 0.2, 0.3], [0, 0, 0])
    m = M.class_metrics(df, "p", "y", 0.5).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    b = M.best_f1_all_thresholds(df, "p", "y").first()
    assert (b["best_f1"], b["roc_auc"]) == (0.0, 0.5)
    assert M.roc_auc(df, "p", "y").first()["roc_auc"] is None


def test_score_exactly_on_threshold_is_positive(spark):
    c = M.confusion(scored(spark, [0.5, 0.49999], [1, 1]), "p", "y", 0.5).first()
    assert (c["tp"], c["fn"]) == (1, 1)


def test_all_grid_f1_zero_gives_default(spark):
    g = M.best_threshold_grid(scored(spark, [0.001, 0.002], [1, 0]), "p", "y").first()
    assert g["threshold"] == 0.5 and g["best_f1"] == 0.0


def test_best_f1_all_thresholds_brute(spark, data):
    p, y = data
    cands = np.unique(np.concatenate(([0.0, 0.5, 1.0], p)))
    want = max(f1(((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum(), ((p < t) & (y == 1)).sum())
               for t in cands)
    got = M.best_f1_all_thresholds(scored(spark, p, y), "p", "y", keys=["m"]).first()
    assert got["best_f1"] == pytest.approx(want, abs=1e-12)


def test_running_counts_sort_the_scores_once(spark):
    """the totals come from the counts, not from the running sums again"""
    df = spark.range(500).select((F.col("id") % 97 / 97).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).alias("k"))
    cum = M.cumulative_from_top(df, "p", "y", ["k"])
    plan = cum._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    rows = cum.collect()
    for k in (0, 1):
        mine = [r for r in rows if r.k == k]
        assert {(r.P, r.N) for r in mine} == {(sum(r.pos for r in mine), sum(r.neg for r in mine))}
        assert max(r.tp for r in mine) == mine[0].P and max(r.fp for r in mine) == mine[0].N


def test_best_f1_reads_the_rows_once(spark, monkeypatch):
    """after the counts are stored nothing goes back to the rows; keys with NULL scores only and NULL labels as before"""
    rows = [("a", 0.2, 0), ("a", 0.7, 1), ("a", None, 1), ("a", 0.7, None), ("b", None, 1), ("b", None, 0), (None, 0.5, 1), (None, 0.4, 0)]
    df = spark.createDataFrame(rows, "k string, p double, y int")
    seen = []
    counted = M.score_counts
    monkeypatch.setattr(M, "score_counts", lambda *a: seen.append(1) or counted(*a))
    out = M.best_f1_all_thresholds(df, "p", "y", ["k"])
    assert len(seen) == 1 and "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (r.best_f1, r.roc_auc) for r in out.collect()}
    assert got["a"] == (1.0, 1.0) and got["b"] == (0.0, 0.5) and got[None] == (1.0, 1.0)
