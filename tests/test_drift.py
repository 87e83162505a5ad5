import bisect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import drift as D


def np_psi(expected, actual, buckets=10):
    """The definition, value by value: a bin is the number of inner deciles not above the value."""
    if not len(expected) or not len(actual):
        return 0.0
    inner = sorted(float(np.quantile(expected, i / buckets)) for i in range(1, buckets))
    total = 0.0
    for b in range(buckets):
        share = [max(sum(bisect.bisect_right(inner, x) == b for x in side) / len(side), 0.0) or 1e-4 for side in (expected, actual)]
        total += (share[1] - share[0]) * math.log(share[1] / share[0])
    return total


def frame(spark, exp, act, key="k"):
    rows = [(key, float(x), False) for x in exp] + [(key, float(x), True) for x in act]
    return spark.createDataFrame(rows, "k string, x double, cur boolean")


@pytest.mark.parametrize("method", ["exact"])
def test_quantile_edges_match_numpy(spark, method):
    rng = np.random.RandomState(1)
    vals = np.round(rng.exponential(50, 997), 2)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = D.quantile_edges(df, "x", method=method).first()["edges"]
    want = np.percentile(vals, np.arange(1, 10) * 10)
    assert np.allclose(got, want, rtol=0, atol=1e-9)


QS = [0.0, 0.001, 0.25, 0.5, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("k,move", [(2000, 0.006), (8, 0.0), (8, 0.02)])
def test_quantiles_by_bracket_and_refine(spark, monkeypatch, k, move):
    """also with a sketch so coarse that its brackets miss: the exact counts see it and all values are taken"""
    monkeypatch.setattr(D, "SKETCH_K", k)
    monkeypatch.setattr(D, "BRACKET", move)
    rng = np.random.RandomState(3)
    groups = {"wide": rng.lognormal(3, 4, 6000), "ties": rng.randint(0, 4, 5000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]),
              "ends": np.concatenate([[-np.inf] * 40, rng.normal(size=3000), [np.inf] * 40]), None: np.arange(2500.0)}
    rows = [(key, float(x)) for key, xs in groups.items() for x in xs] + [("wide", None), ("wide", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: (r["quantiles"], r.n) for r in D.quantiles(df, "x", QS, keys=["k"]).collect()}
    assert set(got) == set(groups)
    for key, xs in groups.items():
        xs = np.sort(xs)
        at = [(int(q * (len(xs) - 1)), math.ceil(q * (len(xs) - 1)), q) for q in QS]
        want = [xs[a] if xs[a] == xs[z] else np.quantile(xs, q) for a, z, q in at]
        assert got[key][1] == len(xs) and np.allclose(got[key][0], want, rtol=1e-12, atol=1e-12), key
    keyless = D.quantiles(df.where("k = 'wide'"), "x", [0.5]).first()
    assert keyless["quantiles"] == pytest.approx([np.median(groups["wide"])])
    assert D.quantiles(df.where("k = 'empty'"), "x", [0.5], keys=["k"]).collect() == []


@pytest.mark.parametrize("method", ["exact"])
def test_psi_matches_numpy_and_ties(spark, method):
    rng = np.random.RandomState(2)
    exp = np.round(rng.normal(0, 1, 500), 1)          # many ties -> repeated edges, empty bins
    act = np.round(rng.normal(0.4, 1.2, 300), 1)
    out = D.psi(frame(spark, exp, act), "x", F.col("cur"), keys=["k"], method=method).first()
    assert out["psi"] == pytest.approx(np_psi(exp, act), abs=1e-9)


def test_psi_identity_zero_and_nonnegative(spark):
    x = np.arange(200) % 17 * 1.5
    assert D.psi(frame(spark, x, x), "x", F.col("cur"), keys=["k"]).first()["psi"] == pytest.approx(0.0, abs=1e-12)
    rng = np.random.RandomState(3)
    for _ in range(3):
        a, b = rng.rand(100), rng.rand(80) * 2
        assert D.psi(frame(spark, a, b), "x", F.col("cur"), keys=["k"]).first()["psi"] >= 0


def test_psi_drops_null_and_nan_and_empty_side(spark):
    rows = [("k", 1.0, False), ("k", 2.0, False), ("k", float("nan"), False), ("k", None, True)]
    df = spark.createDataFrame(rows, "k string, x double, cur boolean")
    out = D.psi(df, "x", F.col("cur"), keys=["k"]).first()
    assert out["n_expected"] == 2 and out["n_actual"] == 0 and out["psi"] == 0.0


def test_keyless_psi_equals_keyed(spark):
    rng = np.random.RandomState(4)
    df = frame(spark, rng.rand(300), rng.rand(200) ** 2)
    a = D.psi(df, "x", F.col("cur")).first()["psi"]
    b = D.psi(df, "x", F.col("cur"), keys=["k"]).first()["psi"]
    assert a == pytest.approx(b, abs=1e-12)


def test_psi_report_needs_more_than_ten_rows(spark):
    base = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)], "price double, discount_pct double")
    cur10 = base.limit(10)
    cur11 = base.limit(11)
    assert D.psi_report(base, cur10, ["price", "discount_pct"]).count() == 0
    rep = D.psi_report(base, cur11, ["price", "discount_pct", "absent"]).first()
    assert rep["n_features"] == 2 and rep["alert"] == (rep["psi"] > 0.2)


def test_ks_statistic_brute_force(spark):
    rng = np.random.RandomState(5)
    a, b = np.round(rng.rand(120), 2), np.round(rng.rand(90) * 1.3, 2)
    got = D.ks_two_sample(frame(spark, a, b), "x", F.col("cur"), keys=["k"], method="asymptotic").first()
    grid = np.union1d(a, b)
    d = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert got["ks_stat"] == pytest.approx(d, abs=1e-12)
    en = len(a) * len(b) / (len(a) + len(b))
    z = math.sqrt(en) * d
    q = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))
    assert got["ks_p"] == pytest.approx(min(max(q, 0), 1), abs=1e-9)


def test_mean_shift_flag(spark):
    df = frame(spark, [10.0] * 10, [13.0] * 10)
    out = D.mean_shift(df, "x", F.col("cur"), keys=["k"]).first()
    assert out["relative_shift"] == pytest.approx(0.3, abs=1e-6) and out["shifted"]


def test_adwin_detects_a_jump():
    x = np.concatenate([np.full(150, 1.0), np.full(150, 5.0)]) + np.random.RandomState(0).rand(300) * 0.1
    assert D.adwin_first_change(x) > 150
    assert D.adwin_first_change(np.random.RandomState(1).rand(300)) == -1


def test_null_keys_and_keys_of_one_side_only(spark):
    rows = [(None, float(i % 7), i % 2 == 0) for i in range(60)] + [("new", 1.0, True)] * 5
    df = spark.createDataFrame(rows, "k string, x double, cur boolean")
    out = {r["k"]: r for r in D.psi(df, "x", F.col("cur"), keys=["k"]).collect()}
    assert out[None]["n_expected"] == 30 and out[None]["n_actual"] == 30
    assert out["new"]["psi"] == 0.0 and (out["new"]["n_expected"], out["new"]["n_actual"]) == (0, 5)
    ks = {r["k"]: r for r in D.ks_two_sample(df, "x", F.col("cur"), keys=["k"]).collect()}
    assert None in ks


def test_ks_counts_a_missing_current_value_as_zero(spark):
    rows = [("k", 1.0, False), ("k", 2.0, False), ("k", None, False), ("k", None, True), ("k", 2.0, True)]
    r = D.ks_two_sample(spark.createDataFrame(rows, "k string, x double, cur boolean"), "x", F.col("cur"), keys=["k"]).first()
    assert (r["n_expected"], r["n_actual"]) == (2, 2) and r["ks_stat"] == pytest.approx(0.5)


def test_exact_ks_p_equals_enumeration():
    from itertools import combinations
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (3, 6), (6, 4)):
        stats = []
        for own in combinations(range(n + m), n):
            a = b = 0
            gap = 0
            for k in range(n + m):
                a, b = (a + 1, b) if k in own else (a, b + 1)
                gap = max(gap, abs(a * m - b * n))
            stats.append(gap)
        for gap in sorted(set(stats)):
            want = sum(g >= gap for g in stats) / len(stats)
            assert D.exact_ks_p(gap / (n * m), n, m) == pytest.approx(want, abs=1e-12)
    assert D.exact_ks_p(0.0, 5, 5) == 1.0


def test_ks_p_is_exact_for_small_samples_and_asymptotic_for_large(spark, monkeypatch):
    rng = np.random.RandomState(5)
    small, large = (rng.normal(size=7), rng.normal(1, 1, 9)), (rng.normal(size=400), rng.normal(0.1, 1, 300))
    df = frame(spark, *small, key="small").unionByName(frame(spark, *large, key="large"))
    monkeypatch.setattr(D, "EXACT_KS_CELLS", 100)
    auto = {r.k: r for r in D.ks_two_sample(df, "x", F.col("cur"), keys=["k"]).collect()}
    series = {r.k: r for r in D.ks_two_sample(df, "x", F.col("cur"), keys=["k"], method="asymptotic").collect()}
    exact = {r.k: r for r in D.ks_two_sample(df, "x", F.col("cur"), keys=["k"], method="exact").collect()}
    assert auto["small"].ks_p == pytest.approx(D.exact_ks_p(auto["small"].ks_stat, 7, 9)) != pytest.approx(series["small"].ks_p)
    assert auto["large"].ks_p == series["large"].ks_p == pytest.approx(exact["large"].ks_p, abs=0.03)
