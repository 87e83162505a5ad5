"""Drift statistics: quantile edges, histograms, PSI, KS, mean shift, ADWIN.

All statistics take optional grouping ``keys`` (model, scenario, feature …)
and are computed as distributed aggregations:

* exact quantiles by bracket and refine: a mergeable sketch brackets every
  order statistic, a second scan counts what lies below each bracket and keeps
  only the values inside, and those few are ranked with ``prefix_sum``.  The
  counts are exact, so a bracket that missed is seen and widened;
* binning a row against its edges is ``size(filter(edges, e -> x >= e))`` —
  the edges arrive as a scalar subquery (keyless) or through an equi-join on
  the keys (one row per key; AQE turns it into a broadcast when small);
* both histograms of a PSI come from **one** aggregation over the tagged
  union of the two sides.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import config as C
from vigil.operators.adwin import DELTA, Adwin
from vigil.operators.sequence import attach, prefix_sum
from vigil.session import cut_lineage


def valid_number(c) -> Column:
    """Not NULL and not NaN (Spark orders NaN above +inf: drop it first)."""
    x = F.col(c) if isinstance(c, str) else c
    return x.isNotNull() & ~F.isnan(x)


def _keys(keys) -> list[str]:
    return list(keys or [])


# ------------------------------------------------------------------ quantiles

def quantile_edges(df: DataFrame, value_col: str, keys=None, buckets: int = C.PSI_BUCKETS,
                   method: str = "exact", accuracy: int = 100000) -> DataFrame:
    """Inner edges (``buckets - 1`` linear-interpolated quantiles) per key.

    Returns ``keys + [edges array<double>, n long]``.  Outer edges are ±inf and
    implicit.  ``method="exact"`` interpolates like ``quantile_cont``;
    ``method="approx"`` uses ``percentile_approx`` (bounded memory sketch).
    """
    qs = [i / buckets for i in range(1, buckets)]
    return quantiles(df, value_col, qs, keys, method, accuracy, out_col="edges")


def quantiles(df: DataFrame, value_col: str, qs: list[float], keys=None, method: str = "exact",
              accuracy: int = 100000, out_col: str = "quantiles") -> DataFrame:
    """Linear-interpolated quantiles ``qs`` of ``value_col`` per key (NULL/NaN dropped).

    Returns ``keys + [out_col array<double>, n long]``; NULL keys are a key of
    their own.  ``"exact"`` selects by bracket and refine, two scans, no per-group buffer;
    ``"approx"`` is the ``percentile_approx`` sketch.
    """
    keys = _keys(keys)
    clean = df.where(valid_number(value_col)).select(*keys, F.col(value_col).cast("double").alias("_x"))
    if method == "approx":
        return clean.groupBy(*keys).agg(
            F.percentile_approx("_x", F.array(*[F.lit(q) for q in qs]), accuracy).alias(out_col),
            F.count(F.lit(1)).alias("n"))
    # 1. a mergeable sketch brackets the two order statistics around every quantile
    sketched = clean.groupBy(*keys).agg(F.kll_sketch_agg_double("_x", F.lit(SKETCH_K)).alias("_s"), F.count(F.lit(1)).alias("n"))

    def end(q: float, move: float) -> Column:
        rank = F.least(F.greatest(F.lit(q) + F.lit(move), F.lit(0.0)), F.lit(1.0))
        return F.kll_sketch_get_quantile_double("_s", rank)

    qs_sorted = sorted(set(qs))
    brackets = cut_lineage(sketched.select(
        *keys, "n", F.array(*[end(q, -BRACKET) for q in qs_sorted]).alias("_lo"),
        F.array(*[end(q, BRACKET) for q in qs_sorted]).alias("_hi")), "brackets")
    # 2. exact counts outside and values inside the brackets, then the order statistics
    edge = F.when((F.col("d") == 0) | (F.col("lo") == F.col("hi")), F.col("lo")) \
        .otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("d"))

    def select(ends: DataFrame) -> DataFrame:
        found = _order_statistics(clean, ends, qs_sorted, keys)
        per_key = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", edge.alias("edge")))).alias("_e"), F.max("n").alias("n"))
        # one small row per key, used several times downstream (binning, grid, shares):
        # materialise it once instead of re-running the selection for every use
        return cut_lineage(per_key.select(*keys, F.array(*[F.try_element_at("_e", F.lit(qs_sorted.index(q))) for q in qs]).alias(out_col), "n"))

    result = select(brackets)
    if result.where(F.exists(out_col, lambda x: x.isNull())).take(1):  # a bracket missed its rank: take all values
        result = select(brackets.withColumns({"_lo": F.transform("_lo", lambda x: F.lit(float("-inf"))),
                                              "_hi": F.transform("_hi", lambda x: F.lit(float("inf")))}))
    return result


SKETCH_K = 2000    # rank error of the sketch about 0.2 %
BRACKET = 0.006    # three times as much on either side; a miss is seen by the exact counts


def _order_statistics(clean: DataFrame, brackets: DataFrame, qs: list[float], keys: list[str]) -> DataFrame:
    """``keys + [i, n, lo, hi, d]``: the values at the ranks around ``qs[i] * (n - 1)`` and the fraction between
    them; lo or hi is NULL where the rank does not lie in its bracket.

    One pass: a row counts in the interval between the brackets' lower ends, and brings its value only if it lies
    inside a bracket (a few per cent of the rows, before equal values are merged)."""
    both = attach(clean, brackets, keys, ["_lo", "_hi"])
    x = F.col("_x")
    below = [F.when(x >= F.try_element_at("_lo", F.lit(j)), 1).otherwise(0) for j in range(1, len(qs) + 1)]
    inside = [(x >= F.try_element_at("_lo", F.lit(j))) & (x <= F.try_element_at("_hi", F.lit(j))) for j in range(1, len(qs) + 1)]
    any_inside = inside[0]
    for c in inside[1:]:
        any_inside = any_inside | c
    counts = cut_lineage(both.select(*keys, sum(below[1:], below[0]).alias("_bin"), F.when(any_inside, x).alias("_v"))
                         .groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_c")), "bracket-counts")
    # rows below each bracket: those of the intervals up to its lower end
    per_bin = counts.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_c")).groupBy(*keys).agg(
        F.collect_list(F.struct("_bin", "_c")).alias("_bins"))  # len(qs) + 1 entries at most
    ends = attach(brackets, per_bin, keys, ["_bins"]) if keys else brackets.withColumn("_bins", per_bin.select("_bins").scalar())
    ends = ends.select(*keys, "n", "_lo", "_hi", "_bins")

    def up_to(i: int) -> Column:
        return F.aggregate("_bins", F.lit(0).cast("long"), lambda a, b: a + F.when(b["_bin"] <= F.lit(i), b["_c"]).otherwise(F.lit(0).cast("long")))

    one = F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(q).alias("q"), F.try_element_at("_lo", F.lit(i + 1)).alias("lo"), F.try_element_at("_hi", F.lit(i + 1)).alias("hi"),
        up_to(i).alias("below")) for i, q in enumerate(qs)])).alias("_b")
    ranks = ends.select(*keys, "n", one).select(*keys, "n", "_b.*").withColumn("_pos", F.col("q") * (F.col("n") - F.lit(1.0)))
    values = attach(counts.where("_v is not null"), ends, keys, ["_lo", "_hi"])
    held = F.explode(F.array_compact(F.array(*[
        F.when((F.col("_v") >= F.try_element_at("_lo", F.lit(i + 1))) & (F.col("_v") <= F.try_element_at("_hi", F.lit(i + 1))), F.lit(i)) for i in range(len(qs))])))
    values = values.select(*keys, held.alias("i"), "_v", "_c").groupBy(*keys, "i", "_v").agg(F.sum("_c").cast("double").alias("_c"))
    ranked = prefix_sum(values, ["_v"], ["_c"], keys=[*keys, "i"], rows=counts.count())  # the stored table's row count
    near = attach(ranked, ranks.select(*keys, "i", "below", "_pos"), [*keys, "i"], ["below", "_pos"])
    first, last = F.col("below") + F.col("_c_cum") - F.col("_c"), F.col("below") + F.col("_c_cum") - F.lit(1.0)
    f_lo, f_hi = F.floor("_pos"), F.ceil("_pos")
    picked = near.groupBy(*keys, "i").agg(
        F.max(F.when((first <= f_lo) & (f_lo <= last), F.col("_v"))).alias("lo"),
        F.max(F.when((first <= f_hi) & (f_hi <= last), F.col("_v"))).alias("hi"))
    out = attach(ranks.select(*keys, "i", "n", (F.col("_pos") - F.floor("_pos")).alias("d")), picked, [*keys, "i"], ["lo", "hi"], "left")
    return out


def bin_of(x, edges, n_inner: int = C.PSI_BUCKETS - 1) -> Column:
    """Half-open bin index: number of inner edges <= x (ties in edges give empty bins).

    Written as ``n_inner`` comparisons (no lambda): stays in generated code and
    accepts edges that come from a scalar subquery.
    """
    xc = F.col(x) if isinstance(x, str) else x
    ec = F.col(edges) if isinstance(edges, str) else edges
    hits = [F.when(xc >= F.try_element_at(ec, F.lit(j)), F.lit(1)).otherwise(F.lit(0)) for j in range(1, n_inner + 1)]
    return sum(hits[1:], hits[0])


def _attach_edges(df: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    return attach(df, edges, keys, ["edges"])


def bucket_histogram(df: DataFrame, value_col: str, edges: DataFrame, keys=None,
                     buckets: int = C.PSI_BUCKETS) -> DataFrame:
    """Share per bin (all bins present, empty ones 0) for one side."""
    keys = _keys(keys)
    clean = df.where(valid_number(value_col)).select(*keys, F.col(value_col).cast("double").alias("_x"))
    binned = _attach_edges(clean, edges, keys).select(*keys, bin_of("_x", "edges").alias("bin"))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    grid = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bin"))
    full = attach(grid, counts, [*keys, "bin"], ["cnt"], "left").fillna(0, subset=["cnt"])
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = F.sum("cnt").over(w)
    return full.select(*keys, "bin", "cnt",
                       F.when(total > 0, F.col("cnt") / total).otherwise(F.lit(0.0)).alias("share"))


def psi_term(e_share: Column, a_share: Column, floor: float = C.PSI_FLOOR) -> Column:
    e = F.when(e_share == 0, F.lit(floor)).otherwise(e_share)
    a = F.when(a_share == 0, F.lit(floor)).otherwise(a_share)
    return (a - e) * F.ln(a / e)


def psi_from_sides(expected: DataFrame, actual: DataFrame, value_col: str, keys=None,
                   buckets: int = C.PSI_BUCKETS, method: str = "exact",
                   edges: DataFrame | None = None) -> DataFrame:
    """Per key: ``psi``, ``n_expected``, ``n_actual``.  Empty side -> psi 0.

    Keys are those of either side.  ``edges`` may be given (computed once
    and reused, e.g. saved as a table).
    """
    keys = _keys(keys)
    edges = edges if edges is not None else quantile_edges(expected, value_col, keys, buckets, method)
    tagged = (expected.select(*keys, F.col(value_col).alias("_x"), F.lit(0).alias("_side"))
              .unionByName(actual.select(*keys, F.col(value_col).alias("_x"), F.lit(1).alias("_side")))
              .where(valid_number("_x")))
    # keys without a baseline have no edges (all their rows fall into bin 0) but get their row
    binned = attach(tagged, edges, keys, ["edges"], "left").select(*keys, "_side", bin_of("_x", "edges").alias("bin"))
    counts = binned.groupBy(*keys, "bin").agg(
        F.count_if(F.col("_side") == 0).alias("e_cnt"),
        F.count_if(F.col("_side") == 1).alias("a_cnt"))
    # a key's bins side by side: one row a key, empty bins are zero
    wide = counts.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("bin") == j, F.col(f"{side}_cnt"))), F.lit(0)).alias(f"_{side}{j}") for side in "ea" for j in range(buckets)],
        F.coalesce(F.sum("e_cnt"), F.lit(0)).alias("n_expected"), F.coalesce(F.sum("a_cnt"), F.lit(0)).alias("n_actual"))

    def share(side: str, n: str, j: int) -> Column:
        return F.when(F.col(n) > 0, F.col(f"_{side}{j}") / F.col(n)).otherwise(F.lit(0.0))

    terms = [psi_term(share("e", "n_expected", j), share("a", "n_actual", j)) for j in range(buckets)]
    return wide.select(*keys,
                       F.when((F.col("n_expected") == 0) | (F.col("n_actual") == 0), F.lit(0.0))
                        .otherwise(sum(terms[1:], terms[0])).alias("psi"),
                       "n_expected", "n_actual")


def psi(df: DataFrame, value_col: str, is_current: Column, keys=None,
        buckets: int = C.PSI_BUCKETS, method: str = "exact") -> DataFrame:
    """PSI of one column between the rows where ``is_current`` is false (baseline)
    and true (current)."""
    return psi_from_sides(df.where(~is_current), df.where(is_current), value_col, keys, buckets, method)


def to_long(df: DataFrame, features: list[str], keys=None, value_name: str = "value") -> DataFrame:
    """Unpivot numeric features to (keys…, feature, value) rows."""
    keys = _keys(keys)
    present = [f for f in features if f in df.columns]
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias(value_name))
        for f in present])).alias("_kv")).select(*keys, "_kv.feature", f"_kv.{value_name}")


def psi_report(baseline: DataFrame, current: DataFrame, features: list[str] | None = None,
               keys=None, buckets: int = C.PSI_BUCKETS, threshold: float = C.PSI_ALERT,
               min_rows: int = C.PSI_MIN_ROWS, method: str = "exact", edges: DataFrame | None = None) -> DataFrame:
    """Mean PSI over the monitored features, alert ``mean > threshold``.  ``edges`` (keys, feature,
    edges) may be given where one baseline serves many calls.

    Features absent from either side or empty on either side are skipped; keys
    whose current side has ``<= min_rows`` rows give no report row.
    """
    keys = _keys(keys)
    features = [f for f in (features or C.MONITORED_FEATURES)
                if f in baseline.columns and f in current.columns]
    per_feature = psi_from_sides(to_long(baseline, features, keys), to_long(current, features, keys),
                                 "value", keys=[*keys, "feature"], buckets=buckets, method=method, edges=edges)
    used = per_feature.where((F.col("n_expected") > 0) & (F.col("n_actual") > 0))
    summary = used.groupBy(*keys).agg(F.avg("psi").alias("psi_mean"),
                                      F.count(F.lit(1)).alias("n_features"))
    n_cur = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_current"))
    if keys:
        rep = attach(n_cur, summary, keys, ["psi_mean", "n_features"], "left")
    else:
        both = summary.select(F.struct("psi_mean", "n_features")).scalar()  # one subquery, not two
        rep = n_cur.select("n_current", both["psi_mean"].alias("psi_mean"), both["n_features"].alias("n_features"))
    rep = rep.where(F.col("n_current") > min_rows).select(
        *keys, "n_current",
        F.coalesce(F.col("psi_mean"), F.lit(0.0)).alias("psi"),
        F.coalesce(F.col("n_features"), F.lit(0)).alias("n_features"))
    return rep.withColumn("alert", F.col("psi") > F.lit(threshold))


def baseline_counts(expected: DataFrame, value_col: str, keys=None, buckets: int = C.PSI_BUCKETS) -> DataFrame:
    """``keys + [edges, e_counts array<long>]``: all that later PSI needs of a baseline; one small row per key."""
    keys = _keys(keys)
    edges = quantile_edges(expected, value_col, keys, buckets)
    rows = expected.where(valid_number(value_col)).select(*keys, F.col(value_col).cast("double").alias("_x"))
    binned = attach(rows, edges, keys, ["edges"]).select(*keys, bin_of("_x", "edges", buckets - 1).alias("_b"))
    counts = binned.groupBy(*keys).agg(F.array(*[F.count_if(F.col("_b") == j) for j in range(buckets)]).alias("e_counts"))
    return attach(edges.select(*keys, "edges"), counts, keys, ["e_counts"])


def psi_against(counted: DataFrame, current: DataFrame, features: list[str] | None = None, threshold: float = C.PSI_ALERT,
                min_rows: int = C.PSI_MIN_ROWS) -> DataFrame:
    """``psi_report`` of ``current`` against a baseline counted before (``baseline_counts`` keyed by feature): the
    same columns, without reading the baseline again."""
    features = [f for f in (features or C.MONITORED_FEATURES) if f in current.columns]
    long = to_long(current, features).where(valid_number("value"))
    binned = attach(long, counted, ["feature"], ["edges"]).select("feature", bin_of("value", "edges").alias("_b"))
    here = binned.groupBy("feature").agg(F.array(*[F.count_if(F.col("_b") == j) for j in range(C.PSI_BUCKETS)]).alias("a_counts"))
    both = attach(here, counted, ["feature"], ["e_counts"])

    def share(counts: str, j: int) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
        return F.try_element_at(counts, F.lit(j + 1)) / total

    terms = [psi_term(share("e_counts", j), share("a_counts", j)) for j in range(C.PSI_BUCKETS)]
    summary = both.select(sum(terms[1:], terms[0]).alias("psi")).agg(F.struct(F.avg("psi").alias("psi"), F.count(F.lit(1)).alias("n")).alias("s"))
    n_cur = current.agg(F.count(F.lit(1)).alias("n_current"))
    return n_cur.withColumn("_s", summary.scalar()).where(F.col("n_current") > min_rows).select(
        "n_current", F.coalesce(F.col("_s.psi"), F.lit(0.0)).alias("psi"), F.coalesce(F.col("_s.n"), F.lit(0)).alias("n_features"),
        (F.coalesce(F.col("_s.psi"), F.lit(0.0)) > F.lit(threshold)).alias("alert"))


def psi_band(c) -> Column:
    """< 0.1 stable, < 0.2 moderate, else significant."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x < 0.1, F.lit("stable")).when(x < 0.2, F.lit("moderate")).otherwise(F.lit("significant"))


def psi_status(c) -> Column:
    """Dashboard label: CRITICAL at >= 0.2, else STABLE."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x >= 0.2, F.lit("CRITICAL")).otherwise(F.lit("STABLE"))


def psi_categorical(df: DataFrame, cat_col: str, is_current: Column, keys=None,
                    floor: float = C.PSI_FLOOR) -> DataFrame:
    """PSI over category shares; categories seen on one side only get share 0."""
    keys = _keys(keys)
    counts = df.where(F.col(cat_col).isNotNull()).groupBy(*keys, F.col(cat_col).alias("category")).agg(
        F.count_if(~is_current).alias("e_cnt"), F.count_if(is_current).alias("a_cnt"))
    counts = cut_lineage(counts, "category-counts")  # read for the totals and the terms
    totals = counts.groupBy(*keys).agg(F.sum("e_cnt").alias("n_e"), F.sum("a_cnt").alias("n_a"))
    counts = attach(counts, totals, keys, ["n_e", "n_a"])
    shares = counts.select(*keys, F.when(F.col("n_e") > 0, F.col("e_cnt") / F.col("n_e")).otherwise(F.lit(0.0)).alias("e"),
                           F.when(F.col("n_a") > 0, F.col("a_cnt") / F.col("n_a")).otherwise(F.lit(0.0)).alias("a"),
                           "n_e", "n_a")
    out = shares.groupBy(*keys).agg(F.sum(psi_term(F.col("e"), F.col("a"), floor)).alias("_psi"),
                                    F.max("n_e").alias("n_expected"), F.max("n_a").alias("n_actual"))
    return out.select(*keys, F.when((F.col("n_expected") == 0) | (F.col("n_actual") == 0), F.lit(0.0))
                      .otherwise(F.col("_psi")).alias("psi"), "n_expected", "n_actual")


def mean_shift(df: DataFrame, value_col: str, is_current: Column, keys=None,
               limit: float = C.MEAN_SHIFT_LIMIT) -> DataFrame:
    """|mean_actual - mean_expected| / (mean_expected + 1e-9) > limit."""
    keys = _keys(keys)
    ok = valid_number(value_col)
    x = F.col(value_col)
    out = df.groupBy(*keys).agg(F.avg(F.when(ok & ~is_current, x)).alias("mean_expected"),
                                F.avg(F.when(ok & is_current, x)).alias("mean_actual"))
    rel = F.abs(F.col("mean_actual") - F.col("mean_expected")) / (F.col("mean_expected") + F.lit(1e-9))
    return out.select(*keys, "mean_expected", "mean_actual", rel.alias("relative_shift"),
                      F.coalesce(rel > F.lit(limit), F.lit(False)).alias("shifted"))


def kolmogorov_sf(z: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided Kolmogorov survival function Q(z) = 2 Σ (-1)^(k-1) e^(-2k²z²).

    The series is summed in ascending k; for z < 0.2 Q is 1 to double precision
    and the series converges too slowly, so 1.0 is returned.
    """
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.lit(2.0) * F.when(F.pmod(k, F.lit(2)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * z * z))
    return F.when(z < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def exact_ks_p(d: float, n: int, m: int) -> float:
    """P(D >= d) of two samples of n and m values from one continuous distribution.

    The pooled order is a lattice path from (0, 0) to (n, m), all equally likely.  Column by column, the share
    of paths that have stayed where |i/n - j/m| < d: a step up keeps the path, a step right thins it by
    i / (i + m).  The gap is compared in whole numbers, |i*m - j*n| < d*n*m."""
    limit = round(d * n * m)
    if limit <= 0:
        return 1.0
    j = np.arange(m + 1, dtype=np.int64)
    alive = np.where(j * n < limit, 1.0, 0.0)
    for i in range(1, n + 1):
        ok = np.abs(i * m - j * n) < limit
        alive = np.where(ok, np.cumsum(np.where(ok, alive * (i / (i + m)), 0.0)), 0.0)
    return float(min(1.0, max(0.0, 1.0 - alive[-1])))


def exact_p_column(d: Column, n: Column, m: Column) -> Column:
    """``exact_ks_p`` of every row; one row per key and n * m steps each."""
    @F.pandas_udf("double")
    def run(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([exact_ks_p(float(x), int(a), int(b)) for x, a, b in zip(d, n, m)], dtype="float64")

    return run(d, n, m)


EXACT_KS_CELLS = 4_000_000   # n * m up to which method="auto" counts lattice paths


def ks_two_sample(df: DataFrame, value_col: str, is_current: Column, keys=None, method: str = "auto") -> DataFrame:
    """Two-sample KS statistic (max CDF gap) and p per key.

    p is exact where n * m is at most ``EXACT_KS_CELLS`` and by the asymptotic series above;
    ``method="exact"`` or ``"asymptotic"`` fixes the choice.  With ties p is that of the statistic under no
    ties, as is usual.

    Counts per distinct value and side, running sums in value order via
    ``prefix_sum`` (no one-task window), gap at every distinct value.  A missing
    current value counts as 0, a missing baseline value is left out.
    """
    keys = _keys(keys)
    x = F.col(value_col).cast("double")
    filled = F.when(is_current & ~valid_number(x), F.lit(0.0)).otherwise(x)
    clean = df.select(*keys, filled.alias("_x"), is_current.alias("_cur")).where(valid_number("_x"))
    counts = clean.groupBy(*keys, "_x").agg(F.count_if(~F.col("_cur")).cast("double").alias("_ca"),
                                            F.count_if(F.col("_cur")).cast("double").alias("_cb"))
    cum = prefix_sum(counts, ["_x"], ["_ca", "_cb"], keys=keys, materialize=True)
    n = cum.groupBy(*keys).agg(F.max("_ca_cum").alias("n_expected"), F.max("_cb_cum").alias("n_actual"))
    cum = attach(cum, n, keys, ["n_expected", "n_actual"])
    gap = F.abs(F.col("_ca_cum") / F.col("n_expected") - F.col("_cb_cum") / F.col("n_actual"))
    stat = cum.where((F.col("n_expected") > 0) & (F.col("n_actual") > 0)).groupBy(*keys).agg(
        F.max(gap).alias("ks_stat"), F.max("n_expected").alias("n_expected"),
        F.max("n_actual").alias("n_actual"))
    en = F.col("n_expected") * F.col("n_actual") / (F.col("n_expected") + F.col("n_actual"))
    series = kolmogorov_sf(F.sqrt(en) * F.col("ks_stat"))
    if method == "asymptotic":
        p = series
    else:
        small = F.lit(True) if method == "exact" else F.col("n_expected") * F.col("n_actual") <= EXACT_KS_CELLS
        stat = cut_lineage(stat, "ks")  # one row a key
        # rows that take the series cost the exact form one step
        one = F.lit(1.0)
        exact = exact_p_column(F.col("ks_stat"), F.when(small, F.col("n_expected")).otherwise(one), F.when(small, F.col("n_actual")).otherwise(one))
        p = F.when(small, exact).otherwise(series)
    return stat.select(*keys, "ks_stat", p.alias("ks_p"),
                       F.col("n_expected").cast("long").alias("n_expected"),
                       F.col("n_actual").cast("long").alias("n_actual"))


def running_peak(df: DataFrame, value_col: str, order_cols: list[str], keys=None,
                 out_col: str = "peak_so_far") -> DataFrame:
    """Highest value so far per key (distributed running max)."""
    out = prefix_sum(df.select(*_keys(keys), *order_cols, value_col), order_cols, [value_col], keys=_keys(keys),
                     how="max", materialize=True)
    return out.withColumnRenamed(value_col + "_cum", out_col)


def first_breach(df: DataFrame, value_col: str, step_col: str, keys=None,
                 threshold: float = C.PSI_ALERT, min_step: int = 0,
                 drift_start: int = C.DRIFT_START) -> DataFrame:
    """First step with value > threshold (from ``min_step``) and latency from drift start."""
    keys = _keys(keys)
    hit = F.when((F.col(value_col) > F.lit(threshold)) & (F.col(step_col) >= F.lit(min_step)), F.col(step_col))
    out = df.groupBy(*keys).agg(F.min(hit).alias("detection_step"), F.max(value_col).alias("peak"))
    return out.withColumn("detection_latency", F.col("detection_step") - F.lit(drift_start))


# ------------------------------------------------------------------ ADWIN

def adwin_first_change(values: np.ndarray, delta: float = DELTA) -> int:
    """Index of the value at which an adaptive window (``operators.adwin``) is first cut, or -1."""
    window = Adwin(delta)
    return next((i for i, v in enumerate(values) if window.add(v)), -1)


def adaptive_window(df: DataFrame, value_col: str, order_col: str, keys=None,
                    recent: int = C.MONITOR_RECENT_ROWS, delta: float = 0.002) -> DataFrame:
    """ADWIN change flag per key over its ``recent`` newest rows, oldest first.

    The newest rows per key are chosen by a window rank (bounded output per
    key), so each ``applyInPandas`` group holds at most ``recent`` rows.
    """
    keys = _keys(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc()) if keys else \
        Window.orderBy(F.col(order_col).desc())
    newest = (df.where(valid_number(value_col))
              .select(*keys, order_col, F.col(value_col).cast("double").alias("_v"))
              .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= recent))
    group_keys = keys or []
    schema = T.StructType(
        [f for f in newest.schema.fields if f.name in group_keys] +
        [T.StructField("n_rows", T.LongType()), T.StructField("change_index", T.LongType()),
         T.StructField("adwin_change", T.BooleanType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col)
        idx = adwin_first_change(pdf["_v"].to_numpy(dtype="float64"), delta=delta)
        row = {k: [pdf[k].iloc[0]] for k in group_keys}
        row.update(n_rows=[len(pdf)], change_index=[idx if idx >= 0 else None], adwin_change=[idx >= 0])
        return pd.DataFrame(row)

    grouped = newest.groupBy(*group_keys) if group_keys else newest.groupBy(F.lit(0).alias("_g"))
    if not group_keys:
        return newest.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(
            lambda pdf: run(pdf), schema)
    return grouped.applyInPandas(run, schema)
