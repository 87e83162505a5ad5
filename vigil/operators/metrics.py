"""Classifier evaluation as aggregations.

Scores ``p`` and 0/1 labels ``y``; optional grouping ``keys`` (model,
scenario …).  Curves are built from counts per distinct score and running
totals from ``prefix_sum`` (no single-task window over all scores); every
PR-AUC trapezoid is computed from its own row (the previous point is the
running total minus the row's own counts), so no ``lag`` is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.sequence import attach, prefix_sum
from vigil.session import cut_lineage

# numpy.arange(0.01, 1.0, 0.01) fills start + i * step: the same doubles
GRID = [0.01 + i * 0.01 for i in range(99)]


def _keys(keys) -> list[str]:
    return list(keys or [])


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 when b == 0 (ANSI mode raises on division by zero)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def f1_expr(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_div(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)


def confusion(df: DataFrame, score: str, label: str, threshold=0.5, keys=None) -> DataFrame:
    """tn, fp, fn, tp at ``p >= threshold`` (threshold may be a column)."""
    keys = _keys(keys)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.count_if(~pred & ~y).alias("tn"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"), F.count_if(pred & y).alias("tp"))


def with_class_metrics(conf: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1 from tn/fp/fn/tp; 0 when a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return conf.withColumns({
        "accuracy": safe_div(tp + tn, tp + tn + fp + fn),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": f1_expr(tp, fp, fn),
    })


def class_metrics(df: DataFrame, score: str, label: str, threshold=0.5, keys=None) -> DataFrame:
    return with_class_metrics(confusion(df, score, label, threshold, keys))


def score_counts(df: DataFrame, score: str, label: str, keys=None) -> DataFrame:
    """(keys…, s, pos, neg) per distinct score — partial aggregation before the shuffle.

    NULL scores form a group with zero counts instead of being filtered: a filter
    on a derived score would be pushed below its projection and copy the whole
    score expression into the scan.
    """
    keys = _keys(keys)
    ok = F.col(score).isNotNull()
    y = F.col(label) == 1
    return df.groupBy(*keys, F.col(score).cast("double").alias("s")).agg(
        F.count_if(ok & y).cast("double").alias("pos"), F.count_if(ok & ~y).cast("double").alias("neg"))


def _totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def _attach(df: DataFrame, small: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return attach(df, small, keys, cols)


def stored_counts(df: DataFrame, score: str, label: str, keys=None) -> DataFrame:
    """``score_counts`` written once: whatever is asked of the scores afterwards reads these, not the rows."""
    return cut_lineage(score_counts(df, score, label, keys).withColumn("_neg_s", -F.col("s")), "score-counts")


def cumulative_from_top(df: DataFrame, score: str, label: str, keys=None) -> DataFrame:
    """Per distinct score s: tp / fp of ``p >= s`` plus class totals P, N."""
    return _running(stored_counts(df, score, label, keys), _keys(keys))


def _running(counts: DataFrame, keys: list[str]) -> DataFrame:
    cum = prefix_sum(counts, ["_neg_s"], ["pos", "neg"], keys=keys)
    cum = cum.withColumnRenamed("pos_cum", "tp").withColumnRenamed("neg_cum", "fp").drop("_neg_s")
    totals = _totals(counts, keys)  # whole numbers: not worth sorting all scores a second time
    cum = cum.where(F.col("s").isNotNull())  # after the checkpoint barrier: nothing to push down
    return _attach(cum, totals, keys, ["P", "N"])


def roc_auc(df: DataFrame, score: str, label: str, keys=None) -> DataFrame:
    """Area under ROC with ties averaged (Mann–Whitney); NULL for one class."""
    keys = _keys(keys)
    cum = cumulative_from_top(df, score, label, keys)
    # negatives strictly below s = N - fp(>= s)
    below = F.col("N") - F.col("fp")
    part = F.col("pos") * (below + F.lit(0.5) * F.col("neg"))
    out = cum.groupBy(*keys).agg(F.sum(part).alias("_u"), F.max("P").alias("P"), F.max("N").alias("N"))
    return out.select(*keys, F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(None).cast("double"))
                      .otherwise(F.col("_u") / (F.col("P") * F.col("N"))).alias("roc_auc"),
                      F.col("P").cast("long").alias("positives"), F.col("N").cast("long").alias("negatives"))


def roc_curve(df: DataFrame, score: str, label: str, keys=None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score plus the (0, 0) start (threshold NULL)."""
    keys = _keys(keys)
    cum = cumulative_from_top(df, score, label, keys)
    pts = cum.select(*keys, F.col("s").alias("threshold"),
                     safe_div(F.col("fp"), F.col("N")).alias("fpr"), safe_div(F.col("tp"), F.col("P")).alias("tpr"))
    start = cum.select(*keys).distinct() if keys else cum.limit(1).select()
    start = start.select(*keys, F.lit(None).cast("double").alias("threshold"),
                         F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_curve(df: DataFrame, score: str, label: str, keys=None) -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the end point (recall 0, precision 1)."""
    keys = _keys(keys)
    cum = cumulative_from_top(df, score, label, keys)
    pts = cum.select(*keys, F.col("s").alias("threshold"),
                     safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                     F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("P")).alias("recall"))
    end = cum.select(*keys).distinct() if keys else cum.limit(1).select()
    end = end.select(*keys, F.lit(None).cast("double").alias("threshold"),
                     F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def pr_auc(df: DataFrame, score: str, label: str, keys=None) -> DataFrame:
    """Trapezoid area of the PR curve, starting at (recall 0, precision 1).

    (Spark ML's ``areaUnderPR`` starts at the first precision instead.)
    """
    keys = _keys(keys)
    cum = cumulative_from_top(df, score, label, keys)
    tp, fp, P = F.col("tp"), F.col("fp"), F.col("P")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    r1, p1 = tp / P, safe_div(tp, tp + fp)
    r0 = tp0 / P
    p0 = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(safe_div(tp0, tp0 + fp0))
    trap = (r1 - r0) * (p1 + p0) / F.lit(2.0)
    out = cum.where(P > 0).groupBy(*keys).agg(F.sum(trap).alias("pr_auc"))
    return out


def grid_point(i: Column) -> Column:
    """The i-th grid threshold, computed with the same double operations as GRID."""
    return F.lit(0.01) + i.cast("double") * F.lit(0.01)


def grid_index(score: str) -> Column:
    """Number of grid thresholds <= p (row is positive at grid point i iff i < index).

    Arithmetic first guess ``floor(100 p) - 2`` (never above the answer), then four
    exact comparisons against the grid doubles — no per-row array scan.
    """
    p = F.col(score)
    base = F.least(F.greatest(F.floor(p * F.lit(100.0)) - F.lit(2), F.lit(0)), F.lit(len(GRID))).cast("int")
    base = F.when(F.isnan(p), F.lit(len(GRID))).otherwise(base)  # NaN is above every number
    idx = base
    for j in range(4):
        cand = base + F.lit(j)
        idx = idx + F.when((cand < F.lit(len(GRID))) & (grid_point(cand) <= p), F.lit(1)).otherwise(F.lit(0))
    return idx


def threshold_curve(df: DataFrame, score: str, label: str, keys=None) -> DataFrame:
    """precision, recall, F1 at thresholds 0.01 … 0.99 from ONE aggregation."""
    keys = _keys(keys)
    ok = F.col(score).isNotNull()
    y = F.col(label) == 1
    counts = df.groupBy(*keys, grid_index(score).alias("g")).agg(
        F.count_if(ok & y).alias("pos"), F.count_if(ok & ~y).alias("neg"))
    # at most 100 rows per key: spread to grid points and sum (g NULL or 0: no points)
    pts = counts.select(*keys, "pos", "neg", F.explode(
        F.when(F.col("g") > 0, F.sequence(F.lit(0), F.col("g") - 1))
         .otherwise(F.array().cast("array<int>"))).alias("i"))
    tot = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = tot.select(*keys, "P", "N", F.posexplode(F.array(*[F.lit(t) for t in GRID])).alias("i", "threshold"))
    at = pts.groupBy(*keys, "i").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    full = attach(grid, at, [*keys, "i"], ["tp", "fp"], "left").fillna(0, subset=["tp", "fp"])
    fn = F.col("P") - F.col("tp")
    return full.select(*keys, "i", "threshold", "tp", "fp", fn.alias("fn"),
                       safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                       safe_div(F.col("tp"), F.col("P")).alias("recall"),
                       f1_expr(F.col("tp"), F.col("fp"), fn).alias("f1"))


def best_threshold_grid(df: DataFrame, score: str, label: str, keys=None) -> DataFrame:
    """Grid argmax of F1; ties -> lowest threshold; 0.5 when every F1 is 0."""
    keys = _keys(keys)
    curve = threshold_curve(df, score, label, keys)
    best = curve.groupBy(*keys).agg(
        F.max("f1").alias("best_f1"),
        F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("_t"))
    return best.select(*keys, F.when(F.col("best_f1") > 0, F.col("_t")).otherwise(F.lit(0.5)).alias("threshold"),
                       "best_f1")


def best_f1_all_thresholds(df: DataFrame, score: str, label: str, keys=None) -> DataFrame:
    """Max F1 over every distinct score and {0, 0.5, 1}; AUC alongside.

    A one-class set gives F1 0 and AUC 0.5.
    """
    keys = _keys(keys)
    counts = stored_counts(df, score, label, keys)
    cum = _running(counts, keys)
    f1_s = f1_expr(F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"))
    part = F.col("pos") * ((F.col("N") - F.col("fp")) + F.lit(0.5) * F.col("neg"))
    at_scores = cum.groupBy(*keys).agg(F.max(f1_s).alias("f1_scores"), F.sum(part).alias("_u"))  # F1 and AUC from the same running counts
    def above(t, of):  # a NULL score is above nothing
        return F.sum(F.when(F.col("s") >= F.lit(t), F.col(of)).otherwise(F.lit(0.0)))

    fixed = counts.groupBy(*keys).agg(
        *[above(t, "pos").alias(f"tp_{i}") for i, t in enumerate((0.0, 0.5, 1.0))],
        *[above(t, "neg").alias(f"fp_{i}") for i, t in enumerate((0.0, 0.5, 1.0))],
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    f_fixed = F.greatest(*[f1_expr(F.col(f"tp_{i}"), F.col(f"fp_{i}"), F.col("P") - F.col(f"tp_{i}"))
                           for i in range(3)])
    fixed = fixed.select(*keys, f_fixed.alias("f1_fixed"), "P", "N")
    if not keys:  # one subquery, not two
        both = at_scores.select(F.struct("f1_scores", "_u")).scalar()
        out = fixed.withColumns({"f1_scores": both["f1_scores"], "_u": both["_u"]})
    else:
        out = attach(fixed, at_scores, keys, ["f1_scores", "_u"], "left")
    one_class = (F.col("P") == 0) | (F.col("N") == 0)
    return out.select(*keys,
                      F.when(one_class, F.lit(0.0)).otherwise(F.greatest("f1_fixed", "f1_scores")).alias("best_f1"),
                      F.when(one_class, F.lit(0.5)).otherwise(F.col("_u") / (F.col("P") * F.col("N"))).alias("roc_auc"))


def class_balance(df: DataFrame, label: str, keys=None) -> DataFrame:
    """negatives / positives (the positive-class weight); NULL without positives."""
    keys = _keys(keys)
    y = F.col(label) == 1
    out = df.groupBy(*keys).agg(F.count_if(~y).alias("negatives"), F.count_if(y).alias("positives"))
    return out.withColumn("scale_pos_weight", F.when(F.col("positives") > 0,
                                                     F.col("negatives") / F.col("positives")))


def fraud_rate(df: DataFrame, label: str, keys=None) -> DataFrame:
    keys = _keys(keys)
    out = df.groupBy(*keys).agg(F.sum(F.col(label).cast("long")).alias("positives"),
                                F.count(F.lit(1)).alias("total"))
    return out.withColumn("rate", safe_div(F.col("positives"), F.col("total")))


def relative_gain(opt, base) -> Column:
    """(opt - base) / max(1e-4, base) * 100."""
    o = F.col(opt) if isinstance(opt, str) else opt
    b = F.col(base) if isinstance(base, str) else base
    return (o - b) / F.greatest(F.lit(1e-4), b) * F.lit(100.0)
