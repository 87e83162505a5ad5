"""Rolling monitoring over long scored series.

A series is identified by ``keys`` (scenario, model …) and ordered by a
dense 0-based ``step``.  Trailing windows run through ``halo_window``: the
series is cut into fixed-size chunks, each carrying a copy of the previous
``n - 1`` rows, so no window partition holds more than one chunk however
large a series (or a hot key) grows.

Timeline changes (threshold / model switches) are carried along the series by
``prefix_sum(how="last")``: a running latest value inside blocks, and the latest
value of the blocks before, so a key may have any number of changes and rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions.numeric import round_places
from vigil.operators.drift import bin_of, quantile_edges, to_long, valid_number
from vigil.operators.metrics import f1_expr, safe_div
from vigil.operators.sequence import attach, halo_window, prefix_sum
from vigil.session import cut_lineage


HOT_VALUES = 1000   # a value with more than this share of the rows is joined by broadcast


def _keys(keys) -> list[str]:
    return list(keys or [])


# ------------------------------------------------------------------ timelines

def model_timeline(df: DataFrame, changes: DataFrame, step: str = "step", keys=None,
                   value_cols: tuple[str, ...] = ("threshold", "model")) -> DataFrame:
    """As-of lookup: the values of the latest change with ``change_step < step``.

    ``changes(keys…, change_step, <value_cols>)``; a change at step s acts from
    s + 1.  Rows before the first change get NULLs (callers coalesce a start
    value, or put a change at step -1).
    """
    keys = _keys(keys)
    here = F.struct(*[F.col(c).alias(f"_row_{c}") for c in df.columns])
    live = F.struct(*[F.col(c) for c in value_cols])
    # at one step the row comes before the change; of changes at one step the greatest values count
    rows = df.select(*keys, F.col(step).cast("double").alias("_at"), F.lit(0).alias("_kind"), here.alias("_row"),
                     F.lit(None).cast(changes.select(live.alias("v")).schema["v"].dataType).alias("_live"))
    moves = changes.select(*keys, F.col("change_step").cast("double").alias("_at"), F.lit(1).alias("_kind"),
                           F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), live.alias("_live"))
    seen = prefix_sum(rows.unionByName(moves), ["_at", "_kind", "_live"], ["_live"], keys=keys, how="last")
    return seen.where("_kind = 0").select(*[F.col(f"_row._row_{c}").alias(c) for c in df.columns],
                                          *[F.col(f"_live_cum.{c}").alias(c) for c in value_cols])


def with_detection(frame: DataFrame, step: str = "step", psi: str = "psi", keys=None, window: int = C.WINDOW_SIZE,
                   threshold: float = C.PSI_ALERT) -> DataFrame:
    """Adds ``detected``: each series' first step with a full window and PSI over the threshold (NULL if none).

    The frame is read for the steps and for the rows, so it is written once; give the columns that are needed."""
    keys = _keys(keys)
    frame = cut_lineage(frame, "detection")
    first = frame.groupBy(*keys).agg(F.min(F.when((F.col(psi) > threshold) & (F.col(step) >= window), F.col(step))).alias("detected"))
    return attach(frame, first, keys, ["detected"], "left")


def stage_of_step(step="step", psi="psi", detected="detected", window: int = C.WINDOW_SIZE,
                  threshold: float = C.PSI_ALERT) -> Column:
    """The measured stage of a row (names of ``config.STAGES``)."""
    s, p, d = (F.col(c) if isinstance(c, str) else c for c in (step, psi, detected))
    return (F.when(s < window, F.lit("Warm-up")).when(d.isNull() | (s < d), F.lit("Monitoring"))
            .when(s == d, F.lit("Drift Detected")).when(p > threshold, F.lit("Drift Active")).otherwise(F.lit("Recovered")))


def stage_progress(stage_col: str = "stage") -> Column:
    """Array of (stage, state) with state done / active / future against the fixed order.

    An unknown stage marks every stage future.
    """
    order = F.array(*[F.lit(s) for s in C.STAGES])
    cur = F.array_position(order, F.col(stage_col))  # 0 when unknown
    state = lambda i: F.when((cur == 0) | (i + 1 > cur), F.lit("future")).when(i + 1 == cur, F.lit("active")).otherwise(F.lit("done"))
    return F.transform(order, lambda s, i: F.struct(s.alias("stage"), state(i).alias("state")))


# ------------------------------------------------------------------ rolling windows

def rolling_confusion(df: DataFrame, score: str, label: str, threshold: str, step: str = "step",
                      keys=None, window: int = C.WINDOW_SIZE, chunk_rows: int = 1 << 14) -> DataFrame:
    """Confusion counts over the last ``window`` rows (incl. current) at the row's own threshold.

    Rows with step < window, and rows without a threshold, get zeros.  The current
    threshold is applied to the whole window, so the window carries its scores, those of
    the positive and of the negative rows; the same for any number of thresholds.  NULL
    scores are in no cell; NaN scores count as positive predictions.
    """
    keys = _keys(keys)
    p, y = F.col(score).cast("double"), F.col(label)

    def build(frame: DataFrame, w: Window) -> DataFrame:
        return frame.withColumns({"_pos": F.collect_list(F.when(y == 1, p)).over(w),
                                  "_neg": F.collect_list(F.when(y == 0, p)).over(w)})

    t = F.col(threshold).cast("double")
    out = halo_window(df, step, window, build, keys=keys, chunk_rows=chunk_rows)
    out = out.withColumns({"_tp": F.size(F.filter("_pos", lambda s: s >= t)), "_fp": F.size(F.filter("_neg", lambda s: s >= t))})
    warm = (F.col(step) >= F.lit(window)) & t.isNotNull()
    cells = {"tn": F.size("_neg") - F.col("_fp"), "fp": F.col("_fp"), "fn": F.size("_pos") - F.col("_tp"), "tp": F.col("_tp")}
    return out.select(*[F.col(c) for c in df.columns],
                      *[F.when(warm, c).otherwise(F.lit(0)).alias(n) for n, c in cells.items()])


def rolling_metrics(conf: DataFrame) -> DataFrame:
    """precision, recall, F1 of each rolling confusion row (0 on zero denominators)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return conf.withColumns({"precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn),
                             "f1": f1_expr(tp, fp, fn)})


def baseline_edges(baseline: DataFrame, features: list[str], buckets: int = C.PSI_BUCKETS,
                   method: str = "exact") -> DataFrame:
    """(feature, edges, shares) of a static baseline: computed once, reused by every window."""
    long = to_long(baseline, features)
    edges = quantile_edges(long, "value", keys=["feature"], buckets=buckets, method=method)
    binned = long.where(valid_number("value")).join(edges.select("feature", "edges"), "feature") \
        .select("feature", bin_of("value", "edges").alias("bin"))
    counts = binned.groupBy("feature").agg(*[F.count_if(F.col("bin") == b).alias(f"c{b}") for b in range(buckets)])
    total = sum((F.col(f"c{b}") for b in range(buckets)), F.lit(0))
    shares = counts.select("feature", F.array(*[F.col(f"c{b}") / total for b in range(buckets)]).alias("shares"))
    # one row per feature: materialise once so every window / subquery reads the same small table
    return cut_lineage(edges.join(shares, "feature"))


def rolling_psi(df: DataFrame, baseline: DataFrame, features: list[str], step: str = "step", keys=None,
                window: int = C.WINDOW_SIZE, buckets: int = C.PSI_BUCKETS, floor: float = C.PSI_FLOOR,
                chunk_rows: int = 1 << 14, edges: DataFrame | None = None) -> DataFrame:
    """Mean PSI of ``features`` over the last ``window`` rows vs a static baseline.

    Rows are binned once against the baseline edges (one small row per
    feature, attached as scalar subqueries); the window then sums one packed bin
    indicator per feature.  Steps < window get 0.  NULL/NaN values are left
    out of their feature's window share (the window length is the valid count).
    """
    keys = _keys(keys)
    edges = edges if edges is not None else baseline_edges(baseline, features, buckets)
    # all features' edges and shares as ONE struct -> one scalar subquery, one column
    row = edges.agg(*[F.max(F.when(F.col("feature") == F.lit(f), F.struct("edges", "shares"))).alias(f)
                      for f in features])
    binned = df.withColumn("_ed", row.select(F.struct(*features)).scalar())
    for f in features:
        binned = binned.withColumn(f"_b_{f}", F.when(valid_number(f), bin_of(
            F.col(f).cast("double"), F.col("_ed")[f]["edges"], buckets - 1)).cast("byte"))
    binned = binned.drop("_ed")  # rows carry their bins through the window; the shares are attached behind it

    # all bin counts of a feature's window fit into few whole numbers: a count needs `bits` bits, so a
    # row adds one bit pattern and the window is one sum per number
    bits = window.bit_length()
    per_word = 63 // bits
    words = -(-buckets // per_word)

    def build(frame: DataFrame, w: Window) -> DataFrame:
        sums = {}
        for f in features:
            b = F.col(f"_b_{f}")
            for k in range(words):
                here = b.between(k * per_word, (k + 1) * per_word - 1)
                one = F.call_function("shiftleft", F.lit(1).cast("long"), ((b - F.lit(k * per_word)) * F.lit(bits)).cast("int"))
                sums[f"_w_{f}_{k}"] = F.sum(F.when(here, one).otherwise(F.lit(0).cast("long"))).over(w)
        return frame.withColumns(sums)

    out = halo_window(binned, step, window, build, keys=keys, chunk_rows=chunk_rows)
    mask = F.lit((1 << bits) - 1).cast("long")
    out = out.withColumns({f"_n_{f}_{b}": F.shiftright(F.col(f"_w_{f}_{b // per_word}"), (b % per_word) * bits).bitwiseAND(mask)
                           for f in features for b in range(buckets)})
    out = out.withColumns({f"_t_{f}": sum((F.col(f"_n_{f}_{b}") for b in range(1, buckets)), F.col(f"_n_{f}_0")) for f in features})
    out = out.withColumn("_sh", row.select(F.struct(*[F.col(f)["shares"].alias(f) for f in features])).scalar())
    per_feature = []
    for f in features:  # plain expressions, no lambdas: they stay in generated code
        terms = []
        for b in range(buckets):
            x, e = F.col(f"_n_{f}_{b}"), F.try_element_at(F.col("_sh")[f], F.lit(b + 1))
            share = F.when(x == 0, F.lit(floor)).otherwise(x / F.col(f"_t_{f}"))
            base = F.when(e == 0, F.lit(floor)).otherwise(e)
            terms.append((share - base) * F.ln(share / base))
        per_feature.append(F.when(F.col(f"_t_{f}") > 0, sum(terms[1:], terms[0])).otherwise(F.lit(0.0)))
    mean = sum(per_feature[1:], per_feature[0]) / F.lit(float(len(features)))
    warm = F.col(step) >= F.lit(window)
    return out.select(*[F.col(c) for c in df.columns],
                      F.when(warm, mean).otherwise(F.lit(0.0)).alias("psi"))


def smooth(df: DataFrame, value_col: str, step: str = "step", keys=None, window: int = C.SMOOTH_WINDOW,
           out_col: str | None = None, chunk_rows: int = 1 << 16) -> DataFrame:
    """Trailing mean over the last ``window`` rows (at least one row)."""
    out_col = out_col or f"{value_col}_smooth"

    def build(frame: DataFrame, w: Window) -> DataFrame:
        return frame.withColumn(out_col, F.avg(value_col).over(w))

    return halo_window(df, step, window, build, keys=_keys(keys), chunk_rows=chunk_rows)


def stage_changes(df: DataFrame, stage_col: str = "stage", step: str = "step", keys=None,
                  chunk_rows: int = 1 << 16) -> DataFrame:
    """Rows whose stage differs from the previous row's (the first row always counts)."""
    def build(frame: DataFrame, w: Window) -> DataFrame:
        return frame.withColumn("_prev", F.first(stage_col).over(w))

    out = halo_window(df, step, 2, build, keys=_keys(keys), chunk_rows=chunk_rows)
    return out.where((F.col(step) == 0) | (F.col("_prev") != F.col(stage_col))).drop("_prev")


# ------------------------------------------------------------------ ranks

def rank_table(df: DataFrame, value: Column, keys=None) -> DataFrame:
    """``keys + [_v, _c, _rank, _salt]``: every distinct value with its count and its average rank / n."""
    keys = _keys(keys)
    v = value.cast("double")
    counts = df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    cum = prefix_sum(counts, ["_v"], ["_c"], keys=keys, materialize=True)
    n = cum.groupBy(*keys).agg(F.max("_c_cum").alias("_n"))
    cum = attach(cum, n, keys, ["_n"])
    # average rank of the tie group: below + (c + 1) / 2
    return cut_lineage(cum.select(*keys, "_v", "_c", ((F.col("_c_cum") - F.col("_c") + (F.col("_c") + F.lit(1.0)) / 2) / F.col("_n")).alias("_rank"),
                                  F.lit(0).alias("_salt")), "ranks")  # the salt is stored: a literal would leave the join


def with_rank(df: DataFrame, value: Column, ranks: DataFrame, out_col: str, keys=None) -> DataFrame:
    """Adds the rank of each row's value.  Values that hold over 1 / HOT_VALUES of all rows, of which there
    are fewer than HOT_VALUES whatever the data, come by a broadcast; their rows are spread over the tasks
    of the join that serves all other values."""
    keys = _keys(keys)
    rows = ranks.agg(F.sum("_c").alias("n")).first()["n"] or 0.0
    hot = ranks.where(F.col("_c") > F.lit(rows / HOT_VALUES)).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_v").alias("_h_v"), F.col("_rank").alias("_h_rank"))
    cold = ranks.where(F.col("_c") <= F.lit(rows / HOT_VALUES)).select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_v").alias("_c_v"), F.col("_rank").alias("_c_rank"), F.col("_salt").alias("_c_salt"))
    named = df.withColumn("_v", value.cast("double"))
    same_hot = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys] + [F.col("_v").eqNullSafe(F.col("_h_v"))]
    salted = named.join(F.broadcast(hot), same_hot, "left").withColumn(
        "_salt", F.when(F.col("_h_rank").isNotNull() | F.col("_v").isNull(), F.lit(1) + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int")).otherwise(F.lit(0)))
    same_cold = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("_v") == F.col("_c_v"), F.col("_salt") == F.col("_c_salt")]
    return salted.join(cold, same_cold, "left").select(*df.columns, F.coalesce("_h_rank", "_c_rank").alias(out_col))


def rank_pct(df: DataFrame, value_col: str, keys=None, out_col: str | None = None) -> DataFrame:
    """Average rank / n with ties averaged (pandas ``rank(pct=True)``); NULLs stay NULL.

    Counts per distinct value + distributed running totals, joined back on the
    value: no window over a whole key, and no task for a hot value (``with_rank``).
    """
    return with_rank(df, F.col(value_col), rank_table(df, F.col(value_col), keys), out_col or f"{value_col}_rank_pct", keys)


def pseudo_label(df: DataFrame, keys=None, label: str = "is_fraud", out_col: str = "label_used") -> DataFrame:
    """Fallback labels for windows with fewer than two classes.

    score = Σ weight · rank_pct(feature) + category biases; label = score >= median.
    Adds ``fallback_score``, ``pseudo_label`` and ``label_used`` (given label when
    the key has two classes, else the pseudo label).
    """
    from vigil.operators.drift import quantiles
    keys = _keys(keys)
    work = df
    score = F.lit(0.0)
    for f, w in C.PSEUDO_LABEL_WEIGHTS.items():
        src = F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0)
        # ranked on the given rows, not on what the joins before have made of them
        work = with_rank(work, src, rank_table(df, src, keys), f"_r_{f}", keys)
        score = score + F.col(f"_r_{f}") * F.lit(w)
    for col, values, w in C.PSEUDO_LABEL_BIASES:
        hit = F.lower(F.col(col).cast("string")).isin(values) if col in df.columns else F.lit(False)
        score = score + F.coalesce(hit, F.lit(False)).cast("double") * F.lit(w)
    work = cut_lineage(work.withColumn("fallback_score", score), "fallback-scores")  # read for the median and the labels
    med = quantiles(work, "fallback_score", [0.5], keys=keys, out_col="_m").select(*keys, F.col("_m")[0].alias("_med"))
    classes = df.groupBy(*keys).agg(F.countDistinct(F.coalesce(F.col(label), F.lit(0))).alias("_classes"))
    work = attach(attach(work, med, keys, ["_med"], "left"), classes, keys, ["_classes"], "left")
    work = work.withColumn("pseudo_label", (F.col("fallback_score") >= F.col("_med")).cast("int"))
    work = work.withColumn(out_col, F.when(F.col("_classes") < 2, F.col("pseudo_label"))
                           .otherwise(F.coalesce(F.col(label), F.lit(0)).cast("int")))
    drop = [c for c in work.columns if c.startswith("_r_")] + ["_med", "_classes"]
    return work.drop(*drop)


# ------------------------------------------------------------------ change points

def change_point(df: DataFrame, value_col: str, step: str = "step", keys=None) -> DataFrame:
    """``keys + [change_step, strength]``: where a series' mean changed, by the cumulated deviation (CUSUM).

    The deviations from the series' mean are summed up in order; the sum is furthest from zero at the last
    value before the change.  ``change_step`` is the step after it, ``strength`` that distance (rounded to
    six places, the earliest step of equal ones).  NULL and NaN values are left out; a series that never
    leaves its mean has no change (NULL).  Running sums in blocks, so a series may be of any length."""
    keys = _keys(keys)
    clean = df.where(valid_number(F.col(value_col).cast("double"))).select(*keys, F.col(step).alias("_s"), F.col(value_col).cast("double").alias("_x"), F.lit(1.0).alias("_one"))
    run = prefix_sum(clean, ["_s"], ["_x", "_one"], keys=keys, materialize=True)
    mean = clean.groupBy(*keys).agg(F.avg("_x").alias("_mean"))
    away = F.col("_x_cum") - F.col("_one_cum") * F.col("_mean")
    far = attach(run, mean, keys, ["_mean"]).select(*keys, "_s", round_places(F.abs(away)).alias("_d"))
    top = far.groupBy(*keys).agg(F.min_by(F.struct("_d", "_s"), F.struct(-F.col("_d"), F.col("_s"))).alias("_t"))
    return top.select(*keys, F.when(F.col("_t._d") > 0, F.col("_t._s") + 1).alias("change_step"), F.col("_t._d").alias("strength"))


# ------------------------------------------------------------------ scenario statistics

def recovery_stats(df: DataFrame, f1_col: str, step: str = "step", keys=None, recurring=None,
                   window: int = C.WINDOW_SIZE, drift_start: int = C.DRIFT_START,
                   deployed: int = C.MODEL_DEPLOYED, second_deployed: int = C.SECOND_MODEL_DEPLOYED) -> DataFrame:
    """Mean F1 in [window, drift), min in [drift, deploy), mean from recovery start;
    absolute and relative recovery.  Recovery starts at deploy + 50, or second deploy
    + 30 for recurring series (``recurring`` is a boolean column or None)."""
    keys = _keys(keys)
    s = F.col(step)
    rec = recurring if recurring is not None else F.lit(False)
    start = F.when(rec, F.lit(second_deployed + 30)).otherwise(F.lit(deployed + 50))
    out = df.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when((s >= window) & (s < drift_start), F.col(f1_col))), F.lit(0.0)).alias("f1_before_drift"),
        F.coalesce(F.min(F.when((s >= drift_start) & (s < deployed), F.col(f1_col))), F.lit(0.0)).alias("lowest_f1"),
        F.coalesce(F.avg(F.when(s >= start, F.col(f1_col))), F.lit(0.0)).alias("f1_after_recovery"))
    absolute = F.col("f1_after_recovery") - F.col("lowest_f1")
    return out.withColumn("absolute_recovery", absolute) \
              .withColumn("relative_recovery", absolute / F.greatest(F.lit(1e-4), F.col("lowest_f1")) * F.lit(100.0))


def profile_uniqueness(stats: DataFrame, f1_col: str = "f1_after_recovery", key: str = "scenario") -> DataFrame:
    """Warn when fewer distinct F1 values (3 places) than scenarios."""
    r3 = F.floor(F.col(f1_col) * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)
    out = stats.agg(F.countDistinct(r3).alias("distinct_profiles"), F.countDistinct(key).alias("scenarios"))
    return out.withColumn("warning", F.col("distinct_profiles") < F.col("scenarios"))
