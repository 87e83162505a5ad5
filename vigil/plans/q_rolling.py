"""Registered queries: windows and rolling monitoring plus the
status/trace tables built on the same scored stream (SURVEY §2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import round_places

from vigil import config as C
from vigil.operators import drift as D
from vigil.operators import rolling as R
from vigil.plans import monitoring as MON
from vigil.plans.q_metrics import f1_sql, score_sql, sdiv
from vigil.plans.registry import query
from vigil.plans.sqlbind import STX, TXN, with_ctes
from vigil.sources.tables import stream_transactions, transactions

FEATS = C.MONITORED_FEATURES
REC = MON.RECURRING_SCENARIO
W = C.WINDOW_SIZE
QS = ", ".join(str(i / 10) for i in range(1, 10))


def r6(c):
    return round_places(c, 6)


# ---------------------------------------------------------------- SQL building blocks
def _best_grid(name: str, lo: int, hi: int, out: str) -> str:
    return f"""{name}c AS (SELECT scenario, t, count(*) FILTER (WHERE p >= t AND y = 1) AS tp,
         count(*) FILTER (WHERE p >= t AND y <> 1) AS fp, count(*) FILTER (WHERE y = 1) AS P
       FROM sc JOIN gr ON TRUE WHERE seq >= {lo} AND seq < {hi} GROUP BY scenario, t),
{name} AS (SELECT scenario, CASE WHEN max(f1) > 0 THEN arg_min(t, (-f1, t)) ELSE 0.5 END AS {out}
       FROM (SELECT scenario, t, {f1_sql('tp', 'fp', 'P - tp')} AS f1 FROM {name}c) GROUP BY scenario)"""


STREAM_SQL = with_ctes(STX) + f""", sc AS (
  SELECT event_type AS scenario, step, event_time, {score_sql()} AS p, is_fraud AS y, price, discount_pct,
         session_duration, merchant_risk_score, device_type, is_current,
         CAST(row_number() OVER (PARTITION BY event_type ORDER BY step) - 1 AS BIGINT) AS seq
  FROM stx),
gr AS (SELECT CAST(0.01 AS DOUBLE) + CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE) AS t FROM range(0, 99) r(i)),
{_best_grid('b1', C.DRIFT_START, C.RETRAIN_TRIGGER, 't1')},
{_best_grid('b2', C.SECOND_DRIFT_START, C.SECOND_RETRAIN_TRIGGER, 't2')},
tl AS (SELECT sc.*,
    CASE WHEN scenario = '{REC}' AND seq > {C.SECOND_RETRAIN_TRIGGER} THEN coalesce(t2, 0.5)
         WHEN seq > {C.RETRAIN_TRIGGER} THEN coalesce(t1, 0.5) ELSE 0.5 END AS threshold,
    CASE WHEN scenario = '{REC}' AND seq > {C.SECOND_MODEL_DEPLOYED} THEN 'challenger_v2'
         WHEN seq > {C.MODEL_DEPLOYED} THEN 'challenger' ELSE 'champion' END AS model
  FROM sc LEFT JOIN b1 USING (scenario) LEFT JOIN b2 USING (scenario)),
rc AS (SELECT *, list({{'p': p, 'y': y}}) OVER (PARTITION BY scenario ORDER BY seq
                 ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS win FROM tl),
conf AS (SELECT * EXCLUDE (win),
    CASE WHEN seq >= {W} THEN len(list_filter(win, lambda e: NOT (e.p >= threshold) AND e.y = 0)) ELSE 0 END AS tn,
    CASE WHEN seq >= {W} THEN len(list_filter(win, lambda e: e.p >= threshold AND e.y = 0)) ELSE 0 END AS fp,
    CASE WHEN seq >= {W} THEN len(list_filter(win, lambda e: NOT (e.p >= threshold) AND e.y = 1)) ELSE 0 END AS fn,
    CASE WHEN seq >= {W} THEN len(list_filter(win, lambda e: e.p >= threshold AND e.y = 1)) ELSE 0 END AS tp
  FROM rc),
met AS (SELECT *, {sdiv('tp', 'tp + fp')} AS precision, {sdiv('tp', 'tp + fn')} AS recall,
               {f1_sql('tp', 'fp', 'fn')} AS f1 FROM conf),
base AS (SELECT * FROM sc WHERE NOT is_current),
ed AS (SELECT {', '.join(f"quantile_cont({f}, [{QS}]) FILTER (WHERE {f} IS NOT NULL AND NOT isnan({f})) AS e_{f}" for f in FEATS)} FROM base),
bb AS (SELECT {', '.join(f"CASE WHEN {f} IS NOT NULL AND NOT isnan({f}) THEN len(list_filter(ed.e_{f}, lambda x: base.{f} >= x)) END AS b_{f}" for f in FEATS)}
       FROM base, ed),
sh AS (SELECT {', '.join("[" + ", ".join(f"count(*) FILTER (WHERE b_{f} = {b}) / count(b_{f})" for b in range(10)) + f"] AS s_{f}" for f in FEATS)} FROM bb),
rb AS (SELECT met.*, {', '.join(f"CASE WHEN met.{f} IS NOT NULL AND NOT isnan(met.{f}) THEN len(list_filter(ed.e_{f}, lambda x: met.{f} >= x)) END AS b_{f}" for f in FEATS)}
       FROM met, ed),
rw AS (SELECT *, {', '.join(f"count(*) FILTER (WHERE b_{f} = {b}) OVER w AS n_{f}_{b}" for f in FEATS for b in range(10))}
       FROM rb WINDOW w AS (PARTITION BY scenario ORDER BY seq ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)),
"""


def _psi_feature_sql(f: str) -> str:
    n = " + ".join(f"n_{f}_{b}" for b in range(10))
    terms = []
    for b in range(10):
        a = f"(CASE WHEN n_{f}_{b} / ({n}) = 0 THEN {C.PSI_FLOOR} ELSE n_{f}_{b} / ({n}) END)"
        e = f"(CASE WHEN sh.s_{f}[{b + 1}] = 0 THEN {C.PSI_FLOOR} ELSE sh.s_{f}[{b + 1}] END)"
        terms.append(f"({a} - {e}) * ln({a} / {e})")
    return f"(CASE WHEN ({n}) > 0 THEN {' + '.join(terms)} ELSE 0.0 END)"


STREAM_SQL += f"""rp AS (SELECT rw.*, CASE WHEN seq >= {W} THEN ({' + '.join(_psi_feature_sql(f) for f in FEATS)}) / {float(len(FEATS))}
               ELSE 0.0 END AS psi FROM rw, sh),
sm AS (SELECT *, avg(f1) OVER (PARTITION BY scenario ORDER BY seq ROWS BETWEEN {C.SMOOTH_WINDOW - 1} PRECEDING AND CURRENT ROW)
               AS f1_smooth FROM rp)
"""


# ---------------------------------------------------------------- model_timeline
@query("model_timeline", sql=STREAM_SQL + "SELECT scenario, seq, round(threshold, 6) AS threshold, model FROM tl")
def q_model_timeline(spark, sf):
    """Threshold and model live at each step: changes act from the next step."""
    tl = MON.with_timeline(MON.scored_stream(spark, sf))
    return tl.select("scenario", "seq", r6("threshold").alias("threshold"), "model")


@query("rolling_confusion", sql=STREAM_SQL + "SELECT scenario, seq, tn, fp, fn, tp FROM conf")
def q_rolling_confusion(spark, sf):
    """Confusion over the last 50 rows at the row's own threshold (zeros before step 50)."""
    tl = MON.with_timeline(MON.scored_stream(spark, sf))
    conf = R.rolling_confusion(tl, "p", "y", "threshold", step="seq", keys=["scenario"])
    return conf.select("scenario", "seq", "tn", "fp", "fn", "tp")


@query("rolling_metrics", sql=STREAM_SQL + """SELECT scenario, seq, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM met""")
def q_rolling_metrics(spark, sf):
    tl = MON.with_timeline(MON.scored_stream(spark, sf))
    met = R.rolling_metrics(R.rolling_confusion(tl, "p", "y", "threshold", step="seq", keys=["scenario"]))
    return met.select("scenario", "seq", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("rolling_psi", sql=STREAM_SQL + "SELECT scenario, seq, round(psi, 6) AS psi FROM rp")
def q_rolling_psi(spark, sf):
    """Mean PSI of four features over the last 50 rows vs the first half of the month."""
    s = MON.scored_stream(spark, sf)
    out = R.rolling_psi(s, s.where(~F.col("is_current")), FEATS, step="seq", keys=["scenario"])
    return out.select("scenario", "seq", r6("psi").alias("psi"))


@query("smooth", sql=STREAM_SQL + "SELECT scenario, seq, round(f1_smooth, 6) AS f1_smooth FROM sm")
def q_smooth(spark, sf):
    """Trailing 15-step mean of the rolling F1."""
    frame = MON.rolling_frame(spark, sf)
    return R.smooth(frame, "f1", step="seq", keys=["scenario"]).select(
        "scenario", "seq", r6("f1_smooth").alias("f1_smooth"))


@query("running_peak", sql=STREAM_SQL + """SELECT scenario, seq, round(max(psi) OVER (PARTITION BY scenario ORDER BY seq
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS peak_so_far FROM rp""")
def q_running_peak(spark, sf):
    """Highest rolling PSI so far in every scenario (distributed running max)."""
    frame = MON.rolling_frame(spark, sf).select("scenario", "seq", "psi")
    out = D.running_peak(frame, "psi", ["seq"], keys=["scenario"])
    return out.select("scenario", "seq", r6("peak_so_far").alias("peak_so_far"))


@query("first_breach", sql=STREAM_SQL + f"""SELECT scenario,
       min(seq) FILTER (WHERE psi > {C.PSI_ALERT} AND seq >= {C.DRIFT_START}) AS detection_step,
       round(max(psi), 6) AS peak,
       min(seq) FILTER (WHERE psi > {C.PSI_ALERT} AND seq >= {C.DRIFT_START}) - {C.DRIFT_START} AS detection_latency
FROM rp GROUP BY scenario""")
def q_first_breach(spark, sf):
    """First step after drift start with rolling PSI > 0.2: detection measured, not fixed."""
    frame = MON.rolling_frame(spark, sf)
    out = D.first_breach(frame, "psi", "seq", keys=["scenario"], min_step=C.DRIFT_START)
    return out.select("scenario", "detection_step", r6("peak").alias("peak"), "detection_latency")


STAGED_SQL = f""", det AS (SELECT scenario, min(seq) FILTER (WHERE psi > {C.PSI_ALERT} AND seq >= {W}) AS detected FROM rp GROUP BY scenario),
sg AS (SELECT rp.*, detected, CASE WHEN seq < {W} THEN 'Warm-up' WHEN detected IS NULL OR seq < detected THEN 'Monitoring'
         WHEN seq = detected THEN 'Drift Detected' WHEN psi > {C.PSI_ALERT} THEN 'Drift Active' ELSE 'Recovered' END AS stage
       FROM rp JOIN det USING (scenario))"""


@query("stage_of_step", sql=STREAM_SQL + STAGED_SQL + "SELECT scenario, seq, stage FROM sg")
def q_stage_of_step(spark, sf):
    """The measured stage of every row."""
    frame = R.with_detection(MON.rolling_frame(spark, sf).select("scenario", "seq", "psi"), "seq", "psi", ["scenario"])
    return frame.select("scenario", "seq", R.stage_of_step("seq").alias("stage"))


STAGE_LIST = ", ".join(f"'{s}'" for s in C.STAGES)


@query("stage_progress", sql=STREAM_SQL + STAGED_SQL + f""", last AS (SELECT scenario, arg_max(stage, seq) AS cur FROM sg GROUP BY scenario),
ord AS (SELECT unnest([{STAGE_LIST}]) AS stage, unnest(range(1, {len(C.STAGES) + 1})) AS pos)
SELECT scenario, stage, CASE WHEN pos < list_position([{STAGE_LIST}], cur) THEN 'done'
       WHEN pos = list_position([{STAGE_LIST}], cur) THEN 'active' ELSE 'future' END AS state
FROM last, ord""")
def q_stage_progress(spark, sf):
    """Done / active / future per stage at each scenario's latest step."""
    frame = R.with_detection(MON.rolling_frame(spark, sf).select("scenario", "seq", "psi"), "seq", "psi", ["scenario"])
    cur = frame.groupBy("scenario").agg(F.max_by(R.stage_of_step("seq"), "seq").alias("stage"))
    return cur.select("scenario", F.explode(R.stage_progress("stage")).alias("s")).select(
        "scenario", F.col("s.stage").alias("stage"), F.col("s.state").alias("state"))


RECOVERY_SQL = f"""rec AS (SELECT scenario,
    coalesce(avg(f1_smooth) FILTER (WHERE seq >= {W} AND seq < {C.DRIFT_START}), 0.0) AS f1_before_drift,
    coalesce(min(f1_smooth) FILTER (WHERE seq >= {C.DRIFT_START} AND seq < {C.MODEL_DEPLOYED}), 0.0) AS lowest_f1,
    coalesce(avg(f1_smooth) FILTER (WHERE seq >= CASE WHEN scenario = '{REC}' THEN {C.SECOND_MODEL_DEPLOYED + 30}
                                               ELSE {C.MODEL_DEPLOYED + 50} END), 0.0) AS f1_after_recovery
  FROM sm GROUP BY scenario),
recs AS (SELECT *, f1_after_recovery - lowest_f1 AS absolute_recovery,
         (f1_after_recovery - lowest_f1) / greatest(1e-4, lowest_f1) * 100.0 AS relative_recovery FROM rec)"""


@query("recovery_stats", sql=STREAM_SQL + ", " + RECOVERY_SQL + """
SELECT scenario, round(f1_before_drift, 6) AS f1_before_drift, round(lowest_f1, 6) AS lowest_f1,
       round(f1_after_recovery, 6) AS f1_after_recovery, round(absolute_recovery, 6) AS absolute_recovery,
       round(relative_recovery, 6) AS relative_recovery FROM recs""")
def q_recovery_stats(spark, sf):
    frame = R.smooth(MON.rolling_frame(spark, sf), "f1", step="seq", keys=["scenario"])
    st = R.recovery_stats(frame, "f1_smooth", step="seq", keys=["scenario"], recurring=F.col("scenario") == REC)
    return st.select("scenario", *[r6(c).alias(c) for c in ("f1_before_drift", "lowest_f1", "f1_after_recovery",
                                                            "absolute_recovery", "relative_recovery")])


CHALL_SQL = f"""dr AS (SELECT * FROM rp WHERE seq >= {C.DRIFT_START}),
dcnt AS (SELECT scenario, p AS s, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos,
                CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) AS neg FROM dr GROUP BY ALL),
dcum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY scenario) AS P,
                sum(neg) OVER (PARTITION BY scenario) AS N
         FROM dcnt WINDOW w AS (PARTITION BY scenario ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dfs AS (SELECT scenario, max({f1_sql('tp', 'fp', 'P - tp')}) AS f1_scores,
               sum(pos * ((N - fp) + 0.5 * neg)) / (max(P) * max(N)) AS auc FROM dcum GROUP BY scenario),
dfx AS (SELECT scenario, greatest({', '.join(f1_sql(f'count(*) FILTER (WHERE p >= {t} AND y = 1)', f'count(*) FILTER (WHERE p >= {t} AND y <> 1)', f'count(*) FILTER (WHERE y = 1) - count(*) FILTER (WHERE p >= {t} AND y = 1)') for t in ('0.0', '0.5', '1.0'))}) AS f1_fixed,
               count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y <> 1) AS N FROM dr GROUP BY scenario),
chall AS (SELECT scenario, CASE WHEN P = 0 OR N = 0 THEN 0.0 ELSE greatest(f1_fixed, f1_scores) END AS chall_f1,
                 CASE WHEN P = 0 OR N = 0 THEN 0.5 ELSE auc END AS chall_auc FROM dfx LEFT JOIN dfs USING (scenario)),
cs AS (SELECT scenario, seq, floor(abs(sum(price) OVER w - count(price) OVER w * avg(price) OVER (PARTITION BY scenario)) * 1e6 + 0.5) / 1e6 AS d
       FROM rp WHERE price IS NOT NULL AND NOT isnan(price)
       WINDOW w AS (PARTITION BY scenario ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cp AS (SELECT scenario, CASE WHEN max(d) > 0 THEN arg_min(seq, (-d, seq)) + 1 END AS injected FROM cs GROUP BY scenario),
det AS (SELECT rp.scenario, max(injected) AS injected, min(seq) FILTER (WHERE psi > {C.PSI_ALERT} AND seq >= greatest(injected, {W})) AS detection_step,
               max(psi) AS peak_psi, min(seq) FILTER (WHERE threshold <> 0.5) AS retuned, min(seq) FILTER (WHERE model <> 'champion') AS deployed,
               count(DISTINCT model) - 1 AS cycles
        FROM rp LEFT JOIN cp USING (scenario) GROUP BY rp.scenario),
stats AS (SELECT scenario, injected AS drift_injection_time, detection_step AS drift_detection_time,
       detection_step - injected AS detection_latency, peak_psi, cycles AS retraining_cycles, deployed - retuned AS retraining_duration,
       deployed AS model_deployment_time, chall_f1, chall_auc, f1_before_drift, lowest_f1,
       f1_after_recovery, absolute_recovery, relative_recovery, injected AS drift_step, detection_step,
       deployed AS deployment_step, deployed - retuned AS retraining_time
  FROM recs JOIN det USING (scenario) LEFT JOIN chall USING (scenario))"""

STAT_DOUBLES = ["peak_psi", "chall_f1", "chall_auc", "f1_before_drift", "lowest_f1", "f1_after_recovery",
                "absolute_recovery", "relative_recovery"]
STAT_COLS = ["scenario", "drift_injection_time", "drift_detection_time", "detection_latency", "peak_psi",
             "retraining_cycles", "retraining_duration", "model_deployment_time", "chall_f1", "chall_auc",
             "f1_before_drift", "lowest_f1", "f1_after_recovery", "absolute_recovery", "relative_recovery",
             "drift_step", "detection_step", "deployment_step", "retraining_time"]


def _stats_select_sql() -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in STAT_DOUBLES else c for c in STAT_COLS)


@query("scenario_stats", sql=STREAM_SQL + ", " + RECOVERY_SQL + ", " + CHALL_SQL + f"""
SELECT {_stats_select_sql()} FROM stats""")
def q_scenario_stats(spark, sf):
    """The 19 benchmark statistics per scenario, all five scenarios in one Spark job graph."""
    st = MON.scenario_stats(spark, sf)
    return st.select(*[(r6(c) if c in STAT_DOUBLES else F.col(c)).alias(c) for c in STAT_COLS])


# report projection with display names (fixed values: the report's column titles)
DISPLAY = [("scenario", "Scenario Name"), ("drift_injection_time", "Drift Injected Step"),
           ("drift_detection_time", "Drift Detected Step"), ("detection_latency", "Latency (Events)"),
           ("peak_psi", "Peak PSI"), ("f1_before_drift", "F1 Before"), ("lowest_f1", "Lowest F1"),
           ("f1_after_recovery", "F1 Recovered"), ("relative_recovery", "Relative F1 Recovery (%)"),
           ("retraining_time", "Retrain Time (s)")]


@query("scenario_table", sql=STREAM_SQL + ", " + RECOVERY_SQL + ", " + CHALL_SQL + " SELECT " + ", ".join(
    (f'round({c}, 6) AS "{d}"' if c in STAT_DOUBLES else f'{c} AS "{d}"') for c, d in DISPLAY) + " FROM stats")
def q_scenario_table(spark, sf):
    st = MON.scenario_stats(spark, sf)
    return st.select(*[(r6(c) if c in STAT_DOUBLES else F.col(c)).alias(d) for c, d in DISPLAY])


@query("profile_uniqueness", sql=STREAM_SQL + ", " + RECOVERY_SQL + """
SELECT count(DISTINCT floor(f1_after_recovery * 1000.0 + 0.5) / 1000.0) AS distinct_profiles,
       count(DISTINCT scenario) AS scenarios,
       count(DISTINCT floor(f1_after_recovery * 1000.0 + 0.5) / 1000.0) < count(DISTINCT scenario) AS warning
FROM recs""")
def q_profile_uniqueness(spark, sf):
    frame = R.smooth(MON.rolling_frame(spark, sf), "f1", step="seq", keys=["scenario"])
    st = R.recovery_stats(frame, "f1_smooth", step="seq", keys=["scenario"], recurring=F.col("scenario") == REC)
    return R.profile_uniqueness(st)


# ---------------------------------------------------------------- rank_pct / pseudo_label
@query("rank_pct", sql=with_ctes(TXN) + """
SELECT order_key, line_number, round((rank() OVER (PARTITION BY event_type ORDER BY price)
         + (count(*) OVER (PARTITION BY event_type, price) - 1) / 2.0) / count(*) OVER (PARTITION BY event_type), 6)
       AS price_rank_pct
FROM txn""")
def q_rank_pct(spark, sf):
    """pandas-style percent rank (ties averaged) of the price within each event type."""
    t = transactions(spark, sf).select("order_key", "line_number", "event_type", "price")
    out = R.rank_pct(t, "price", keys=["event_type"], out_col="price_rank_pct")
    return out.select("order_key", "line_number", r6("price_rank_pct").alias("price_rank_pct"))


def _pseudo_sql() -> str:
    terms = []
    for f, w in C.PSEUDO_LABEL_WEIGHTS.items():
        v = f"coalesce(TRY_CAST({f} AS DOUBLE), 0.0)"
        rk = (f"((rank() OVER (PARTITION BY scenario ORDER BY {v}) + (count(*) OVER (PARTITION BY scenario, {v}) - 1) / 2.0)"
              f" / count(*) OVER (PARTITION BY scenario))")
        terms.append(f"{rk} * {w}")
    biases = [f"CAST(coalesce(lower(CAST({c} AS VARCHAR)) IN ({', '.join(repr(v) for v in vals)}), false) AS DOUBLE) * {w}"
              for c, vals, w in C.PSEUDO_LABEL_BIASES]
    score = "0.0 + " + " + ".join(terms + biases)
    return with_ctes(STX) + f""", src AS (SELECT *, event_type AS scenario FROM stx),
fs AS (SELECT step, scenario, is_fraud, {score} AS fallback_score FROM src),
md AS (SELECT scenario, quantile_cont(fallback_score, 0.5) AS med, count(DISTINCT coalesce(is_fraud, 0)) AS classes
       FROM fs GROUP BY scenario)
SELECT step, scenario, round(fallback_score, 6) AS fallback_score,
       CAST(fallback_score >= med AS INTEGER) AS pseudo_label,
       CASE WHEN classes < 2 THEN CAST(fallback_score >= med AS INTEGER) ELSE CAST(coalesce(is_fraud, 0) AS INTEGER) END
         AS label_used
FROM fs JOIN md USING (scenario)"""


@query("pseudo_label", sql=_pseudo_sql())
def q_pseudo_label(spark, sf):
    """Rank-based fallback labels per scenario (used where a scenario has one class)."""
    s = stream_transactions(spark, sf).withColumn("scenario", F.col("event_type"))
    out = R.pseudo_label(s, keys=["scenario"], label="is_fraud")
    return out.select("step", "scenario", r6("fallback_score").alias("fallback_score"), "pseudo_label", "label_used")


# ---------------------------------------------------------------- live_status / event_trace (§2.7)
@query("live_status", sql=STREAM_SQL + STAGED_SQL + """, lst AS (
  SELECT scenario, arg_max(struct_pack(seq := seq, psi := psi, f1 := f1, model := model, detected := detected, stage := stage), seq) AS s
  FROM sg GROUP BY scenario)
SELECT scenario, s.seq AS step, round(s.psi, 6) AS psi, round(s.f1, 6) AS f1, s.model AS active_model, s.stage AS stage,
       s.detected AS detected_step, CASE WHEN s.detected IS NOT NULL THEN 'Detected' ELSE 'Monitoring' END AS detection_status,
       CASE WHEN s.model <> 'champion' THEN 'Deployed' ELSE 'Champion Active' END AS deployment_status,
       CASE WHEN s.psi >= 0.2 THEN 'CRITICAL' ELSE 'STABLE' END AS drift_status
FROM lst""")
def q_live_status(spark, sf):
    """Latest step's state per scenario with status labels."""
    from vigil.operators.jobs import live_status
    out = live_status(MON.rolling_frame(spark, sf), keys=["scenario"], step="seq")
    return out.withColumn("psi", r6("psi")).withColumn("f1", r6("f1"))


REASON_SQL = "CASE stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.STAGES.items()) + " END"


@query("event_trace", sql=STREAM_SQL + STAGED_SQL + f""", st AS (SELECT sg.scenario, sg.seq, sc.event_time, stage,
       lag(stage) OVER (PARTITION BY sg.scenario ORDER BY sg.seq) AS prev FROM sg JOIN sc ON sg.scenario = sc.scenario AND sg.seq = sc.seq)
SELECT scenario, seq, stage, strftime(event_time, '%H:%M:%S') || ' | monitor | ' || stage || ' | step=' || seq || ' | ' ||
       {REASON_SQL} AS line
FROM st WHERE seq = 0 OR prev <> stage""")
def q_event_trace(spark, sf):
    """Chronological trace lines at every stage change, with the reason by stage."""
    from vigil.operators.jobs import event_trace
    return event_trace(MON.rolling_frame(spark, sf), keys=["scenario"], step="seq", time_col="event_time")
