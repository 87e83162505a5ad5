"""Registered queries: drift statistics on the bound test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import round_places

from vigil import config as C
from vigil.operators import drift as D
from vigil.plans.psi_sql import long_union, psi_ctes
from vigil.plans.registry import query
from vigil.plans.sqlbind import EVT, TXN, with_ctes
from vigil.sources.tables import stream_events, transactions

FEATS = C.MONITORED_FEATURES
R6 = 6


def r6(c):
    return round_places(c, R6)


# ---------------------------------------------------------------- quantile_edges
QS = ", ".join(str(i / 10) for i in range(1, 10))


@query("quantile_edges", sql=with_ctes(TXN, f"""lng AS ({long_union('txn', FEATS, [])}),
e AS (SELECT feature, quantile_cont(value, [{QS}]) AS edges FROM lng
      WHERE NOT is_current AND value IS NOT NULL AND NOT isnan(value) GROUP BY feature)""") + """
SELECT feature, CAST(i AS INTEGER) AS edge_index, round(edges[i], 6) AS edge
FROM e, range(1, 10) t(i)""")
def q_quantile_edges(spark, sf):
    t = transactions(spark, sf)
    long = D.to_long(t.where(~F.col("is_current")), FEATS)
    edges = D.quantile_edges(long, "value", keys=["feature"])
    return edges.select("feature", F.posexplode("edges").alias("pos", "edge")).select(
        "feature", (F.col("pos") + 1).cast("int").alias("edge_index"), r6("edge").alias("edge"))


# ---------------------------------------------------------------- bucket_histogram
@query("bucket_histogram", sql=with_ctes(TXN, f"""lng AS ({long_union('txn', FEATS, ['is_current AS cur'])}),
e AS (SELECT feature, quantile_cont(value, [{QS}]) AS edges FROM lng
      WHERE NOT cur AND value IS NOT NULL AND NOT isnan(value) GROUP BY feature),
b AS (SELECT l.feature, len(list_filter(e.edges, lambda x: l.value >= x)) AS bin
      FROM lng l JOIN e USING (feature) WHERE l.cur AND l.value IS NOT NULL AND NOT isnan(l.value)),
g AS (SELECT feature, unnest(range(0, 10)) AS bin FROM e),
c AS (SELECT feature, bin, count(*) AS cnt FROM b GROUP BY ALL),
f AS (SELECT feature, bin, coalesce(cnt, 0) AS cnt FROM g LEFT JOIN c USING (feature, bin))""") + """
SELECT feature, CAST(bin AS INTEGER) AS bin, cnt,
       round(CASE WHEN sum(cnt) OVER (PARTITION BY feature) > 0
                  THEN cnt / sum(cnt) OVER (PARTITION BY feature) ELSE 0.0 END, 6) AS share
FROM f""")
def q_bucket_histogram(spark, sf):
    """Current-period share per baseline-quantile bin, per monitored feature."""
    t = transactions(spark, sf)
    base = D.to_long(t.where(~F.col("is_current")), FEATS)
    cur = D.to_long(t.where(F.col("is_current")), FEATS)
    edges = D.quantile_edges(base, "value", keys=["feature"])
    h = D.bucket_histogram(cur, "value", edges, keys=["feature"])
    return h.select("feature", F.col("bin").cast("int").alias("bin"), "cnt", r6("share").alias("share"))


# ---------------------------------------------------------------- psi (keyed by scenario)
@query("psi", sql=with_ctes(EVT, "src AS (SELECT scenario, price AS value, is_current FROM evt)",
                            psi_ctes("src", ["scenario"])) + """
SELECT scenario, round(psi, 6) AS psi, n_expected, n_actual FROM p_out""")
def q_psi(spark, sf):
    """PSI of the event value, first half of the month vs second half, per event type."""
    ev = stream_events(spark, sf)
    out = D.psi(ev, "price", F.col("is_current"), keys=["scenario"])
    return out.select("scenario", r6("psi").alias("psi"), "n_expected", "n_actual")


# ---------------------------------------------------------------- psi_report (flagship)
PSI_REPORT_SQL = with_ctes(TXN, f"src AS ({long_union('txn', FEATS, [])})",
                           psi_ctes("src", ["feature"])) + f"""
SELECT n_current, round(coalesce(psi, 0.0), 6) AS psi, coalesce(n_features, 0) AS n_features,
       coalesce(psi, 0.0) > {C.PSI_ALERT} AS alert
FROM (SELECT count(*) AS n_current FROM txn WHERE is_current) c,
     (SELECT avg(psi) AS psi, count(*) AS n_features FROM p_out WHERE n_expected > 0 AND n_actual > 0) s
WHERE n_current > {C.PSI_MIN_ROWS}"""


def psi_report_query(spark, sf):
    """Mean PSI over the four monitored transaction features, alert > 0.2."""
    t = transactions(spark, sf)
    rep = D.psi_report(t.where(~F.col("is_current")), t.where(F.col("is_current")), FEATS)
    return rep.select("n_current", r6("psi").alias("psi"), "n_features", "alert")


query("psi_report", sql=PSI_REPORT_SQL)(psi_report_query)


# ---------------------------------------------------------------- psi_band
@query("psi_band", sql=with_ctes(TXN, f"src AS ({long_union('txn', FEATS, [])})",
                                 psi_ctes("src", ["feature"])) + """
SELECT feature, round(psi, 6) AS psi,
       CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'moderate' ELSE 'significant' END AS band,
       CASE WHEN psi >= 0.2 THEN 'CRITICAL' ELSE 'STABLE' END AS status
FROM p_out""")
def q_psi_band(spark, sf):
    t = transactions(spark, sf)
    per = D.psi_from_sides(D.to_long(t.where(~F.col("is_current")), FEATS),
                           D.to_long(t.where(F.col("is_current")), FEATS), "value", keys=["feature"])
    return per.select("feature", r6("psi").alias("psi"), D.psi_band("psi").alias("band"),
                      D.psi_status("psi").alias("status"))


# ---------------------------------------------------------------- psi_categorical
@query("psi_categorical", sql=with_ctes(EVT) + f"""
, c AS (SELECT event_type AS category, count(*) FILTER (WHERE NOT is_current) AS e_cnt,
              count(*) FILTER (WHERE is_current) AS a_cnt FROM evt WHERE event_type IS NOT NULL GROUP BY 1),
s AS (SELECT e_cnt / sum(e_cnt) OVER () AS e, a_cnt / sum(a_cnt) OVER () AS a,
             sum(e_cnt) OVER () AS ne, sum(a_cnt) OVER () AS na FROM c)
SELECT round(CASE WHEN max(ne) = 0 OR max(na) = 0 THEN 0.0 ELSE
       sum((CASE WHEN a = 0 THEN {C.PSI_FLOOR} ELSE a END - CASE WHEN e = 0 THEN {C.PSI_FLOOR} ELSE e END)
           * ln(CASE WHEN a = 0 THEN {C.PSI_FLOOR} ELSE a END / CASE WHEN e = 0 THEN {C.PSI_FLOOR} ELSE e END))
       END, 6) AS psi, max(ne) AS n_expected, max(na) AS n_actual FROM s""")
def q_psi_categorical(spark, sf):
    """PSI of the event-type shares between the two halves of the month."""
    ev = stream_events(spark, sf)
    out = D.psi_categorical(ev, "event_type", F.col("is_current"))
    return out.select(r6("psi").alias("psi"), "n_expected", "n_actual")


# ---------------------------------------------------------------- mean_shift
@query("mean_shift", sql=with_ctes(TXN, f"lng AS ({long_union('txn', FEATS, [])})") + f"""
SELECT feature, round(me, 6) AS mean_expected, round(ma, 6) AS mean_actual,
       round(abs(ma - me) / (me + 1e-9), 6) AS relative_shift,
       coalesce(abs(ma - me) / (me + 1e-9) > {C.MEAN_SHIFT_LIMIT}, false) AS shifted
FROM (SELECT feature, avg(value) FILTER (WHERE NOT is_current) AS me,
             avg(value) FILTER (WHERE is_current) AS ma
      FROM lng WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY feature)""")
def q_mean_shift(spark, sf):
    t = transactions(spark, sf)
    long = D.to_long(t, FEATS, keys=["is_current"])
    out = D.mean_shift(long, "value", F.col("is_current"), keys=["feature"])
    return out.select("feature", r6("mean_expected").alias("mean_expected"),
                      r6("mean_actual").alias("mean_actual"), r6("relative_shift").alias("relative_shift"),
                      "shifted")


# ---------------------------------------------------------------- ks_two_sample
KS_TERMS = 100


@query("ks_two_sample", sql=with_ctes(EVT) + f"""
, c AS (SELECT scenario, price AS x, count(*) FILTER (WHERE NOT is_current) AS ca,
              count(*) FILTER (WHERE is_current) AS cb
       FROM (SELECT scenario, is_current, CASE WHEN is_current AND (price IS NULL OR isnan(price)) THEN 0.0 ELSE price END AS price FROM evt)
       WHERE price IS NOT NULL AND NOT isnan(price) GROUP BY scenario, price),
cum AS (SELECT scenario, sum(ca) OVER w AS ca_cum, sum(cb) OVER w AS cb_cum,
               sum(ca) OVER (PARTITION BY scenario) AS ne, sum(cb) OVER (PARTITION BY scenario) AS na
        FROM c WINDOW w AS (PARTITION BY scenario ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT scenario, max(abs(ca_cum / ne - cb_cum / na)) AS d, max(ne) AS ne, max(na) AS na
      FROM cum WHERE ne > 0 AND na > 0 GROUP BY scenario),
z AS (SELECT scenario, d, ne, na, sqrt(ne * na / (ne + na)) * d AS z FROM s)
SELECT scenario, round(d, 6) AS ks_stat,
       round(CASE WHEN z < 0.2 THEN 1.0 ELSE least(greatest(
         (SELECT sum(2.0 * (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * z * z))
          FROM range(1, {KS_TERMS + 1}) r(k)), 0.0), 1.0) END, 6) AS ks_p,
       CAST(ne AS BIGINT) AS n_expected, CAST(na AS BIGINT) AS n_actual
FROM z""")
def q_ks_two_sample(spark, sf):
    """KS statistic of the event value between the two halves of the month, per event type."""
    ev = stream_events(spark, sf)
    out = D.ks_two_sample(ev, "price", F.col("is_current"), keys=["scenario"], method="asymptotic")  # as the SQL does
    return out.select("scenario", r6("ks_stat").alias("ks_stat"), r6("ks_p").alias("ks_p"),
                      "n_expected", "n_actual")


# ---------------------------------------------------------------- adaptive_window (rows-only)
@query("adaptive_window")
def q_adaptive_window(spark, sf):
    """ADWIN change flag on the newest 200 values of every user's series."""
    ev = stream_events(spark, sf)
    return D.adaptive_window(ev, "price", "step", keys=["user_id"])
