"""Registered queries: classifier evaluation on scored transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import round_places

from vigil import config as C
from vigil.functions.features import scorecard
from vigil.operators import metrics as M
from vigil.plans.registry import query
from vigil.plans.sqlbind import TXN, with_ctes
from vigil.sources.tables import transactions


def r6(c):
    return round_places(c, 6)


def scored(spark, sf):
    return transactions(spark, sf).withColumn("score", scorecard())


def score_sql() -> str:
    z = f"{C.SCORECARD_INTERCEPT}"
    for expr, w in C.SCORECARD_TERMS:
        z = f"({z} + {w} * coalesce(CAST(({expr}) AS DOUBLE), 0.0))"
    return f"(floor(least(greatest(1.0 / (1.0 + exp(-{z})), 0.01), 0.99) * 10000000000.0 + 0.5) / 10000000000.0)"


SCORED = with_ctes(TXN, f"sc AS (SELECT *, {score_sql()} AS score FROM txn)")


def sdiv(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def f1_sql(tp, fp, fn):
    return sdiv(f"2.0 * {tp}", f"2.0 * {tp} + {fp} + {fn}")


CONF = """count(*) FILTER (WHERE NOT score >= 0.5 AND is_fraud <> 1) AS tn,
          count(*) FILTER (WHERE score >= 0.5 AND is_fraud <> 1) AS fp,
          count(*) FILTER (WHERE NOT score >= 0.5 AND is_fraud = 1) AS fn,
          count(*) FILTER (WHERE score >= 0.5 AND is_fraud = 1) AS tp"""


@query("confusion", sql=SCORED + f"SELECT event_type, {CONF} FROM sc GROUP BY event_type")
def q_confusion(spark, sf):
    return M.confusion(scored(spark, sf), "score", "is_fraud", 0.5, keys=["event_type"])


@query("class_metrics", sql=SCORED + f"""SELECT tn, fp, fn, tp,
  round({sdiv('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round({sdiv('tp', 'tp + fp')}, 6) AS precision,
  round({sdiv('tp', 'tp + fn')}, 6) AS recall, round({f1_sql('tp', 'fp', 'fn')}, 6) AS f1
FROM (SELECT {CONF} FROM sc)""")
def q_class_metrics(spark, sf):
    m = M.class_metrics(scored(spark, sf), "score", "is_fraud", 0.5)
    return m.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


CUM = """cnt AS (SELECT {k} score AS s, CAST(count(*) FILTER (WHERE is_fraud = 1) AS DOUBLE) AS pos,
                CAST(count(*) FILTER (WHERE is_fraud <> 1) AS DOUBLE) AS neg
         FROM sc WHERE score IS NOT NULL GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
               sum(pos) OVER (PARTITION BY {p}) AS P, sum(neg) OVER (PARTITION BY {p}) AS N
        FROM cnt WINDOW w AS (PARTITION BY {p} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def cum_sql(key: str | None) -> str:
    return CUM.format(k=f"{key}," if key else "", p=key if key else "1")


@query("roc_auc", sql=SCORED + ", " + cum_sql("event_type") + """
SELECT event_type, round(CASE WHEN max(P) = 0 OR max(N) = 0 THEN NULL
       ELSE sum(pos * ((N - fp) + 0.5 * neg)) / (max(P) * max(N)) END, 6) AS roc_auc,
       CAST(max(P) AS BIGINT) AS positives, CAST(max(N) AS BIGINT) AS negatives
FROM cum GROUP BY event_type""")
def q_roc_auc(spark, sf):
    out = M.roc_auc(scored(spark, sf), "score", "is_fraud", keys=["event_type"])
    return out.select("event_type", r6("roc_auc").alias("roc_auc"), "positives", "negatives")


@query("roc_curve", sql=SCORED + ", " + cum_sql(None) + f"""
SELECT round(s, 6) AS threshold, round({sdiv('fp', 'N')}, 6) AS fpr, round({sdiv('tp', 'P')}, 6) AS tpr FROM cum
UNION ALL SELECT NULL, 0.0, 0.0""")
def q_roc_curve(spark, sf):
    c = M.roc_curve(scored(spark, sf), "score", "is_fraud")
    return c.select(r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("pr_curve", sql=SCORED + ", " + cum_sql(None) + f"""
SELECT round(s, 6) AS threshold, round({sdiv('tp', 'tp + fp')}, 6) AS precision,
       round(CASE WHEN P = 0 THEN 1.0 ELSE tp / P END, 6) AS recall FROM cum
UNION ALL SELECT NULL, 1.0, 0.0""")
def q_pr_curve(spark, sf):
    c = M.pr_curve(scored(spark, sf), "score", "is_fraud")
    return c.select(r6("threshold").alias("threshold"), r6("precision").alias("precision"),
                    r6("recall").alias("recall"))


@query("pr_auc", sql=SCORED + ", " + cum_sql("event_type") + f"""
, pts AS (SELECT event_type, tp / P AS r1, {sdiv('tp', 'tp + fp')} AS p1, (tp - pos) / P AS r0,
       CASE WHEN (tp - pos) + (fp - neg) = 0 THEN 1.0 ELSE {sdiv('tp - pos', '(tp - pos) + (fp - neg)')} END AS p0
       FROM cum WHERE P > 0)
SELECT event_type, round(sum((r1 - r0) * (p1 + p0) / 2.0), 6) AS pr_auc FROM pts GROUP BY event_type""")
def q_pr_auc(spark, sf):
    out = M.pr_auc(scored(spark, sf), "score", "is_fraud", keys=["event_type"])
    return out.select("event_type", r6("pr_auc").alias("pr_auc"))


GRID_SQL = "list_transform(range(0, 99), i -> 0.01 + i * 0.01)"
CURVE = f"""g AS (SELECT {{k}} i - 1 AS i, CAST(0.01 AS DOUBLE) + CAST(i - 1 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS threshold
       FROM (SELECT DISTINCT {{k0}} FROM sc) d, range(1, 100) r(i)),
tot AS (SELECT {{k}} count(*) FILTER (WHERE is_fraud = 1) AS P FROM sc WHERE score IS NOT NULL GROUP BY ALL),
atg AS (SELECT {{kg}} g.i, g.threshold,
         count(sc.score) FILTER (WHERE sc.score >= g.threshold AND sc.is_fraud = 1) AS tp,
         count(sc.score) FILTER (WHERE sc.score >= g.threshold AND sc.is_fraud <> 1) AS fp
       FROM g LEFT JOIN sc ON {{on}} GROUP BY ALL),
crv AS (SELECT atg.*, tot.P - tp AS fn FROM atg JOIN tot ON {{on2}})"""


def curve_sql(key: str | None) -> str:
    if key:
        return CURVE.format(k=f"{key},", k0=key, kg=f"g.{key},", on=f"g.{key} = sc.{key}",
                            on2=f"atg.{key} = tot.{key}")
    return CURVE.format(k="", k0="1 AS one", kg="", on="TRUE", on2="TRUE")


@query("threshold_curve", sql=SCORED + ", " + curve_sql(None) + f"""
SELECT CAST(i AS INTEGER) AS i, round(threshold, 6) AS threshold, tp, fp, fn,
       round({sdiv('tp', 'tp + fp')}, 6) AS precision, round({sdiv('tp', 'tp + fn')}, 6) AS recall,
       round({f1_sql('tp', 'fp', 'fn')}, 6) AS f1 FROM crv""")
def q_threshold_curve(spark, sf):
    c = M.threshold_curve(scored(spark, sf), "score", "is_fraud")
    return c.select(F.col("i").cast("int").alias("i"), r6("threshold").alias("threshold"), "tp", "fp", "fn",
                    *[r6(x).alias(x) for x in ("precision", "recall", "f1")])


@query("best_threshold_grid", sql=SCORED + ", " + curve_sql("event_type") + f"""
, f AS (SELECT event_type, threshold, {f1_sql('tp', 'fp', 'fn')} AS f1 FROM crv)
SELECT event_type, round(CASE WHEN max(f1) > 0 THEN arg_min(threshold, (-f1, threshold)) ELSE 0.5 END, 6)
       AS threshold, round(max(f1), 6) AS best_f1 FROM f GROUP BY event_type""")
def q_best_threshold_grid(spark, sf):
    b = M.best_threshold_grid(scored(spark, sf), "score", "is_fraud", keys=["event_type"])
    return b.select("event_type", r6("threshold").alias("threshold"), r6("best_f1").alias("best_f1"))


@query("best_f1_all_thresholds", sql=SCORED + ", " + cum_sql("channel") + f"""
, fs AS (SELECT channel, max({f1_sql('tp', 'fp', 'P - tp')}) AS f1_scores,
                sum(pos * ((N - fp) + 0.5 * neg)) / (max(P) * max(N)) AS auc FROM cum GROUP BY channel),
fx AS (SELECT channel, greatest(
         {f1_sql('count(*) FILTER (WHERE score >= 0.0 AND is_fraud = 1)', 'count(*) FILTER (WHERE score >= 0.0 AND is_fraud <> 1)', 'count(*) FILTER (WHERE is_fraud = 1) - count(*) FILTER (WHERE score >= 0.0 AND is_fraud = 1)')},
         {f1_sql('count(*) FILTER (WHERE score >= 0.5 AND is_fraud = 1)', 'count(*) FILTER (WHERE score >= 0.5 AND is_fraud <> 1)', 'count(*) FILTER (WHERE is_fraud = 1) - count(*) FILTER (WHERE score >= 0.5 AND is_fraud = 1)')},
         {f1_sql('count(*) FILTER (WHERE score >= 1.0 AND is_fraud = 1)', 'count(*) FILTER (WHERE score >= 1.0 AND is_fraud <> 1)', 'count(*) FILTER (WHERE is_fraud = 1) - count(*) FILTER (WHERE score >= 1.0 AND is_fraud = 1)')}
       ) AS f1_fixed, count(*) FILTER (WHERE is_fraud = 1) AS P, count(*) FILTER (WHERE is_fraud <> 1) AS N
       FROM sc WHERE score IS NOT NULL GROUP BY channel)
SELECT channel, round(CASE WHEN P = 0 OR N = 0 THEN 0.0 ELSE greatest(f1_fixed, f1_scores) END, 6) AS best_f1,
       round(CASE WHEN P = 0 OR N = 0 THEN 0.5 ELSE auc END, 6) AS roc_auc
FROM fx LEFT JOIN fs USING (channel)""")
def q_best_f1_all_thresholds(spark, sf):
    b = M.best_f1_all_thresholds(scored(spark, sf), "score", "is_fraud", keys=["channel"])
    return b.select("channel", r6("best_f1").alias("best_f1"), r6("roc_auc").alias("roc_auc"))


@query("class_balance", sql=with_ctes(TXN) + """
SELECT category, count(*) FILTER (WHERE is_fraud <> 1) AS negatives, count(*) FILTER (WHERE is_fraud = 1) AS positives,
       round(CASE WHEN count(*) FILTER (WHERE is_fraud = 1) > 0 THEN
         count(*) FILTER (WHERE is_fraud <> 1) / count(*) FILTER (WHERE is_fraud = 1) END, 6) AS scale_pos_weight
FROM txn GROUP BY category""")
def q_class_balance(spark, sf):
    b = M.class_balance(transactions(spark, sf), "is_fraud", keys=["category"])
    return b.select("category", "negatives", "positives", r6("scale_pos_weight").alias("scale_pos_weight"))


@query("fraud_rate", sql=with_ctes(TXN) + """
SELECT country, sum(CAST(is_fraud AS BIGINT)) AS positives, count(*) AS total,
       round(sum(CAST(is_fraud AS BIGINT)) / count(*), 6) AS rate FROM txn GROUP BY country""")
def q_fraud_rate(spark, sf):
    r = M.fraud_rate(transactions(spark, sf), "is_fraud", keys=["country"])
    return r.select("country", "positives", "total", r6("rate").alias("rate"))


@query("relative_gain", sql=SCORED + ", " + curve_sql("event_type") + f"""
, f AS (SELECT event_type, threshold, {f1_sql('tp', 'fp', 'fn')} AS f1 FROM crv),
best AS (SELECT event_type, max(f1) AS opt FROM f GROUP BY event_type),
base AS (SELECT event_type, {f1_sql('tp', 'fp', 'fn')} AS base FROM (SELECT event_type, {CONF} FROM sc GROUP BY event_type))
SELECT event_type, round(base, 6) AS f1_default, round(opt, 6) AS f1_tuned,
       round((opt - base) / greatest(1e-4, base) * 100.0, 6) AS gain_pct FROM best JOIN base USING (event_type)""")
def q_relative_gain(spark, sf):
    """F1 gain of the tuned grid threshold over the default 0.5, per event type."""
    s = scored(spark, sf)
    base = M.class_metrics(s, "score", "is_fraud", 0.5, keys=["event_type"]).select(
        "event_type", F.col("f1").alias("base"))
    best = M.best_threshold_grid(s, "score", "is_fraud", keys=["event_type"]).select(
        "event_type", F.col("best_f1").alias("opt"))
    j = best.join(base, "event_type")
    return j.select("event_type", r6("base").alias("f1_default"), r6("opt").alias("f1_tuned"),
                    r6(M.relative_gain("opt", "base")).alias("gain_pct"))
