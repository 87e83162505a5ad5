"""Registered queries: job, registry and decision tables and
sorts/limits/sampling/splits (SURVEY §2.6).

Bindings: a retraining job per user of ``events`` (event types are job
state updates, ordered by time); the run registry from ``orders`` (one run
per order: status from the order status, params/metrics as maps).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import round_places

from vigil import config as C
from vigil.operators import drift as D
from vigil.operators import jobs as J
from vigil.operators import sampling as SP
from vigil.plans.psi_sql import psi_ctes
from vigil.plans.q_features import CANONICAL, PREDICTIVE
from vigil.plans.registry import query
from vigil.plans.sqlbind import STX, TXN, with_ctes
from vigil.sources.tables import load, stream_transactions, transactions


def r6(c):
    return round_places(c, 6)


# ---------------------------------------------------------------- job events from `events`
# event type -> job state update (binding parameters)
STATE_OF = {"signup": "PENDING", "click": "STARTED", "view": "EVALUATING", "purchase": "COMPLETED",
            "error": "FAILED"}


def job_events(spark, sf):
    """Append-only job events: every event is a partial update of its user's job."""
    ev = load(spark, sf, "events")
    state = None
    for k, v in STATE_OF.items():
        state = F.when(F.col("event_type") == k, F.lit(v)) if state is None else \
            state.when(F.col("event_type") == k, F.lit(v))
    et = F.col("event_type")
    return ev.select(
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("ts").alias("event_time"), F.col("event_id").alias("event_seq"),
        F.when(et == "signup", F.col("ts")).alias("start_time"),
        state.alias("status"),
        F.when(et == "signup", F.col("value") / F.lit(100.0)).alias("psi_score"),
        F.when(et == "view", F.col("value") / F.lit(1000.0)).alias("ks_stat"),
        F.when(et == "purchase", F.lit("CHALLENGER_WINS")).when(et == "error", F.lit("Error loading model"))
         .alias("decision"))


def _state_sql() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_OF.items()) + " END"


JOB_EVENTS_SQL = f"""je AS (SELECT 'job_' || CAST(user_id AS VARCHAR) AS job_id, ts AS event_time, event_id AS event_seq,
    CASE WHEN event_type = 'signup' THEN ts END AS start_time, {_state_sql()} AS status,
    CASE WHEN event_type = 'signup' THEN value / 100.0 END AS psi_score,
    CASE WHEN event_type = 'view' THEN value / 1000.0 END AS ks_stat,
    CASE WHEN event_type = 'purchase' THEN 'CHALLENGER_WINS' WHEN event_type = 'error' THEN 'Error loading model' END AS decision
  FROM events)"""


def _latest(col: str) -> str:
    return (f"max({{'t': event_time, 's': event_seq, 'v': {col}}}) FILTER (WHERE {col} IS NOT NULL).v")


JOB_CURRENT_SQL = JOB_EVENTS_SQL + f""",
jc AS (SELECT job_id, {_latest('start_time')} AS start_time, {_latest('status')} AS status,
              {_latest('decision')} AS decision, {_latest('psi_score')} AS psi_score, {_latest('ks_stat')} AS ks_stat
       FROM je GROUP BY job_id),
nw AS (SELECT max(ts) AS now FROM events)"""


@query("job_events", sql=with_ctes(JOB_EVENTS_SQL) + """SELECT job_id, event_time, event_seq, start_time, status,
       round(psi_score, 6) AS psi_score, round(ks_stat, 6) AS ks_stat, decision FROM je""")
def q_job_events(spark, sf):
    e = job_events(spark, sf)
    return e.withColumn("psi_score", r6("psi_score")).withColumn("ks_stat", r6("ks_stat"))


@query("job_current", sql=with_ctes(JOB_CURRENT_SQL) + """SELECT job_id, start_time, status, decision,
       round(psi_score, 6) AS psi_score, round(ks_stat, 6) AS ks_stat FROM jc""")
def q_job_current(spark, sf):
    """Current state per job: per field the latest event that set it."""
    cur = J.job_current(job_events(spark, sf), fields=["start_time", "status", "decision", "psi_score", "ks_stat"])
    return cur.select("job_id", "start_time", "status", "decision", r6("psi_score").alias("psi_score"),
                      r6("ks_stat").alias("ks_stat"))


def _now(spark, sf):
    return load(spark, sf, "events").agg(F.max("ts")).scalar()


@query("job_expire", sql=with_ctes(JOB_CURRENT_SQL) + f"""SELECT job_id,
  CASE WHEN status NOT IN ('COMPLETED', 'FAILED', 'REJECTED')
        AND coalesce(start_time < now - INTERVAL {C.JOB_TIMEOUT_SECONDS} SECOND, false) THEN 'FAILED' ELSE status END AS status,
  CASE WHEN status NOT IN ('COMPLETED', 'FAILED', 'REJECTED')
        AND coalesce(start_time < now - INTERVAL {C.JOB_TIMEOUT_SECONDS} SECOND, false) THEN 'ORPHANED_TIMEOUT' ELSE decision END AS decision
FROM jc, nw""")
def q_job_expire(spark, sf):
    """Unfinished jobs older than 5 minutes (at the newest event time) become FAILED."""
    cur = J.job_current(job_events(spark, sf), fields=["start_time", "status", "decision"])
    return J.job_expire(cur, _now(spark, sf)).select("job_id", "status", "decision")


@query("job_gate", sql=with_ctes(JOB_CURRENT_SQL) + f""", ex AS (SELECT job_id, start_time,
  CASE WHEN status NOT IN ('COMPLETED', 'FAILED', 'REJECTED')
        AND coalesce(start_time < now - INTERVAL {C.JOB_TIMEOUT_SECONDS} SECOND, false) THEN 'FAILED' ELSE status END AS status
  FROM jc, nw),
ag AS (SELECT count(*) FILTER (WHERE status NOT IN ('COMPLETED', 'FAILED', 'REJECTED')) AS active_jobs,
              max(start_time) AS last_start FROM ex),
src AS (SELECT value, ts >= TIMESTAMP '2024-01-16' AS is_current FROM events),
""" + psi_ctes("src", []) + f""",
ps AS (SELECT psi FROM p_out)
SELECT active_jobs, last_start,
  CASE WHEN active_jobs > 0 THEN 'SKIP_ACTIVE'
       WHEN last_start IS NOT NULL AND epoch(now) - epoch(last_start) < {C.JOB_COOLDOWN_SECONDS} THEN 'COOLDOWN'
       ELSE 'OPEN' END AS decision,
  CASE WHEN decision = 'OPEN' THEN 'PENDING' END AS new_status,
  round(CASE WHEN decision = 'OPEN' THEN psi END, 6) AS psi_score, CASE WHEN decision = 'OPEN' THEN 1 END AS adwin_change
FROM ag, nw, ps""")
def q_job_gate(spark, sf):
    """Expire, then skip when a job is active, cool down after a recent start, else open a job."""
    cur = J.job_current(job_events(spark, sf), fields=["start_time", "status", "decision"])
    ev = load(spark, sf, "events").select("value", (F.col("ts") >= F.lit("2024-01-16").cast("timestamp")).alias("is_current"))
    psi = D.psi(ev, "value", F.col("is_current")).select("psi").scalar()
    gate = J.job_gate(cur, _now(spark, sf), psi, F.lit(True))
    return gate.withColumn("psi_score", r6("psi_score"))


@query("ready_to_retrain", sql="""SELECT user_id, count(*) AS n_rows,
  CASE WHEN count(*) < 50 THEN 'REJECTED' ELSE 'READY' END AS status,
  CASE WHEN count(*) < 50 THEN 'Insufficient drifted data' END AS decision
FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id""")
def q_ready_to_retrain(spark, sf):
    """Per user: enough drifted (second-half) rows to retrain on?"""
    ev = load(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))
    return J.ready_to_retrain(ev, keys=["user_id"])


# ---------------------------------------------------------------- champion / challenger
@query("champion_challenger", sql=with_ctes(STX) + """
, sc AS (SELECT event_type AS scenario, is_fraud AS y,
                floor(least(greatest(1.0 / (1.0 + exp(-((-4.0 + 0.0023 * price) + 0.45 * merchant_risk_score))), 0.01), 0.99) * 10000000000.0 + 0.5) / 10000000000.0 AS champ,
                0.01 + least(greatest((price - 10.0) / 2000.0, 0.0), 0.99) AS chall
         FROM stx WHERE is_current),
a AS (SELECT scenario, s, kind, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) AS neg
      FROM (SELECT scenario, y, champ AS s, 'champ' AS kind FROM sc UNION ALL SELECT scenario, y, chall, 'chall' FROM sc) GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY scenario, kind ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             sum(pos) OVER (PARTITION BY scenario, kind) AS P, sum(neg) OVER (PARTITION BY scenario, kind) AS N FROM a),
u AS (SELECT scenario, kind, CASE WHEN max(P) = 0 OR max(N) = 0 THEN 0.5 ELSE sum(pos * ((N - fp) + 0.5 * neg)) / (max(P) * max(N)) END AS auc
      FROM c GROUP BY ALL),
w AS (SELECT scenario, max(auc) FILTER (WHERE kind = 'champ') AS champ_auc, max(auc) FILTER (WHERE kind = 'chall') AS chall_auc FROM u GROUP BY scenario)
SELECT scenario, round(champ_auc, 6) AS champion_auc, round(chall_auc, 6) AS challenger_auc,
       CASE WHEN chall_auc > champ_auc THEN 'CHALLENGER_WINS' ELSE 'CHAMPION_HELD' END AS decision
FROM w""")
def q_champion_challenger(spark, sf):
    """Decision by AUC on the drifted period: champion = price/risk logistic score,
    challenger = the linear fallback score."""
    from vigil.functions.features import linear_score, round_half_up
    from vigil.operators.metrics import roc_auc
    s = stream_transactions(spark, sf).where(F.col("is_current")).withColumn("scenario", F.col("event_type"))
    z = (F.lit(-4.0) + F.lit(0.0023) * F.col("price")) + F.lit(0.45) * F.col("merchant_risk_score")
    champ = round_half_up(F.least(F.greatest(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), F.lit(0.01)), F.lit(0.99)), 10)
    s = s.withColumn("champ", champ).withColumn("chall", linear_score("price"))
    both = s.select("scenario", "is_fraud", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("s")) for k in ("champ", "chall")])).alias("x")) \
        .select("scenario", "is_fraud", "x.kind", "x.s")
    auc = roc_auc(both, "s", "is_fraud", keys=["scenario", "kind"])  # both models in one pass
    j = auc.groupBy("scenario").agg(*[F.max(F.when(F.col("kind") == k, F.coalesce("roc_auc", F.lit(0.5)))).alias(f"{k}_auc") for k in ("champ", "chall")])
    return j.select("scenario", r6("champ_auc").alias("champion_auc"), r6("chall_auc").alias("challenger_auc"),
                    J.champion_challenger(F.col("champ_auc"), F.col("chall_auc")).alias("decision"))


# ---------------------------------------------------------------- run registry from `orders`
STATUS_OF = {"F": "FINISHED", "O": "RUNNING", "P": "FAILED"}
MODEL_TYPES = ["champion", "challenger", "challenger_2"]


def runs(spark, sf):
    o = load(spark, sf, "orders")
    st = F.when(F.col("o_orderstatus") == "F", F.lit("FINISHED")).when(F.col("o_orderstatus") == "O", F.lit("RUNNING")) \
        .otherwise(F.lit("FAILED"))
    mt = F.when(F.col("o_custkey") % 3 == 0, F.lit(MODEL_TYPES[0])).when(F.col("o_custkey") % 3 == 1, F.lit(MODEL_TYPES[1])) \
        .otherwise(F.lit(MODEL_TYPES[2]))
    th = ((F.col("o_orderkey") % 99 + 1) / F.lit(100.0)).cast("string")
    params = F.when(F.col("o_orderkey") % 10 == 0, F.create_map(F.lit("model_type"), mt)) \
        .otherwise(F.create_map(F.lit("model_type"), mt, F.lit("decision_threshold"), th))
    version = F.create_map(F.lit("schema_version"), F.concat(F.lit("v"), (F.col("o_custkey") % 4).cast("string")))
    adapter = F.create_map(F.lit("adapter"), F.lit("transactions"))
    params = F.when(F.col("o_orderkey") % 3 == 0, F.map_concat(params, version)).otherwise(F.map_concat(params, version, adapter))
    f1 = F.col("o_totalprice") / (F.col("o_totalprice") + F.lit(100000.0))
    metrics = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("f1_score"), f1, F.lit("baseline_f1_score"), f1 / 2)) \
        .otherwise(F.create_map(F.lit("f1_score"), f1))
    return o.select(F.md5(F.col("o_orderkey").cast("string")).alias("run_id"),
                    F.concat(F.lit("exp_"), F.substring("o_orderpriority", 1, 1)).alias("experiment"),
                    F.col("o_orderdate").alias("start_time"), st.alias("status"),
                    params.alias("params"), metrics.alias("metrics"))


RUNS_SQL = """runs AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS run_id, 'exp_' || substring(o_orderpriority, 1, 1) AS experiment,
    o_orderdate AS start_time,
    CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
    CASE o_custkey % 3 WHEN 0 THEN 'champion' WHEN 1 THEN 'challenger' ELSE 'challenger_2' END AS model_type,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST((o_orderkey % 99 + 1) / 100.0 AS DOUBLE) END AS thr,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'transactions' END AS adapter, 'v' || CAST(o_custkey % 4 AS VARCHAR) AS schema_version,
    o_totalprice / (o_totalprice + 100000.0) AS f1_score, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_base
  FROM orders)"""


@query("top_runs", sql=with_ctes(RUNS_SQL) + """SELECT run_id, experiment, start_time, status FROM runs
WHERE experiment LIKE 'exp_%' AND status = 'FINISHED' ORDER BY start_time DESC, run_id DESC LIMIT 20""")
def q_top_runs(spark, sf):
    """Newest 20 finished runs of the 'exp_' experiments (a top-k report)."""
    return J.top_runs(runs(spark, sf), 20, prefix="exp_", status="FINISHED").select(
        "run_id", "experiment", "start_time", "status")


@query("active_model", sql=with_ctes(RUNS_SQL) + """SELECT run_id, experiment, start_time, model_type,
       CAST(thr AS VARCHAR) AS decision_threshold FROM runs
WHERE experiment LIKE 'exp_1%' AND status = 'FINISHED' ORDER BY start_time DESC, run_id DESC LIMIT 1""")
def q_active_model(spark, sf):
    """Newest finished run of the urgent-priority experiment, else the fallback scorer."""
    return J.active_model(runs(spark, sf), prefix="exp_1").drop("adapter", "schema_version")


@query("model_info", sql=with_ctes(RUNS_SQL) + f"""SELECT run_id AS model_run_id, experiment AS dataset_name,
       coalesce(adapter, 'none') AS adapter_class, coalesce(schema_version, 'none') AS feature_schema_version,
       strftime(start_time, '%Y-%m-%dT%H:%M:%S') AS training_timestamp, {len(CANONICAL)} AS canonical_features_count,
       {len(PREDICTIVE)} AS predictive_features_count, {len(CANONICAL) + len(PREDICTIVE)} AS model_features_count
FROM runs WHERE experiment LIKE 'exp_1%' AND status = 'FINISHED' ORDER BY start_time DESC, run_id DESC LIMIT 1""")
def q_model_info(spark, sf):
    return J.model_info(J.active_model(runs(spark, sf), prefix="exp_1"), CANONICAL, PREDICTIVE)


@query("run_flatten", sql=with_ctes(RUNS_SQL) + """SELECT substring(run_id, 1, 8) AS short_id, run_id,
       strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_text, status, model_type,
       coalesce(CAST(thr AS VARCHAR), 'N/A') AS threshold, round(f1_score, 6) AS f1_score, n_base AS baseline_metric_count
FROM runs""")
def q_run_flatten(spark, sf):
    """Run table with params/metrics flattened, "N/A" defaults, short ids and time text."""
    out = J.run_flatten(runs(spark, sf))
    return out.withColumn("f1_score", r6("f1_score"))


# ---------------------------------------------------------------- §2.6 splits, sampling, sorting
@query("stratified_split", sql=with_ctes(TXN) + """
, r AS (SELECT is_fraud, order_key, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(order_key AS VARCHAR) || ':' || CAST(line_number AS VARCHAR) || ':42'), order_key, line_number, price) AS rn,
               count(*) OVER (PARTITION BY is_fraud) AS n FROM txn)
SELECT is_fraud, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS part, count(*) AS rows_,
       sum(order_key) AS key_sum
FROM r GROUP BY ALL""")
def q_stratified_split(spark, sf):
    """80/20 split within each class, exact shares, by a seeded hash order."""
    t = transactions(spark, sf)
    out = SP.stratified_split(t.select("order_key", "line_number", "price", "is_fraud"), "is_fraud",
                              ["order_key", "line_number"], test_share=0.2, seed=42, tiebreak=["price"])
    return out.groupBy("is_fraud", "part").agg(F.count(F.lit(1)).alias("rows_"), F.sum("order_key").alias("key_sum"))


@query("random_split", sql=with_ctes(TXN) + """
SELECT CASE WHEN b < 7000 THEN 'train' WHEN b < 8500 THEN 'val' ELSE 'test' END AS part, count(*) AS rows_
FROM (SELECT CAST(('0x' || substring(md5(CAST(order_key AS VARCHAR) || ':' || CAST(line_number AS VARCHAR) || ':42'), 1, 8))::BIGINT % 10000 AS BIGINT) AS b FROM txn)
GROUP BY ALL""")
def q_random_split(spark, sf):
    """70/15/15 split by a stable hash bucket (same rows on every run, unlike randomSplit)."""
    t = transactions(spark, sf)
    out = SP.hash_split(t, ["order_key", "line_number"], {"train": 0.70, "val": 0.15, "test": 0.15}, seed=42)
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("rows_"))


@query("sample_n", sql=with_ctes(TXN) + """SELECT order_key, line_number, round(price, 6) AS price FROM txn
ORDER BY md5(CAST(order_key AS VARCHAR) || ':' || CAST(line_number AS VARCHAR) || ':42'), order_key, line_number, price LIMIT 200""")
def q_sample_n(spark, sf):
    """Fixed-seed sample of 200 rows (the lowest hashes: a sampling operator)."""
    t = transactions(spark, sf)
    s = SP.sample_n(t, 200, ["order_key", "line_number"], seed=42, tiebreak=["price"])
    return s.select("order_key", "line_number", r6("price").alias("price"))


@query("retrain_pool", sql=with_ctes(STX) + """SELECT prior_chargebacks >= 1 AS rewritten, count(*) AS rows_,
       round(avg(merchant_risk_score), 6) AS mean_risk
FROM (SELECT prior_chargebacks, merchant_risk_score FROM stx UNION ALL
      SELECT prior_chargebacks, CASE WHEN prior_chargebacks >= 1 THEN least(merchant_risk_score * 2.0, 1.0) ELSE merchant_risk_score END
      FROM stx)
GROUP BY ALL""")
def q_retrain_pool(spark, sf):
    """Baseline rows unioned with their rewritten copy (the retraining pool)."""
    from vigil.functions.features import cohort_rewrite
    from vigil.plans.q_features import what_if_cohorts
    s = stream_transactions(spark, sf)
    pool = SP.retrain_pool(s, cohort_rewrite(s, what_if_cohorts()))
    return pool.groupBy((F.col("prior_chargebacks") >= 1).alias("rewritten")).agg(
        F.count(F.lit(1)).alias("rows_"), r6(F.avg("merchant_risk_score")).alias("mean_risk"))


@query("recent_n", sql="""SELECT event_id, ts, round(value, 6) AS value FROM events
ORDER BY ts DESC, event_id DESC LIMIT 200""")
def q_recent_n(spark, sf):
    """Newest 200 log rows for monitoring (top-k: TakeOrderedAndProject, no full sort)."""
    ev = load(spark, sf, "events")
    out = SP.recent_n(ev, 200, "ts", tiebreak="event_id")
    return out.select("event_id", "ts", r6("value").alias("value"))
