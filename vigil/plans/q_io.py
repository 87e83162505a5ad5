"""Registered queries: scans, codecs, sinks, streaming and the two scaling
helpers (SURVEY §2.1, §2.9).  Files are written under the shared checkpoint
folder (``spark.checkpoint.dir``), one fresh sub-folder per run."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import round_places
from pyspark.sql import Window

from vigil import config as C
from vigil.functions.features import linear_score
from vigil.operators.sequence import dense_sequence, halo_window, prefix_sum
from vigil.plans.registry import query
from vigil.plans.sqlbind import STX, TXN, with_ctes
from vigil.session import scratch_path
from vigil.sources import codec as K
from vigil.sources import logs as L
from vigil.sources.tables import TRANSACTION_SCHEMA, load, scan_transactions, stream_transactions, transactions
from vigil.streaming import streams as S


def r6(c):
    return round_places(c, 6)


TXN_COLS = [f.name for f in TRANSACTION_SCHEMA.fields]


# ---------------------------------------------------------------- scan_transactions
@query("scan_transactions", sql=with_ctes(TXN) + "SELECT " + ", ".join(
    ("round(" + c + ", 6) AS " + c) if c in ("price", "session_duration", "discount_pct", "merchant_risk_score")
    else (f"CAST({c} AS BIGINT) AS {c}" if c not in ("event_time", "event_type", "category", "device_type", "channel",
                                                      "country", "shipping_speed") else c)
    for c in TXN_COLS) + " FROM txn")
def q_scan_transactions(spark, sf):
    """The transaction table written as CSV (header) and scanned back with the explicit schema."""
    t = transactions(spark, sf).select(*[F.col(c) for c in TXN_COLS])
    path = scratch_path(spark, "txn-csv")
    t.write.option("header", True).csv(path)
    back = scan_transactions(spark, path, fmt="csv")
    return back.select(*[(r6(c) if c in ("price", "session_duration", "discount_pct", "merchant_risk_score")
                          else F.col(c)).alias(c) for c in TXN_COLS])


# ---------------------------------------------------------------- json codec
@query("json_decode", sql=with_ctes(STX) + "SELECT step, " + ", ".join(
    (f"round({c}, 6) AS {c}" if c in ("price", "session_duration", "discount_pct", "merchant_risk_score")
     else f"strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS {c}" if c == "event_time"
     else f"CAST({c} AS INTEGER) AS {c}" if c in K.FLAG_FIELDS
     else f"CAST({c} AS BIGINT) AS {c}" if c in K.INT_FIELDS else c)
    for c in K.PAYLOAD_FIELDS) + " FROM stx")
def q_json_decode(spark, sf):
    """Payloads as the producer sends them (flags as JSON booleans, numbers as 7.0) decoded back."""
    s = stream_transactions(spark, sf)
    wire = s.select("step", F.to_json(F.struct(
        *[(F.col(c).cast("boolean") if c in K.FLAG_FIELDS
           else F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS") if c == "event_time"
           else F.col(c).cast("double") if c in K.INT_FIELDS else F.col(c)).alias(c)
          for c in K.PAYLOAD_FIELDS])).alias("value"))
    dec = K.json_decode(wire, "value", keep=["step"])
    return dec.select("step", *[(r6(c) if c in ("price", "session_duration", "discount_pct", "merchant_risk_score")
                                 else F.col(c)).alias(c) for c in K.PAYLOAD_FIELDS])


@query("json_encode", sql="""SELECT event_id, to_json(struct_pack(event_id := event_id, event_type := event_type,
       value := value)) AS value FROM events""")
def q_json_encode(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select("event_id", F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))


@query("payload_project", sql=with_ctes(STX) + "SELECT " + ", ".join(
    c for c in ["event_time", *C.MODEL_FEATURES, "is_fraud"] if c != "event_time") + ", event_time FROM stx")
def q_payload_project(spark, sf):
    """Only model features, event time and label leave the producer."""
    s = stream_transactions(spark, sf)
    return K.payload_project(s)


# ---------------------------------------------------------------- log table
LOG_SQL = with_ctes(STX) + f""", sc AS (SELECT *, 0.01 + least(greatest((price - 10.0) / 2000.0, 0.0), 0.99) AS p FROM stx)
SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(user_id AS DOUBLE) AS user_id,
       CAST(product_id AS DOUBLE) AS product_id, round(price, 6) AS price, event_type, category, device_type,
       CASE WHEN is_current THEN NULL ELSE channel END AS channel, CASE WHEN is_current THEN NULL ELSE country END AS country,
       round(session_duration, 6) AS session_duration, CAST(account_age_days AS DOUBLE) AS account_age_days,
       CAST(prior_orders AS DOUBLE) AS prior_orders, CAST(prior_chargebacks AS DOUBLE) AS prior_chargebacks,
       round(discount_pct, 6) AS discount_pct, shipping_speed, CAST(hour_of_day AS DOUBLE) AS hour_of_day,
       CAST(is_weekend AS INTEGER) AS is_weekend, CAST(cart_size AS DOUBLE) AS cart_size,
       round(merchant_risk_score, 6) AS merchant_risk_score, CAST(is_high_value AS INTEGER) AS is_high_value,
       CAST(is_fraud AS INTEGER) AS is_fraud, round(p, 6) AS fraud_probability, 'fallback' AS model_version,
       CAST(event_time AS DATE) AS log_date
FROM sc"""


def _log_rows(spark, sf):
    s = stream_transactions(spark, sf)
    return s.withColumn("timestamp", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")) \
            .withColumn("fraud_probability", linear_score("price")).withColumn("model_version", F.lit("fallback"))


@query("log_append", sql=LOG_SQL)
def q_log_append(spark, sf):
    """Two appends to the date-partitioned log: the second batch lacks two columns (NULL after merge)."""
    rows = _log_rows(spark, sf)
    path = scratch_path(spark, "inference-log")
    L.log_append(rows.where(~F.col("is_current")).drop("is_current"), path)
    L.log_append(rows.where(F.col("is_current")).drop("is_current", "channel", "country"), path, batch_id=1)
    back = L.read_log(spark, path)
    cols = [c for c, _ in C.LOG_COLUMNS]
    return back.select(*[(r6(c) if c in ("price", "session_duration", "discount_pct", "merchant_risk_score",
                                          "fraud_probability") else F.col(c)).alias(c) for c in cols], "log_date")


@query("log_evolve", sql=with_ctes(STX) + """SELECT CAST(NULL AS VARCHAR) AS timestamp, CAST(user_id AS DOUBLE) AS user_id,
       CAST(NULL AS DOUBLE) AS product_id, round(price, 6) AS price, event_type, """ + ", ".join(
    f"CAST(NULL AS {'VARCHAR' if t == 'string' else 'INTEGER' if t == 'int' else 'DOUBLE'}) AS {c}"
    for c, t in C.LOG_COLUMNS[5:]) + " FROM stx")
def q_log_evolve(spark, sf):
    """A frame with four request fields evolved to the 23 declared log columns."""
    s = stream_transactions(spark, sf).select("user_id", "price", "event_type")
    out = L.log_evolve(s)
    return out.withColumn("price", r6("price"))


@query("report_sink")
def q_report_sink(spark, sf):
    """Scenario statistics written as JSON lines and read back (rows-only)."""
    from vigil.plans.monitoring import scenario_stats
    path = scratch_path(spark, "report")
    L.report_sink(scenario_stats(spark, sf), path)
    return spark.read.json(path)


# ---------------------------------------------------------------- streaming (rows-only)
def _land_payloads(spark, sf, n_files: int = 4) -> str:
    """Kafka stand-in: payload JSON lines written from the table into a landing folder."""
    s = stream_transactions(spark, sf)
    wire = s.select(F.to_json(F.struct(*[(F.col(c).cast("boolean") if c in K.FLAG_FIELDS
                                          else F.date_format("event_time", "yyyy-MM-dd HH:mm:ss") if c == "event_time"
                                          else F.col(c)).alias(c) for c in K.PAYLOAD_FIELDS])).alias("value"))
    path = scratch_path(spark, "landing")
    wire.repartition(n_files).write.text(path)
    return path


@query("stream_source")
def q_stream_source(spark, sf):
    """File-source stream over landed payloads, decoded (availableNow, rows-only)."""
    src = _land_payloads(spark, sf)
    out = scratch_path(spark, "stream-source")
    q = K.json_decode(S.payload_files(spark, src), "value").writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", scratch_path(spark, "stream-source-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query("foreach_batch_sink")
def q_foreach_batch_sink(spark, sf):
    """foreachBatch sink: each micro-batch scored on Spark and written idempotently by batch id."""
    src = _land_payloads(spark, sf)
    log = scratch_path(spark, "fb-log")
    q = S.stream_score(spark, src, log, scratch_path(spark, "fb-ckpt"), max_files_per_trigger=1)
    q.awaitTermination()
    return L.read_log(spark, log)


@query("stream_score")
def q_stream_score(spark, sf):
    """decode -> flag -> score (active scorer re-read per batch) -> log, per micro-batch."""
    src = _land_payloads(spark, sf)
    log = scratch_path(spark, "score-log")
    q = S.stream_score(spark, src, log, scratch_path(spark, "score-ckpt"))
    q.awaitTermination()
    return L.read_log(spark, log).groupBy("batch", "model_version").agg(
        F.count(F.lit(1)).alias("rows_"), F.avg("fraud_probability").alias("mean_probability"))


@query("stream_monitor")
def q_stream_monitor(spark, sf):
    """Monitor trigger over the scored log: newest 200 rows -> PSI -> gate -> job event."""
    src = _land_payloads(spark, sf)
    log = scratch_path(spark, "mon-log")
    S.stream_score(spark, src, log, scratch_path(spark, "mon-score-ckpt")).awaitTermination()
    baseline = stream_transactions(spark, sf).where(~F.col("is_current"))
    jobs = scratch_path(spark, "mon-jobs")
    S.stream_monitor(spark, log, baseline, jobs, scratch_path(spark, "mon-ckpt")).awaitTermination()
    return spark.read.parquet(jobs)


# ---------------------------------------------------------------- stream_psi_window (oracle on the batch twin)
PSI_FEATS = ["value", "k"]


def _psi_window_sql() -> str:
    qs = ", ".join(str(i / 10) for i in range(1, 10))
    cnt = ", ".join(f"count(*) FILTER (WHERE b_{f} = {k}) AS n_{f}_{k}" for f in PSI_FEATS for k in range(10))
    feats = []
    for f in PSI_FEATS:
        n = " + ".join(f"n_{f}_{k}" for k in range(10))
        terms = []
        for k in range(10):
            a = f"(CASE WHEN n_{f}_{k} / ({n}) = 0 THEN {C.PSI_FLOOR} ELSE n_{f}_{k} / ({n}) END)"
            e = f"(CASE WHEN s_{f}[{k + 1}] = 0 THEN {C.PSI_FLOOR} ELSE s_{f}[{k + 1}] END)"
            terms.append(f"({a} - {e}) * ln({a} / {e})")
        feats.append(f"(CASE WHEN ({n}) > 0 THEN {' + '.join(terms)} ELSE 0.0 END)")
    return f"""WITH ev AS (SELECT ts, value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
base AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-16'),
ed AS (SELECT {', '.join(f"quantile_cont({f}, [{qs}]) AS e_{f}" for f in PSI_FEATS)} FROM base),
bb AS (SELECT {', '.join(f"len(list_filter(ed.e_{f}, lambda x: base.{f} >= x)) AS b_{f}" for f in PSI_FEATS)} FROM base, ed),
sh AS (SELECT {', '.join("[" + ", ".join(f"count(*) FILTER (WHERE b_{f} = {k}) / count(*)" for k in range(10)) + f"] AS s_{f}" for f in PSI_FEATS)} FROM bb),
rb AS (SELECT ev.ts, {', '.join(f"len(list_filter(ed.e_{f}, lambda x: ev.{f} >= x)) AS b_{f}" for f in PSI_FEATS)} FROM ev, ed),
agg AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n_rows, {cnt} FROM rb GROUP BY 1)
SELECT window_start, n_rows, round(({' + '.join(feats)}) / {float(len(PSI_FEATS))}, 6) AS psi FROM agg, sh"""


@query("stream_psi_window", sql=_psi_window_sql())
def q_stream_psi_window(spark, sf):
    """Daily PSI of value and k vs the first half of the month, computed by a watermarked
    streaming aggregation (update mode, idempotent per-batch output)."""
    ev = load(spark, sf, "events").select(
        "ts", "value", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    edges = S.window_psi_edges(ev.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp")), PSI_FEATS)
    land = scratch_path(spark, "psi-landing")
    ev.repartition(4).write.parquet(land)
    out = scratch_path(spark, "psi-window")
    S.stream_psi_window(spark, land, ev.schema, edges, out, scratch_path(spark, "psi-ckpt")).awaitTermination()
    res = spark.read.parquet(out)
    latest = res.groupBy("window_start").agg(F.max_by(F.struct("n_rows", "psi"), "batch_id").alias("x"))
    return latest.select("window_start", F.col("x.n_rows").alias("n_rows"), r6("x.psi").alias("psi"))


# ---------------------------------------------------------------- helpers as queries
@query("prefix_sum", sql="""SELECT event_id, event_type, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value_cum FROM events""")
def q_prefix_sum(spark, sf):
    """Running total of value per event type without a one-task window."""
    ev = load(spark, sf, "events").select("event_id", "event_type", "value")
    out = prefix_sum(ev, ["event_id"], ["value"], keys=["event_type"])
    return out.select("event_id", "event_type", r6("value_cum").alias("value_cum"))


@query("halo_window", sql="""SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6)
       AS value_ma50 FROM events""")
def q_halo_window(spark, sf):
    """Trailing 50-event mean over the whole event series, chunked with a halo (small chunks
    here to exercise chunk boundaries)."""
    ev = dense_sequence(load(spark, sf, "events").select("event_id", "value"), ["event_id"], name="seq")

    def build(frame, w):
        return frame.withColumn("value_ma50", F.avg("value").over(w))

    out = halo_window(ev, "seq", 50, build, chunk_rows=1000)
    return out.select("event_id", r6("value_ma50").alias("value_ma50"))


del Window
