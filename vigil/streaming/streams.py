"""Structured Streaming pipelines.

* ``stream_score`` — JSON payloads -> decode -> flag -> (per micro-batch)
  encode + score with the *currently active* scorer -> append to the log.
  Each batch is one batch of the log table, visible at once, and a replayed
  batch after a failure replaces itself (idempotent sink); restart
  state lives in the checkpoint folder.
* ``stream_monitor`` — every trigger: newest N log rows (by the log's zone
  maps) -> PSI report vs the stored baseline counts -> change flag of an
  adaptive window that goes on across triggers -> job gate -> job events.
* ``stream_psi_window`` — event-time windows, tumbling or sliding, with a
  watermark; ONE aggregation with ten conditional counts per feature, PSI as a
  row expression of those counts (no second stateful step).

Production sources are Kafka (``format("kafka")``); tests and the registered
queries use a file source over a landing folder written from the tables.
The baseline edges are a small bounded object (features x 9 numbers); they
are fetched once and inlined as literals, since streaming plans cannot hold
scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil import config as C
from vigil.functions.features import scorecard, stream_high_value
from vigil.operators.drift import baseline_counts, bin_of, psi_against, quantile_edges, to_long, valid_number
from vigil.operators.jobs import active_model, job_current, job_expire, job_gate
from vigil.operators.models import load_model, model_frame, score_batch
from vigil.sources.codec import json_decode
from vigil.sources.registry import active_run
from vigil.session import cut_lineage
from vigil.sources.logs import log_append, newest
from vigil.streaming.adwin_stream import adaptive_window_stream, use_rocksdb


# fixed value: the topic is read from its beginning
KAFKA_START = "earliest"


def payload_files(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Payload lines (column ``value``) of a landing folder, as a stream."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir)


def kafka_options(servers: str, topic: str, max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    """From the earliest offset on the first start; offsets that are lost stop the stream instead of being passed over."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": KAFKA_START, "failOnDataLoss": "true"}
    if max_offsets_per_trigger:
        out["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return out


def payload_topic(spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int | None = None) -> DataFrame:
    """The same from a Kafka topic (needs Spark's Kafka package on the cluster)."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic, max_offsets_per_trigger)).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def active_scorer(spark: SparkSession, runs_path: str, prefix: str, scorers: dict[str, Callable[[DataFrame], DataFrame]]
                  ) -> Callable[[], Callable[[DataFrame], DataFrame]]:
    """A lookup for ``stream_score``: the scorer of the run table's active model, read anew for each batch;
    a model type without a scorer, or no finished run, gets the built-in scorecard."""
    def lookup():
        row = active_model(spark.read.parquet(runs_path), prefix).first()
        return scorers.get(row["model_type"], default_scorer)
    return lookup


def model_scorer(model, canonical: list[str], predictive: list[str], version: str) -> Callable[[DataFrame], DataFrame]:
    """A scorer that encodes the payload fields as in training and applies a saved model; the row's own columns stay."""
    def score(df: DataFrame) -> DataFrame:
        present = [f for f in predictive if f in df.columns]
        rows = df
        for f in predictive:
            if f not in present:
                rows = rows.withColumn(f, F.lit(None).cast("double"))
        raw = F.struct(*[F.col(c) for c in df.columns])
        encoded = model_frame(rows.withColumn("_raw", raw), canonical, predictive, label=None, keep=["_raw"])
        return score_batch(model, encoded, "fraud_probability").select("_raw.*", "fraud_probability").withColumn("model_version", F.lit(version))
    return score


def registry_scorer(spark: SparkSession, registry: str) -> Callable[[], Callable[[DataFrame], DataFrame]]:
    """A lookup for ``stream_score``: encodes and scores with the registry's active run, asked anew for each batch
    (its model is loaded when it changes); the built-in scorecard where there is no run."""
    loaded: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def lookup():
        run = active_run(spark, registry)
        if run is None:
            return default_scorer
        if run["run_id"] not in loaded:
            loaded.clear()
            names = [[f for f in run["params"][k].split(",") if f] for k in ("canonical_features", "predictive_features")]
            loaded[run["run_id"]] = model_scorer(load_model(run["params"]["path"]), *names, run["run_id"])
        return loaded[run["run_id"]]

    return lookup


def default_scorer(df: DataFrame) -> DataFrame:
    """Score with the built-in scorecard (model version 'scorecard-v1')."""
    return df.withColumn("fraud_probability", scorecard()).withColumn("model_version", F.lit("scorecard-v1"))


def stream_score(spark: SparkSession, source: str | DataFrame, log_path: str, checkpoint: str,
                 scorer_lookup: Callable[[], Callable[[DataFrame], DataFrame]] | None = None,
                 available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the scoring stream over a landing folder or a payload stream; ``scorer_lookup()`` is called
    once per micro-batch (hot switch)."""
    lines = payload_files(spark, source, max_files_per_trigger) if isinstance(source, str) else source
    decoded = json_decode(lines, "value")
    flagged = decoded.withColumn("is_high_value", stream_high_value("price", "is_high_value"))
    lookup = scorer_lookup or (lambda: default_scorer)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        scorer = lookup()
        scored = scorer(batch).withColumn("timestamp", F.col("event_time"))
        log_append(scored, log_path, batch_id=batch_id)

    w = flagged.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


JOB_EVENT_SCHEMA = ("job_id string, psi_score double, adwin_change boolean, alert boolean, decision string, status string, "
                    "start_time timestamp, monitor_batch long")


def stream_monitor(spark: SparkSession, log_path: str, baseline: DataFrame, jobs_path: str, checkpoint: str,
                   recent: int = C.MONITOR_RECENT_ROWS, available_now: bool = True) -> StreamingQuery:
    """Every trigger: newest ``recent`` log rows -> PSI report and change flag -> expiry and gate -> job events.

    The baseline is counted once (features x bins numbers); the newest rows come from the files that can hold
    them; the change flag is that of one adaptive window over the prices of the log, kept as stream state.  The
    stream reads data files, so a batch that is written twice counts twice in that window, and nowhere else.
    A trigger writes one event for what it decided (with a status only if it opens a job) and one for every
    job that it expires; a trigger that runs again replaces its own.
    """
    use_rocksdb(spark)
    schema = "timestamp string, price double"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet") \
        .parquet(f"{log_path.rstrip('/')}/data")
    windows = adaptive_window_stream(stream.withColumn("_at", F.col("timestamp").try_cast("timestamp")), "price", "_at")
    counted = cut_lineage(baseline_counts(to_long(baseline, C.MONITORED_FEATURES), "value", keys=["feature"]), "monitor-baseline")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        latest = cut_lineage(newest(spark, log_path, recent), "monitor-newest")
        rep = psi_against(counted, latest, C.MONITORED_FEATURES)
        now = latest.agg(F.max(F.col("timestamp").cast("timestamp"))).scalar()
        flag = F.lit(bool(batch.agg(F.max("changed")).first()[0]))  # one row a series
        psi = F.coalesce(rep.select("psi").scalar(), F.lit(0.0))
        alert = F.coalesce(rep.select("alert").scalar(), F.lit(False))
        earlier = _job_events(spark, jobs_path).where(F.col("monitor_batch") != F.lit(batch_id))
        jobs = job_current(earlier, order_cols=("monitor_batch",), fields=["start_time", "status", "decision"])
        gate = job_gate(jobs, now, psi, flag).withColumns({"_psi": psi, "_flag": flag, "_alert": alert})
        opens = F.col("_alert") & (F.col("decision") == "OPEN")
        own = gate.select(F.lit(f"job_{batch_id}").alias("job_id"), F.col("_psi").alias("psi_score"), F.col("_flag").alias("adwin_change"),
                          F.col("_alert").alias("alert"), "decision", F.when(opens, F.lit("PENDING")).alias("status"),
                          F.when(opens, now).alias("start_time"))
        expired = job_expire(jobs, now).join(jobs.select("job_id", F.col("status").alias("_was")), "job_id") \
            .where((F.col("decision") == "ORPHANED_TIMEOUT") & (F.col("_was") != F.col("status"))) \
            .select("job_id", F.lit(None).cast("double").alias("psi_score"), F.lit(None).cast("boolean").alias("adwin_change"),
                    F.lit(None).cast("boolean").alias("alert"), "decision", "status", F.lit(None).cast("timestamp").alias("start_time"))
        events = cut_lineage(own.unionByName(expired), "monitor-events")  # read before the folder is replaced
        events.write.mode("overwrite").parquet(f"{jobs_path.rstrip('/')}/monitor_batch={batch_id}")

    w = windows.writeStream.outputMode("update").foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _job_events(spark: SparkSession, jobs_path: str) -> DataFrame:
    """The job events so far; none where no trigger has written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(jobs_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], JOB_EVENT_SCHEMA)
    return spark.read.schema(JOB_EVENT_SCHEMA).parquet(jobs_path)


def window_psi_edges(baseline: DataFrame, features: list[str]) -> dict:
    """Baseline edges and shares per feature, fetched once (features x buckets numbers)."""
    long = to_long(baseline, features)
    edges = quantile_edges(long, "value", keys=["feature"])
    binned = long.join(edges.select("feature", "edges"), "feature").where(valid_number("value")) \
        .select("feature", bin_of("value", "edges").alias("bin"))
    counts = binned.groupBy("feature", "bin").count()
    rows = {r["feature"]: list(r["edges"]) for r in edges.select("feature", "edges").collect()}
    totals: dict[str, dict[int, int]] = {}
    for r in counts.collect():
        totals.setdefault(r["feature"], {})[r["bin"]] = r["count"]
    out = {}
    for f in features:
        t = totals.get(f, {})
        n = sum(t.values())
        out[f] = (rows[f], [t.get(b, 0) / n if n else 0.0 for b in range(C.PSI_BUCKETS)])
    return out


def windowed_psi_frame(events: DataFrame, edges: dict, time_col: str, window: str,
                       watermark: str | None = None, slide: str | None = None) -> DataFrame:
    """One aggregation per event-time window: ten conditional counts per feature,
    then PSI as a row expression (works on batch and streaming frames alike).
    With ``slide`` shorter than ``window`` a row counts in several overlapping windows."""
    src = events.withWatermark(time_col, watermark) if watermark else events
    aggs = []
    for f, (e, _) in edges.items():
        b = bin_of(F.col(f).cast("double"), F.array(*[F.lit(float(x)) for x in e]))
        ok = F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
        aggs += [F.count_if(ok & (b == k)).alias(f"n_{f}_{k}") for k in range(C.PSI_BUCKETS)]
    agg = src.groupBy((F.window(time_col, window, slide) if slide else F.window(time_col, window)).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    per_feature = []
    for f, (_, shares) in edges.items():
        n = sum((F.col(f"n_{f}_{k}") for k in range(C.PSI_BUCKETS)), F.lit(0))
        terms = []
        for k in range(C.PSI_BUCKETS):
            a = F.col(f"n_{f}_{k}") / n
            a = F.when(a == 0, F.lit(C.PSI_FLOOR)).otherwise(a)
            e = F.lit(shares[k] if shares[k] != 0 else C.PSI_FLOOR)
            terms.append((a - e) * F.ln(a / e))
        per_feature.append(F.when(n > 0, sum(terms[1:], terms[0])).otherwise(F.lit(0.0)))
    psi = sum(per_feature[1:], per_feature[0]) / F.lit(float(len(per_feature)))
    return agg.select(F.col("w.start").alias("window_start"), "n_rows", psi.alias("psi"))


def stream_psi_window(spark: SparkSession, source_dir: str, schema, edges: dict, out_path: str, checkpoint: str,
                      time_col: str = "ts", window: str = "1 day", watermark: str = "1 day", slide: str | None = None,
                      mode: str = "update", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Windowed PSI over a file stream, tumbling or sliding; one folder per micro-batch (idempotent).

    ``mode="update"`` gives a window again whenever it has changed; ``mode="append"`` gives it once, when the
    watermark has passed its end, and never again.  A row is late if its time lies before the watermark of the
    trigger that reads it: every window that it belongs to and that ended before the watermark drops it
    (``late_rows`` counts such drops)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    frame = windowed_psi_frame(reader.parquet(source_dir), edges, time_col, window, watermark, slide)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
             .parquet(f"{out_path.rstrip('/')}/b={batch_id}")

    return (frame.writeStream.outputMode(mode).foreachBatch(each_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def late_rows(query: StreamingQuery) -> int:
    """How many times a window dropped a late row, over all triggers of a query."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
