"""Inference log and report sinks.

The log is a folder of batches.  A batch's rows are written under ``data/<random name>``,
partitioned by date, and become visible by one entry of the commit log (``commits/``); a batch
that is written again becomes visible in place of its earlier self, at once.  Each batch
also has a zone map: rows and first and last time of every file.  ``newest`` reads the files
that can hold one of the newest rows and no other; ``compact`` merges many small batches.
Absent columns are added with their declared types before each append, and reads merge the
schemas.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import config as C
from vigil.sources.commits import CommitLog


def log_evolve(df: DataFrame, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """Add every declared log column that is absent (typed NULL); cast present ones."""
    columns = columns or C.LOG_COLUMNS
    out = []
    for name, typ in columns:
        out.append((F.col(name).cast(typ) if name in df.columns else F.lit(None).cast(typ)).alias(name))
    extra = [F.col(c) for c in df.columns if c not in dict(columns)]
    return df.select(*out, *extra)


# ------------------------------------------------------------------ batches

FOLDER = "commit_folder"   # name of the partition that a batch's folder is

def _micros(time_col: str):
    return F.unix_micros(F.col(time_col).try_cast("timestamp"))


def _commits(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, f"{path.rstrip('/')}/commits")


def live_batches(entries: list[dict]) -> tuple[dict[str, dict], set[str]]:
    """The visible entry of each batch, and the batches that a compaction has taken in."""
    live: dict[str, dict] = {}
    covered: set[str] = set()
    for e in entries:
        for b in e.get("covers", []):
            live.pop(b, None)
            covered.add(b)
        live[e["batch"]] = e
    return live, covered


def _write(rows: DataFrame, path: str, time_col: str, partition_col: str) -> dict:
    """Writes rows and their zone map; gives the part of the entry that describes them."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/data/{FOLDER}={name}"
    # dates are kept together, and a date that is too much for one task is split by size
    rows.hint("rebalance", partition_col).write.partitionBy(partition_col).parquet(folder)
    t = _micros(time_col)
    zones = f"{path.rstrip('/')}/zones/{name}"
    spark.read.parquet(folder).groupBy(F.input_file_name().alias("file")) \
        .agg(F.count(t).alias("rows"), F.min(t).alias("first"), F.max(t).alias("last")).write.parquet(zones)
    s = spark.read.parquet(zones).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"),
                                      F.count(F.lit(1)).alias("files")).first()
    return {"folder": name, **s.asDict()}


def log_append(df: DataFrame, path: str, time_col: str = "timestamp", partition_col: str = "log_date",
               batch_id: str | int = 0) -> None:
    """Add scored rows (evolved to the log schema, with their ``batch``) as one batch, partitioned by date.

    A batch that is written again replaces itself, so a retried write doubles nothing; once a compaction
    has taken a batch in, writing it again changes nothing."""
    rows = log_evolve(df.drop("batch")).withColumns({"batch": F.lit(str(batch_id)), partition_col: F.to_date(F.col(time_col))})
    spark = df.sparkSession
    if str(batch_id) in live_batches(_commits(spark, path).entries())[1]:
        return
    written = _write(rows, path, time_col, partition_col)

    def decide(entries: list[dict]) -> dict | None:
        return None if str(batch_id) in live_batches(entries)[1] else {"batch": str(batch_id), **written}

    _commits(spark, path).update(decide)


def _read(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """Rows of folders or files below ``data``; the dates come from the folders' names."""
    base = f"{path.rstrip('/')}/data"
    return spark.read.option("mergeSchema", "true").option("basePath", base).parquet(*parts).drop(FOLDER)


def _folders(path: str, entries) -> list[str]:
    return [f"{path.rstrip('/')}/data/{FOLDER}={e['folder']}" for e in entries]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all visible batches (a folder without commits is read as plain Parquet)."""
    entries = _commits(spark, path).entries()
    if not entries:
        return spark.read.option("mergeSchema", "true").parquet(path)
    return _read(spark, path, sorted(set(_folders(path, live_batches(entries)[0].values()))))


def _floor(sizes: list[tuple[int, int]], n: int) -> int | None:
    """The latest time from which on there are ``n`` rows for certain, of (rows, first time) pieces; None if there are
    fewer rows."""
    for rows, first in sorted(sizes, key=lambda s: -s[1]):
        n -= rows
        if n <= 0:
            return first
    return None


def newest(spark: SparkSession, path: str, n: int, time_col: str = "timestamp") -> DataFrame:
    """The ``n`` newest rows that have a time (ties by a hash of the row), from the files that can hold one of them:
    batches are left out by their entries, files by the zone maps."""
    live = [e for e in live_batches(_commits(spark, path).entries())[0].values() if e["rows"]]
    start = _floor([(e["rows"], e["first"]) for e in live], n)
    chosen = [e for e in live if start is None or e["last"] >= start]
    if not chosen:
        return read_log(spark, path).where("false")
    zones = spark.read.parquet(*sorted({f"{path.rstrip('/')}/zones/{e['folder']}" for e in chosen})).where("rows > 0")
    latest = zones.orderBy(F.desc("first")).limit(n).select("rows", "first").collect()  # n files hold n rows
    start = _floor([(r["rows"], r["first"]) for r in latest], n)
    files = [r["file"] for r in (zones if start is None else zones.where(F.col("last") >= F.lit(start))).select("file").collect()]
    rows = _read(spark, path, files)
    return rows.where(_micros(time_col).isNotNull()).orderBy(_micros(time_col).desc(), F.xxhash64(*rows.columns)).limit(n)


def compact(spark: SparkSession, path: str, rows_below: int = 1_000_000, time_col: str = "timestamp", partition_col: str = "log_date") -> int:
    """Merges all visible batches of fewer than ``rows_below`` rows into one; gives how many.

    Readers see them or the merged one.  If a batch is written again meanwhile, nothing changes."""
    log = _commits(spark, path)
    small = [e for e in live_batches(log.entries())[0].values() if e["rows"] < rows_below]
    if len(small) < 2:
        return 0
    rows = _read(spark, path, _folders(path, small))
    written = _write(rows, path, time_col, partition_col)

    def decide(entries: list[dict]) -> dict | None:
        live = live_batches(entries)[0]
        same = all(live.get(e["batch"], {}).get("folder") == e["folder"] for e in small)
        return {"batch": f"compact-{written['folder']}", "covers": [e["batch"] for e in small], **written} if same else None

    return len(small) if log.update(decide) else 0


def report_sink(df: DataFrame, path: str) -> None:
    """Telemetry / statistics as JSON lines."""
    df.write.mode("overwrite").json(path)
