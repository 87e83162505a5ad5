import threading

import pytest
from pyspark.sql import functions as F

from vigil.session import scratch_path
from vigil.sources import logs as L
from vigil.sources import registry as R
from vigil.sources.commits import CommitLog, Taken


def rows(spark, start, n, hot=None):
    """n rows from minute ``start`` on"""
    return spark.range(n).select(F.date_format(F.timestamp_seconds(F.lit(1_735_689_600) + (F.col("id") + start) * 60), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                                 (F.col("id") + start).cast("double").alias("price"))


def test_a_reader_during_a_replay_sees_the_old_or_the_new_batch(spark, monkeypatch):
    path = scratch_path(spark, "log")
    L.log_append(rows(spark, 0, 50), path, batch_id=7)
    L.log_append(rows(spark, 100, 10), path, batch_id=8)
    seen, write = [], L._write

    def slow(*a):
        out = write(*a)
        seen.append(L.read_log(spark, path).where("batch = 7").agg(F.count(F.lit(1)), F.max("price")).first())  # all data written, nothing committed
        return out

    monkeypatch.setattr(L, "_write", slow)
    L.log_append(rows(spark, 0, 30), path, batch_id=7)
    assert tuple(seen[0]) == (50, 49.0)
    assert tuple(L.read_log(spark, path).where("batch = 7").agg(F.count(F.lit(1)), F.max("price")).first()) == (30, 29.0)
    assert L.read_log(spark, path).count() == 40


def test_a_writer_that_dies_before_its_commit_leaves_nothing_visible(spark, monkeypatch):
    path = scratch_path(spark, "log")
    L.log_append(rows(spark, 0, 5), path, batch_id=1)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "_take", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            L.log_append(rows(spark, 100, 5), path, batch_id=2)
    assert L.read_log(spark, path).count() == 5
    L.log_append(rows(spark, 100, 5), path, batch_id=2)
    assert L.read_log(spark, path).count() == 10


def test_newest_rows_open_few_files(spark, monkeypatch):
    path = scratch_path(spark, "log")
    log = CommitLog(spark, f"{path}/commits")
    L.log_append(rows(spark, 0, 40), path, batch_id="first")
    entry = log.entries()[0]
    # a log of 1,000 older batches: entries that share the first one's files, as only the latest ones must be opened
    for k in range(1, 250):
        log.commit({**entry, "batch": f"old-{k}"}, k)
    for k in range(4):
        L.log_append(rows(spark, 10_000 + 30 * k, 30), path, batch_id=k)
    got = L.newest(spark, path, 50)
    assert sorted(r.price for r in got.collect()) == [float(10_000 + i) for i in range(70, 120)]
    assert {r["batch"] for r in got.select("batch").distinct().collect()} == {"2", "3"}
    assert len(got.inputFiles()) <= 4
    assert len([n for n in log._names() if n.endswith(".snapshot")]) == 2
    none = scratch_path(spark, "log")
    L.log_append(rows(spark, 0, 3).withColumn("timestamp", F.lit(None).cast("string")), none, batch_id=1)
    assert L.newest(spark, none, 5).collect() == []


def test_compaction_keeps_the_rows_and_ends_replays(spark):
    path = scratch_path(spark, "log")
    for k in range(5):
        L.log_append(rows(spark, 100 * k, 20), path, batch_id=k)
    before = sorted((r.batch, r.price) for r in L.read_log(spark, path).collect())
    assert L.compact(spark, path) == 5
    assert sorted((r.batch, r.price) for r in L.read_log(spark, path).collect()) == before
    live, covered = L.live_batches(CommitLog(spark, f"{path}/commits").entries())
    assert len(live) == 1 and covered == {"0", "1", "2", "3", "4"}
    L.log_append(rows(spark, 100, 20), path, batch_id=1)  # a replay of what the compaction has taken in
    assert sorted((r.batch, r.price) for r in L.read_log(spark, path).collect()) == before
    assert L.compact(spark, path) == 0


def test_a_hot_date_is_split(spark):
    path = scratch_path(spark, "log")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        wide = spark.range(40_000).select(F.lit("2025-01-01 00:00:00").alias("timestamp"), F.rand(1).alias("price"))
        L.log_append(wide.repartition(4), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(L.read_log(spark, path).inputFiles()) > 2 and L.read_log(spark, path).count() == 40_000


def test_of_two_writers_one_wins(spark):
    folder = scratch_path(spark, "commits")
    log = CommitLog(spark, folder)
    log.commit({"n": 0}, 0)
    with pytest.raises(Taken):
        log.commit({"n": "second"}, 0)
    assert log.entries() == [{"n": 0}]
    wins, start = [], threading.Barrier(4)

    def write(k):
        start.wait()
        try:
            CommitLog(spark, folder).commit({"n": k}, 1)
            wins.append(k)
        except Taken:
            pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(wins) == 1 and log.entries() == [{"n": 0}, {"n": wins[0]}]


def test_registry_switches_once(spark):
    folder = scratch_path(spark, "registry")
    assert R.active_run(spark, folder) is None and R.run_table(spark, folder).collect() == []
    R.register_run(spark, folder, "a", "fraud", "FINISHED", {"model_type": "gbt"}, {"auc": 0.8})
    R.register_run(spark, folder, "b", "fraud", "RUNNING", {})
    assert R.active_run(spark, folder)["run_id"] == "a"
    with pytest.raises(ValueError):
        R.switch_active(spark, folder, "b", None)
    R.register_run(spark, folder, "b", "fraud", "FINISHED", {"k": 1}, {"auc": 0.9, "f1": None})
    assert R.switch_active(spark, folder, "a", None) and R.switch_active(spark, folder, "b", "a")
    assert not R.switch_active(spark, folder, "a", "a")  # b is the active one by now
    table = {r.run_id: r for r in R.run_table(spark, folder).collect()}
    assert table["b"].is_active and not table["a"].is_active and table["b"].metrics == {"auc": 0.9} and table["b"].params == {"k": "1"}
