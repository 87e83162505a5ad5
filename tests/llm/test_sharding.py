import zlib

from pyspark.sql import functions as F

from tests.llm.helpers import awkward, awkward_rows, empty
from vigil.llm import sharding as S


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = S.shard_documents(awkward(spark)).collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == want
    assert all(0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_empty_table(spark):
    assert S.shard_documents(empty(spark)).collect() == []


def test_shards_are_near_equal_and_rebalancing_keeps_most_slots(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 900).cast("int")).alias("text"))
    rows = S.records(docs, 512)
    loads = S.slot_loads(rows).cache()
    one = S.initial_map(spark, 512, 8)
    two = S.rebalance(one, loads, 1, 8)
    moved = one.alias("a").join(two.alias("b"), "vslot").where("a.shard <> b.shard").count()
    assert two.count() == 512 and moved < 256
    sums = [r[0] for r in two.join(loads, "vslot").groupBy("shard").agg(F.sum("n_bytes")).select("sum(n_bytes)").collect()]
    assert len(sums) == 8 and (max(sums) - min(sums)) / (sum(sums) / 8) < 0.01


def test_a_new_shard_takes_slots_only_into_itself(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    loads = S.slot_loads(S.records(docs, 256)).cache()
    one = S.initial_map(spark, 256, 4)
    more = S.add_shard(one, loads, 1, 4)
    changes = one.alias("a").join(more.alias("b"), "vslot").where("a.shard <> b.shard").select("b.shard").collect()
    assert changes and {r.shard for r in changes} == {4} and len(changes) < 256 / 4


def test_the_law_holds_for_the_querys_own_rows(spark):
    """bytes near equal over the 24 shards, slots gapless; a third of the rows have no id and one text"""
    docs = spark.range(60_000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"),
                                      F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(F.repeat(F.lit("é"), (F.col("id") * 37 % 90).cast("int"))).alias("text"))
    out = S.shard_documents(docs.repartition(5))
    sums = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 24 and (max(sums) - min(sums)) / (sum(sums) / 24) < 0.01
    gaps = out.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("z"), F.count_distinct("slot").alias("k"), F.count(F.lit(1)).alias("n"))
    assert gaps.where("a <> 0 OR z <> n - 1 OR k <> n").count() == 0 and out.count() == 60_000
