"""Sharding through fixed virtual slots.

Every record hashes into one of ``n_slots`` virtual slots; the slots' bytes are
aggregated, and a stored, versioned slot-to-shard map says which shard holds a
slot.  Version 1 deals the slots out in turn.  Rebalancing edits it: a shard
keeps its largest slots up to the mean load, the slots above it move, largest
first, to the shard with the least bytes (version 2).  Adding a shard is an edit
as well: slots move only into the new shard.  DataFrame functions only.

Law ``bytes``: shard sizes differ by about one small slot.

Defined cases: null text counts no bytes (size 8, checksum of the empty text);
records hash by (id, text), so rows of one id need not share a slot; rows without an
id also by their place in the input, so equal ones spread; ties in a slot are ordered by id, checksum and size
(rows equal in all three are interchangeable); an empty table gives no rows;
further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import Stored

N_SLOTS = 4096
N_SHARDS = 24
ROW_OVERHEAD = 8


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot): what the slots need of each record."""
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    # rows without an id may be equal in all that is hashed: their place in the input tells them apart (the records
    # are stored, so it is read once)
    apart = F.when(docs["doc_id"].isNull(), F.monotonically_increasing_id())
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.length(raw) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64(docs["doc_id"], docs["text"], apart), F.lit(n_slots)).cast("int").alias("vslot"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """(vslot, n_rows, n_bytes): at most ``n_slots`` rows."""
    return rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))


def initial_map(spark: SparkSession, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1: the slots dealt out in turn."""
    return spark.range(0, n_slots, 1, 1).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"),
        (F.col("id") % F.lit(n_shards)).cast("int").alias("shard"))


def _with_loads(slot_map: DataFrame, loads: DataFrame, version: int) -> DataFrame:
    return slot_map.where(F.col("version") == F.lit(version)).join(loads, "vslot", "left").select(
        "vslot", "shard", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"))


def rebalance(slot_map: DataFrame, loads: DataFrame, version: int, n_shards: int = N_SHARDS) -> DataFrame:
    """The map's next version (all slots): slots above a shard's fair load move.

    The fold over the moving slots runs in one row, which holds at most ``n_slots`` entries however
    large the table is."""
    now = _with_loads(slot_map, loads, version)
    by_size = Window.partitionBy("shard").orderBy(F.desc("n_bytes"), "vslot")
    marked = now.withColumn("fair", F.sum("n_bytes").over(Window.partitionBy()) / F.lit(n_shards))
    marked = marked.withColumn("stays", F.sum("n_bytes").over(
        by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= F.col("fair"))
    start = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.aggregate(
        F.col("kept"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == s, x["n_bytes"]).otherwise(F.lit(0))))
    folded = marked.agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("n_bytes")).alias("neg"), "vslot")))).alias("moving"),
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "n_bytes"))).alias("kept"))

    def place(acc, x):
        loads_now = F.transform(acc["loads"], lambda v, k: F.when(k == acc["least"], v - x["neg"]).otherwise(v))
        return F.struct(loads_now.alias("loads"),
                        (F.array_position(loads_now, F.array_min(loads_now)) - F.lit(1)).cast("int").alias("least"),
                        F.concat(acc["placed"], F.array(acc["least"])).alias("placed"))

    first = folded.select("moving", start.alias("loads")).select(
        "moving", F.struct(F.col("loads").alias("loads"),
                           (F.array_position("loads", F.array_min("loads")) - F.lit(1)).cast("int").alias("least"),
                           F.array().cast("array<int>").alias("placed")).alias("acc0"))
    moved = first.select("moving", F.aggregate("moving", F.col("acc0"), place, lambda a: a["placed"]).alias("to")) \
        .select(F.explode(F.arrays_zip(F.col("moving.vslot").alias("vslot"), F.col("to").alias("to"))).alias("m")) \
        .select(F.col("m.vslot").alias("vslot"), F.col("m.to").alias("to"))
    return now.join(moved, "vslot", "left").select(
        F.lit(version + 1).alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"))


def add_shard(slot_map: DataFrame, loads: DataFrame, version: int, n_shards: int = N_SHARDS) -> DataFrame:
    """The next version with one more shard (number ``n_shards``): each old shard gives up slots, in
    the order of their hash, worth its part of the new shard's fair load; no other slot moves."""
    now = _with_loads(slot_map, loads, version)
    up = Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum("n_bytes").over(Window.partitionBy("shard")) / F.lit(n_shards + 1)
    return now.withColumn("_gives", F.sum("n_bytes").over(up) <= share).select(
        F.lit(version + 1).alias("version"), "vslot",
        F.when(F.col("_gives"), F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def assign(rows: DataFrame, loads: DataFrame, slot_map: DataFrame, version: int) -> DataFrame:
    """Shard and place in the shard (gapless from 0) of every record.

    A record's place is its slot's offset in the shard plus its rank in the slot, so no task sorts a
    whole shard: windows hold one virtual slot."""
    placed = slot_map.where(F.col("version") == F.lit(version)).join(loads, "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("n_rows").over(
            Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).cast("long").alias("offset"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(placed, "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + rank - F.lit(1)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    """All records with shard and place; the narrow records, the loads and the map are stored tables."""
    spark = docs.sparkSession
    rows = Stored(records(docs, n_slots), "shard-records").df
    loads = Stored(slot_loads(rows).coalesce(1), "slot-loads").df
    first = Stored(initial_map(spark, n_slots, n_shards), "slot-map-v1").df
    edited = Stored(rebalance(first, loads, 1, n_shards).coalesce(1), "slot-map-v2").df
    return assign(rows, loads, first.unionByName(edited), 2)
