"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's signs against random directions are concatenated into a key;
all vectors are ordered by (label, key) and each is compared with its next ``window``
neighbours.  Verified pairs of all passes are united into components.  The order of a
pass is cut into tiles of bounded size, each with the last ``window`` rows of the tile
before it, so no pair is lost at a border and no task holds a label as a whole.

The windows only have to connect a component; the number of links is then counted over
all pairs of its members.  Members within half the angle of the threshold from the
component's first vector all link with each other and are counted without comparing;
the others are sorted into rings by their angle to that vector, and only blocks of neighbouring
rings are compared.

The number of passes follows the size of the largest label by one rule: see ``passes_for``.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do those without a label or id; vectors of any length take part, and link
with those of their own length only; of rows that repeat an id the smallest vector counts, and every row gets the
id's result; rows without an id have a null component and are kept; an empty table gives
no rows; other input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Stored
from vigil.llm.components import connected_components
from vigil.llm.vectors import by_length, directions, matrix, row_cosines, taking_part, unit

SIMILARITY = 0.98
PASSES = 12
MISSED = 3e-4    # see ``passes_for``
WINDOW = 32
KEY_BITS = 60
TILE = 512       # rows of a pass compared in one go
MEMBERS = 256    # members of a component compared in one go
RING_BLOCKS = 1 << 20   # most blocks of a ring
SEED = 7


def sorted_positions(vectors: DataFrame, passes: int = PASSES) -> DataFrame:
    """(turn, label, id, position): the place of every vector in one order over all passes."""
    def keys(batches):
        for b in batches:
            for at, v in by_length(b.column(2)):
                ids, labels = (b.column(i).take(pa.array(at)) for i in (0, 1))
                for t in range(passes):
                    bits = v @ directions(KEY_BITS, v.shape[1], SEED + t) > 0
                    key = bits.astype(np.int64) @ (np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), labels, pa.array(key), ids], ["turn", "label", "key", "id"])

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows, dtype=np.int64))],
                                             ["turn", "label", "id", "part", "place"])
            at += b.num_rows

    order = ["turn", "label", "key", "id"]
    keyed = Stored(vectors.select("id", "label", "v").mapInArrow(keys, "turn int, label string, key long, id long"), "projection-keys").df
    placed = Stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("turn", "label", "id")
                    .mapInArrow(number, "turn int, label string, id long, part int, place long"), "projection-order").df
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    return placed.join(offsets, F.col("part") == F.col("_part")).select("turn", "label", "id", (F.col("offset") + F.col("place")).alias("position"))


def window_links(vectors: DataFrame, positions: DataFrame, similarity: float = SIMILARITY, window: int = WINDOW) -> DataFrame:
    """(a, b): verified pairs, as many as it takes to connect what the windows link."""
    place = F.col("position")
    tiles = positions.join(vectors.select(F.col("id").alias("_id"), "v"), F.col("id") == F.col("_id")).select(
        "turn", "label", "id", "position", "v",
        F.explode(F.when(place % TILE >= TILE - window, F.array(F.floor(place / TILE), F.floor(place / TILE) + 1)).otherwise(F.array(F.floor(place / TILE)))).alias("tile"))

    def compare(rows):
        turn, label, ids = rows[0].to_numpy(), np.asarray(rows[1].to_pylist(), object), rows[2].to_numpy()
        cuts = np.flatnonzero((turn[1:] != turn[:-1]) | (label[1:] != label[:-1])) + 1
        pairs = []
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):  # one pass, one label, one length
            v = unit(matrix(rows[4].slice(a, z - a)))
            for d in range(1, min(window, z - a - 1) + 1):
                hit = np.flatnonzero(np.einsum("ij,ij->i", v[:-d], v[d:]) >= similarity)
                pairs += [(a + i, a + i + d) for i in hit.tolist()]
        root = list(range(len(ids)))

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in pairs:
            x, y = find(i), find(j)
            if x != y:
                root[y] = x
                yield ids[i], ids[j]

    def run(batches):
        for rows in _groups(batches, 5):
            found = list(compare(rows))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return tiles.repartition("tile").sortWithinPartitions("tile", "position").select("turn", "label", "id", "position", "v", "tile") \
        .mapInArrow(run, "a long, b long").distinct()


def _groups(batches, key: int):
    """The columns of each run of rows with one key, from batches sorted by it."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        keys = held.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, z in zip([0, *cuts], cuts):
            yield [c.combine_chunks() for c in held.slice(a, z - a).columns]
        if len(cuts):
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield [c.combine_chunks() for c in held.columns]


def link_counts(vectors: DataFrame, parts: DataFrame, similarity: float = SIMILARITY, members: int = MEMBERS) -> DataFrame:
    """(id, component, n_links) of every member of a component."""
    half = math.sqrt((1 + similarity) / 2) + 1e-9  # cosine of half the angle, with room for rounding
    ring = math.acos(similarity) * (1 + 1e-6) + 1e-6  # angles to the first vector of two that link differ by less

    def angle(batches):
        for b in batches:
            cosine = row_cosines(b.column(2), b.column(3))
            rings = np.floor(np.arccos(np.clip(cosine, -1, 1)) / ring).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cosine >= half), pa.array(rings)], ["id", "component", "near", "ring"])

    first = vectors.select(F.col("id").alias("_first"), F.col("v").alias("w"))
    own = parts.join(vectors.select("id", "v"), F.col("node") == F.col("id")).select("id", "component", "v")
    placed = Stored(own.join(first, F.col("component") == F.col("_first")).select("id", "component", "v", "w")
                    .mapInArrow(angle, "id long, component long, near boolean, ring int"), "member-angles").df
    far = F.struct("ring", F.ceil(F.col("n") / F.lit(members)).cast("int").alias("blocks"))
    sizes = placed.groupBy("component", "near", "ring").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(
        F.sum(F.when(F.col("near"), F.col("n")).otherwise(0)).alias("n_near"), F.sum(F.when(F.col("near"), 0).otherwise(F.col("n"))).alias("n_far"),
        F.map_from_entries(F.collect_list(F.when(~F.col("near"), far))).alias("rings"))  # 180 degrees / ring entries at most
    sizes = Stored(sizes, "member-counts").df
    sized = placed.join(sizes.withColumnRenamed("component", "_c"), F.col("component") == F.col("_c"))

    # far members, in blocks of their ring (from 0 on), meet those of the next rings; near ones (blocks -1, -2, ...)
    # are within half the angle and can only link with far ones of the first two rings
    def blocks_of(ring_number) -> Column:
        n = F.coalesce(F.try_element_at("rings", ring_number), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: ring_number * F.lit(RING_BLOCKS) + i)).otherwise(F.array().cast("array<int>"))

    near_blocks = F.ceil(F.col("n_near") / F.lit(members)).cast("int")
    here = F.coalesce(F.try_element_at("rings", F.col("ring")), F.lit(1))
    own_block = F.when(F.col("near"), -1 - F.pmod(F.xxhash64("id"), near_blocks)) \
        .otherwise(F.col("ring") * F.lit(RING_BLOCKS) + F.pmod(F.xxhash64("id"), here)).cast("int")
    among_near = F.when((F.col("ring") <= 1) & (near_blocks > 0), F.transform(F.sequence(F.lit(1), near_blocks), lambda x: -x)).otherwise(F.array().cast("array<int>"))
    partners = F.when(F.col("near"), F.concat(blocks_of(F.lit(0)), blocks_of(F.lit(1)))) \
        .otherwise(F.concat(blocks_of(F.col("ring") - 1), blocks_of(F.col("ring")), blocks_of(F.col("ring") + 1), among_near))
    dealt = sized.where("n_far > 0").select("id", "component", own_block.alias("block"), partners.alias("partners")) \
        .select("id", "component", "block", F.explode("partners").alias("other")) \
        .select("id", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def count(batches):
        for rows in _groups(batches, 3):
            ids, block, v = rows[0].to_numpy(), rows[1].to_numpy(), unit(matrix(rows[2]))
            low, high = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
            hit = v[low] @ v[high].T >= similarity
            hit &= ids[low][:, None] != ids[high][None, :]
            n = dict(zip(ids[low].tolist(), hit.sum(axis=1).tolist()))
            if block.min() != block.max():
                n |= dict(zip(ids[high].tolist(), hit.sum(axis=0).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.int64()), pa.array(list(n.values()), pa.int64())], ["id", "n"])

    compared = dealt.join(vectors.select(F.col("id").alias("_id"), "v"), F.col("id") == F.col("_id")) \
        .withColumn("tile", F.concat_ws("/", "component", "low", "high")) \
        .select("id", "block", "v", "tile").repartition("tile").sortWithinPartitions("tile", "id") \
        .mapInArrow(count, "id long, n long")
    all_near = sized.where("near").select("id", (F.col("n_near") - 1).alias("n"))
    counted = compared.unionByName(all_near).groupBy("id").agg(F.sum("n").alias("n_links"))
    return placed.select("id", "component").join(counted.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left") \
        .select("id", "component", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def passes_for(rows: int, similarity: float = SIMILARITY, window: int = WINDOW) -> int:
    """Passes after which an isolated pair of exactly this similarity is missed with a chance of ``MISSED``
    at most, among ``rows`` vectors of a label; ``PASSES`` at least.

    Two vectors agree in a key bit with chance 1 - angle / pi, and stand in one window of a pass if they agree in
    about the first log2(rows / window) bits; so the passes grow with a small power of the rows."""
    agree = 1 - math.acos(similarity) / math.pi
    found = agree ** max(0.0, math.log2(max(rows, 1) / window))
    return max(PASSES, math.ceil(math.log(MISSED) / math.log1p(-min(found, 1 - 1e-9))))


def near_duplicates(embeddings: DataFrame, similarity: float = SIMILARITY, passes: int | None = None, window: int = WINDOW,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    taken = taking_part(embeddings, id_col, vector_col, [embeddings[label_col].cast("string").alias("label")]).where("label is not null")
    # vectors of different lengths have no cosine: the length is part of the label
    vectors = Stored(taken.withColumn("label", F.concat_ws("/", F.size("v").cast("string"), "label")), "dedup-vectors").df
    if passes is None:
        largest = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
        passes = passes_for(largest or 0, similarity, window)
    links = Stored(window_links(vectors, sorted_positions(vectors, passes), similarity, window), "dedup-links").df
    parts = Stored(connected_components(links), "dedup-parts").df
    counts = Stored(link_counts(vectors, parts, similarity), "dedup-counts").df
    ids = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"))
    out = ids.join(counts, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
