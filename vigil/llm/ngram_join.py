"""Similarity join of documents by Jaccard over word 5-grams, exact.

1. ``facts``: one pass over the texts gives every document's number of distinct
   shingles and its class (equal shingle sets are one class), and a fixed-size table
   of shingle document counts.  All later work is on classes.
2. ``signatures``: a class's shingles are put into one global order, rare ones (by
   the count table) first.  Kept are the prefix that any partner of similarity t must
   share a shingle with, a hashed bitmap as wide as the set needs, and three minima of
   rehashed shingles.
3. Stars: classes with an equal minimum are compared with one centre of them.  This
   joins large groups of near copies with few comparisons.
4. Tiles: classes that share a prefix shingle, in size order, so that a class meets
   only the band of sizes that can reach t; a pair must pass the bound that the
   shingle's places in both orders set.  Components are what is compared: of every two that
   meet, first one pair, the one whose bitmaps leave most room, is verified, then a few more,
   then all, and a component first meets only its nearest ones; what links is united before the next
   step (see ``tile_components``).  A long
   run of one shingle is cut into blocks, and its largest component is only met by the
   other rows.
5. Every pair, of a star or inside a tile, is checked by its bitmaps before it goes on:
   bits set in one and not in the other bound the overlap from above.  What passes is
   decided by intersecting the sorted shingle arrays, recomputed from the texts.

Components of the links are the result.  The tiles find every pair that reaches t, so
no link between components is lost; the count table and the order change only the work.

Defined cases: a text of fewer than five words is one shingle; null, empty and blank
texts have no shingles and link with nothing; rows without an id have n_shingles and a
null component; rows that share an id are one node, whatever their texts; repeated rows
come out repeated; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Stored, has_rows
from vigil.llm.components import connected_components
from vigil.llm.shingles import mix, shingle_sets

SIMILARITY = (80, 100)   # links need 100 * intersection >= 80 * union
COUNT_BITS = 22          # slots of the count table; more slots tell more frequent shingles apart
BLOCK = 1 << 14          # slots a row of the stored table
STARS = 3
RUN = 1 << 14            # rows of one prefix shingle that a task compares in one go
OFFERS = 4               # pairs that the tiles offer for each two components before one of them is known to link
PARTNERS = 3             # components that a component is offered to first; a nearest one mostly links
SHORT = 32               # rows of a tile up to which all its distances are compared at once
CHUNK_BYTES = 1 << 22    # bitmaps compared at once
MIN_BITS, MAX_BITS = 256, 1 << 18


# --- numbers -------------------------------------------------------------------------------------------------

def least_overlap(size_a, size_b, num: int, den: int):
    """The smallest overlap with which two sets of these sizes link."""
    return -(-num * (size_a + size_b) // (num + den))


def prefix_lengths(n: int, num: int, den: int) -> tuple[int, int]:
    """How many shingles, in the global order, must hold one that any partner has, and any partner of at
    least this size."""
    return n - -(-num * n // den) + 1, n - -(-2 * num * n // (num + den)) + 1


def class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit per shingle, at its hash modulo the width: the next power of two over eight times the size."""
    width = min(MAX_BITS, max(MIN_BITS, 1 << (8 * len(shingles) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(mix(shingles) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def fold(bits: bytes, width: int) -> np.ndarray:
    """The bitmap of the same set at a narrower width (in bytes), as 64-bit words."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0).view(np.uint64)


def overlap_bound(map_a: bytes, size_a: int, map_b: bytes, size_b: int) -> int:
    """An upper bound of the overlap; the wider bitmap is folded to the narrower width."""
    a, b = (fold(x, min(len(map_a), len(map_b))) for x in (map_a, map_b))
    return min(size_a - int(np.bitwise_count(a & ~b).sum()), size_b - int(np.bitwise_count(b & ~a).sum()))


def sorted_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0


def _slices(batches, rows: int = 1024):
    """Smaller batches: a batch's texts become Python strings as a whole."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


# --- passes over the texts -----------------------------------------------------------------------------------

def facts(docs: DataFrame) -> DataFrame:
    """Document rows (doc_id, n_shingles, class) and, from each task, rows (block, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(1 << COUNT_BITS, np.int32)
        for b in _slices(batches):
            n, ids, waiting, held = [], [], [], 0
            for s in shingle_sets(b.column(1).to_pylist()):
                n.append(len(s))
                ids.append(class_id(s) if len(s) else None)
                waiting.append((s >> np.uint64(64 - COUNT_BITS)).astype(np.int64))
                held += len(s)
                if held > 1 << 20:
                    counts += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.int32)
                    waiting, held = [], 0
            if waiting:
                counts += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()),
                                              pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], schema=schema)
        rows = [(i, zlib.compress(counts[i * BLOCK:(i + 1) * BLOCK].tobytes(), 1)) for i in range(len(counts) // BLOCK) if counts[i * BLOCK:(i + 1) * BLOCK].any()]
        if rows:
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")) \
        .mapInArrow(run, "doc_id long, n_shingles long, class long, block int, counts binary")


def count_levels(stored_facts: DataFrame) -> np.ndarray:
    """A byte per slot: how frequent its shingles are, on a logarithmic scale.  The table has a fixed size."""
    def add(batches):
        block, total = None, None
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i != block:
                    if block is not None:
                        yield _row(block, total)
                    block, total = i, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(zlib.decompress(raw), np.int32)
        if block is not None:
            yield _row(block, total)

    def _row(block, total):
        level = np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "levels"])

    levels = np.zeros(1 << COUNT_BITS, np.uint8)
    rows = stored_facts.where("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block") \
        .mapInArrow(add, "block int, levels binary")
    for r in rows.collect():  # at most 2 ** COUNT_BITS / BLOCK rows
        levels[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["levels"], np.uint8)
    return levels


def signatures(docs: DataFrame, levels: np.ndarray, num: int, den: int) -> DataFrame:
    """(class, n, prefix, bits, minima): prefix in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(levels.tobytes())

    def run(batches):
        level = np.frombuffer(shared.value, np.uint8)
        turn = mix(np.arange(1, STARS + 1, dtype=np.uint64)) | np.uint64(1)
        for b in _slices(batches):
            out = []
            for s in shingle_sets(b.column(0).to_pylist()):
                if len(s):
                    order = (level[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                    first = np.argsort(order, kind="stable")[:prefix_lengths(len(s), num, den)[0]]
                    out.append((class_id(s), len(s), s[first].view(np.int64), bitmap(s), [int((s * t).min().view(np.int64)) for t in turn]))
                if len(out) == 1024:
                    yield _signature_rows(out)
                    out = []
            if out:
                yield _signature_rows(out)

    return docs.select(docs["text"].alias("text")).mapInArrow(run, "class long, n long, prefix array<long>, bits binary, minima array<long>")


def _signature_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["class", "n", "prefix", "bits", "minima"])


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, shingles) of the wanted (class, rep): sorted hashes, from the text of the row ``rep``."""
    def run(batches):
        for b in _slices(batches):
            want, out = b.column(0).to_pylist(), []
            for w, s in zip(want, shingle_sets(b.column(1).to_pylist())):
                if len(s) and class_id(s) == w:
                    out.append((w, s.tobytes()))
                if len(out) == 512:
                    yield _set_rows(out)
                    out = []
            if out:
                yield _set_rows(out)

    def _set_rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["class", "shingles"])

    texts = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].alias("_text"))
    # the same plan at every size: texts are sorted and merged, whether the wanted ids are few or many
    return texts.join(wanted.hint("merge"), F.col("_id") == F.col("rep")).select("class", F.col("_text").alias("text")) \
        .mapInArrow(run, "class long, shingles binary")


# --- pairs ---------------------------------------------------------------------------------------------------

def star_pairs(sigs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): each class with the centre of every minimum it shares, if their sizes allow a link."""
    keys = sigs.select("class", "n", F.posexplode("minima").alias("turn", "least"))
    centre = keys.groupBy("turn", "least").agg(F.min(F.struct("class", "n")).alias("c"), F.count(F.lit(1)).alias("_k")) \
        .where(F.col("_k") > F.lit(1)).select(F.col("turn").alias("_turn"), F.col("least").alias("_least"), "c")
    centre = Stored(centre, "jaccard-centres", narrow=True).df
    return keys.join(centre, (F.col("turn") == F.col("_turn")) & (F.col("least") == F.col("_least"))) \
        .where((F.col("class") != F.col("c.class")) & (F.least("n", "c.n") * F.lit(den) >= F.greatest("n", "c.n") * F.lit(num))) \
        .select(F.col("class").alias("a"), F.col("c.class").alias("b")).distinct()


def tile_rows(sigs: DataFrame, parts: DataFrame) -> DataFrame:
    """(shingle, tile, side, n, place, class, part): every class under every prefix shingle.

    A tile is a run of rows of one shingle.  A run of over ``RUN`` rows is cut: its largest component
    into blocks, and all other rows into blocks; every block of the others is a tile, and so is every
    pair of blocks of which one holds others (``side`` tells them apart; -1: one block alone)."""
    sizes = Stored(parts.groupBy(F.col("component").alias("_part")).agg(F.count(F.lit(1)).alias("_size")), "jaccard-sizes", narrow=True).df
    named = sigs.select("class", "n", "prefix").join(parts, F.col("class") == F.col("node"), "left") \
        .select("class", "n", "prefix", F.coalesce("component", "class").alias("part"))
    rows = named.select("class", "n", "part", F.posexplode("prefix").alias("place", "shingle"))
    long = Stored(rows.groupBy(F.col("shingle").alias("_shingle")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > F.lit(RUN)), "jaccard-long", narrow=True).df
    if not has_rows(long):
        return rows.select("shingle", F.lit(0).cast("long").alias("tile"), F.lit(-1).alias("side"), "n", "place", "class", "part")
    # of each long run, the component that is largest over all
    inside = rows.join(long, F.col("shingle") == F.col("_shingle")).groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("k")) \
        .join(sizes, F.col("part") == F.col("_part"), "left")
    stats = Stored(inside.groupBy(F.col("shingle").alias("_shingle")).agg(
        F.sum("k").alias("_rows"), F.max(F.struct(F.coalesce("_size", F.lit(1)), "part", "k")).alias("_top")).select(
            "_shingle", F.col("_top.part").alias("_most"), F.ceil(F.col("_top.k") / F.lit(RUN)).alias("_d"),
            F.ceil((F.col("_rows") - F.col("_top.k")) / F.lit(RUN)).alias("_o")).where("_o > 0"), "jaccard-runs", narrow=True).df
    block = F.pmod(F.xxhash64("class"), F.when(F.col("part") == F.col("_most"), F.col("_d")).otherwise(F.col("_o")))
    own = F.struct((F.col("_o") * (F.col("_d") + F.col("_o")) + F.col("block")).alias("tile"), F.lit(-1).alias("side"))
    to = F.when(F.col("_shingle").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("tile"), F.lit(-1).alias("side")))) \
        .when(F.col("part") == F.col("_most"), F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda i: F.struct((F.col("block") * F.col("_o") + i).alias("tile"), F.lit(0).alias("side")))) \
        .otherwise(F.concat(
            F.transform(F.sequence(F.lit(0), F.col("_d") - 1), lambda d: F.struct((d * F.col("_o") + F.col("block")).alias("tile"), F.lit(1).alias("side"))),
            F.transform(F.filter(F.sequence(F.lit(0), F.col("_o") - 1), lambda i: i != F.col("block")), lambda i: F.struct(
                (F.col("_o") * F.col("_d") + F.least(i, F.col("block")) * F.col("_o") + F.greatest(i, F.col("block"))).alias("tile"), F.when(i < F.col("block"), 1).otherwise(0).alias("side"))),
            F.array(own)))
    short = rows.join(long, F.col("shingle") == F.col("_shingle"), "left_anti").select(
        "shingle", F.lit(0).cast("long").alias("tile"), F.lit(-1).alias("side"), "n", "place", "class", "part")
    cut = rows.join(stats, F.col("shingle") == F.col("_shingle")).withColumn("block", block).withColumn("to", F.explode(to)) \
        .select("shingle", "to.tile", "to.side", "n", "place", "class", "part")
    return short.unionByName(cut)


def tile_members(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of all tiles that may link two components.

    Tiles of one component, the large groups of copies, are passed over, and so are rows without a
    partner in their band of sizes that the places of the shingle in both orders allow."""
    def run(batches):
        for tile in _tiles(batches):
            keep = np.zeros(tile.num_rows, bool)
            for i, j in _pairs(tile, num, den):
                keep[i] = keep[j] = True
            if keep.any():
                yield from tile.filter(pa.array(keep)).combine_chunks().to_batches()

    return rows.repartition("shingle", "tile").sortWithinPartitions("shingle", "tile", "n").select("shingle", "tile", "side", "n", "place", "class", "part") \
        .mapInArrow(run, "shingle long, tile long, side int, n long, place int, class long, part long")


def tile_offers(members: DataFrame, sigs: DataFrame, num: int, den: int, most: int | None, partners: int | None = None) -> DataFrame:
    """(x, y, room, a, b): of every two components x < y that meet in a tile, the ``most`` pairs (None: all)
    whose bitmaps leave most room above the overlap of a link; pairs that they rule out are left out.  One pair
    more is given where there are more, so that it shows.  With ``partners`` a task gives only the pairs that are
    among those of the ``partners`` nearest (most room) components of x or of y, and of one more."""
    most = None if most is None else most + 1
    partners = None if partners is None else partners + 1
    own = sigs.select(F.col("class").alias("_class"), "bits")
    rows = members.join(own, F.col("class") == F.col("_class")).select("shingle", "tile", "side", "n", "place", "class", "part", "bits") \
        .repartition("shingle", "tile").sortWithinPartitions("shingle", "tile", "n", "class")

    def run(batches):
        made, held = [], 0
        for tile in _tiles(batches):
            own, part, size = (tile.column(c).to_numpy() for c in ("class", "part", "n"))
            maps = Bitmaps(tile.column("bits"))
            for i, j in _pairs(tile, num, den):
                room = maps.overlap_bounds(i, j, size) - least_overlap(size[i], size[j], num, den)
                i, j, room = i[room >= 0], j[room >= 0], room[room >= 0]
                swap = part[j] < part[i]
                x, y = np.where(swap, j, i), np.where(swap, i, j)
                made.append((part[x], part[y], room, own[x], own[y]))
                held += len(i)
                if held > 1 << 17:
                    made = [_best_offers(made, most, partners)]
                    held = len(made[0][0])
                    if held > 1 << 16:
                        yield _offer_rows(made[0])
                        made, held = [], 0
        if held:
            yield _offer_rows(_best_offers(made, most, partners))

    return rows.mapInArrow(run, "x long, y long, room long, a long, b long")


def _best_offers(made: list[tuple], most: int | None, partners: int | None = None) -> tuple:
    """Different pairs, and the first ``most`` of each two components that are near each other: one is among the first
    ``partners`` of the other.  A component that loses a pair keeps as many partners as that."""
    x, y, room, a, b = (np.concatenate([m[i] for m in made]) for i in range(5))
    order = np.lexsort((b, a, -room, y, x))
    x, y, room, a, b = (c[order] for c in (x, y, room, a, b))
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    x, y, room, a, b = (c[new] for c in (x, y, room, a, b))
    if most is not None and len(a):
        first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        start = np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
        few = np.arange(len(x)) - start < most
        x, y, room, a, b = (c[few] for c in (x, y, room, a, b))
    if partners is not None and len(a):
        first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        of, two = np.concatenate([x[first], y[first]]), np.tile(np.arange(first.sum()), 2)
        order = np.lexsort((two, -np.tile(room[first], 2), of))
        of, two = of[order], two[order]
        start = np.maximum.accumulate(np.where(np.concatenate([[True], of[1:] != of[:-1]]), np.arange(len(of)), 0))
        near = np.zeros(int(first.sum()), bool)
        near[two[np.arange(len(of)) - start < partners]] = True
        near = near[np.cumsum(first) - 1]
        x, y, room, a, b = (c[near] for c in (x, y, room, a, b))
    return x, y, room, a, b


def _offer_rows(offers: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in offers], ["x", "y", "room", "a", "b"])


def best_offers(offers: DataFrame, most: int | None) -> DataFrame:
    """(x, y, room, a, b, turn): the offers of all tiles together, best first; ``most`` for each two components, and one
    more where there are more."""
    pairs = offers.distinct()
    if most is None:
        return pairs.select("x", "y", "room", "a", "b", F.lit(1).alias("turn"))
    best = Window.partitionBy("x", "y").orderBy(F.desc("room"), "a", "b")  # cut down before the shuffle
    return pairs.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= F.lit(most + 1)).select("x", "y", "room", "a", "b", "turn")


def full_components(pairs: DataFrame, partners: int) -> DataFrame:
    """(part): components with more partners than ``partners``, of which some may not be among the pairs."""
    ends = pairs.where("turn = 1").select(F.explode(F.array("x", "y")).alias("part"))
    return ends.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > F.lit(partners)).select("part")


def nearest(pairs: DataFrame, partners: int) -> DataFrame:
    """The pairs of components of which one is among the ``partners`` nearest of the other."""
    ends = pairs.where("turn = 1").select(F.explode(F.array("x", "y")).alias("part"), F.col("x").alias("_x"), F.col("y").alias("_y"), "room")
    order = Window.partitionBy("part").orderBy(F.desc("room"), "_x", "_y")  # cut down before the shuffle
    near = ends.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.lit(partners)).select("_x", "_y").distinct()
    return pairs.join(near, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left_semi")


def _tiles(batches):
    """Tables of whole tiles, from batches sorted by (shingle, tile)."""
    held = None
    for b in batches:
        new = pa.Table.from_batches([b])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows:
            starts = _starts(held)
            if starts[-1]:  # the last tile may go on in the next batch
                yield held.slice(0, int(starts[-1]))
                held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held


def _starts(tile: pa.Table) -> np.ndarray:
    shingle, number = tile.column("shingle").to_numpy(), tile.column("tile").to_numpy()
    return np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (number[1:] != number[:-1])]))


def _pairs(tile: pa.Table, num: int, den: int):
    """Arrays (i, j) of the rows of all pairs inside the tiles, i of the smaller size: of different components,
    sizes in the band, and an overlap that the shingle's places in both orders allow (it holds for a pair's
    first common shingle).

    Short tiles are compared all at once, distance by distance.  In a long one the rows of its most frequent
    component are only looked at from the other rows, so it costs no more than their product."""
    n, p, g, side = (tile.column(c).to_numpy() for c in ("n", "place", "part", "side"))
    p, starts = p.astype(np.int64), _starts(tile)
    ends = np.append(starts[1:], len(n))
    reach = n - -(-2 * num * n // (num + den)) + 1  # places within the shorter prefix, for the smaller of two

    def fit(i, j):
        ok = (g[i] != g[j]) & (n[i] * den >= n[j] * num) & (p[i] < reach[i]) & ((side[i] == -1) | (side[i] != side[j])) \
            & (1 + np.minimum(n[i] - p[i] - 1, n[j] - p[j] - 1) >= least_overlap(n[i], n[j], num, den))
        return i[ok], j[ok]

    mixed = np.minimum.reduceat(g, starts) != np.maximum.reduceat(g, starts)
    short = mixed & (ends - starts <= SHORT)
    end = np.repeat(np.where(short, ends, 0), ends - starts)
    rows = np.flatnonzero(end > 0)
    for d in range(1, SHORT):
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        i, j = fit(rows, rows + d)
        if len(i):
            yield i, j
    for a, z in zip(starts[mixed & ~short].tolist(), ends[mixed & ~short].tolist()):
        own, sizes = g[a:z], n[a:z]
        _, number, count = np.unique(own, return_inverse=True, return_counts=True)
        large = number == int(np.argmax(count))
        above = a + np.searchsorted(sizes, sizes * den // num, side="right")      # up to the largest partner
        below = a + np.searchsorted(sizes, -(-sizes * num // den), side="left")   # from the smallest one
        most = np.arange(a, z)[large]
        held, waiting = 0, []
        for k in np.flatnonzero(~large).tolist():
            at = a + k
            later = np.arange(at + 1, above[k])
            earlier = most[np.searchsorted(most, below[k]):np.searchsorted(most, at)]
            for i, j in (fit(np.full(len(later), at), later), fit(earlier, np.full(len(earlier), at))):
                if len(i):
                    waiting.append((i, j))
                    held += len(i)
            if held > 1 << 14:
                yield tuple(np.concatenate([w[x] for w in waiting]) for x in (0, 1))
                held, waiting = 0, []
        if held:
            yield tuple(np.concatenate([w[x] for w in waiting]) for x in (0, 1))


class Bitmaps:
    """The bitmaps of some rows; each width's as one matrix, wider ones folded to it."""

    def __init__(self, column: pa.ChunkedArray):
        self.width = pa.compute.binary_length(column).to_numpy().astype(np.int64)
        self.column = column.combine_chunks()

    def _matrix(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width // 8), np.uint64)
        same = self.width[rows] == width
        if same.any():
            raw = b"".join(self.column.take(pa.array(rows[same])).to_pylist())
            out[same] = np.frombuffer(raw, np.uint64).reshape(-1, width // 8)
        for k in np.flatnonzero(~same).tolist():
            out[k] = fold(self.column[int(rows[k])].as_py(), width)
        return out

    def overlap_bounds(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlaps of the sets of rows i and j, at the narrower width of each two."""
        out = np.zeros(len(i), np.int64)
        width = np.minimum(self.width[i], self.width[j])
        for w in np.unique(width).tolist():
            step = max(1, CHUNK_BYTES // w)
            at = np.flatnonzero(width == w)
            for k in range(0, len(at), step):
                own = at[k:k + step]
                rows, place = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
                m = self._matrix(rows, w)
                a, b = m[place[:len(own)]], m[place[len(own):]]
                out[own] = np.minimum(size[i[own]] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64),
                                      size[j[own]] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
        return out


def bitmap_check(pairs: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose bitmaps do not rule a link out."""
    def run(batches):
        for b in batches:
            keep = [overlap_bound(x, m, y, n) >= least_overlap(m, n, num, den) for x, m, y, n in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sigs.select(F.col("class").alias(f"_{x}"), F.col("bits").alias(f"bits_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    return pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")) \
        .select("a", "b", "bits_a", "n_a", "bits_b", "n_b").mapInArrow(run, "a long, b long")


def exact_check(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, overlap, size_a, size_b) of the pairs that link, by intersecting their sorted arrays."""
    def run(batches):
        for b in batches:
            rows = []
            for a, c, x, y in zip(*(b.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                o = sorted_overlap(x, y)
                if den * o >= num * (len(x) + len(y) - o):
                    rows.append((a, c, o, len(x), len(y)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["a", "b", "overlap", "size_a", "size_b"])

    one, two = (sets.select(F.col("class").alias(f"_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    return pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).select("a", "b", "s_a", "s_b") \
        .mapInArrow(run, "a long, b long, overlap long, size_a long, size_b long")


def tile_components(sigs: DataFrame, parts: DataFrame, sets_of, num: int, den: int) -> DataFrame:
    """(node, component): the components of ``parts`` (classes that it lacks are their own) united by all links
    that the tiles hold.  ``sets_of`` gives the shingle sets of all classes of some pairs.

    Between two components one link is enough.  The tiles offer ``OFFERS`` pairs for each two components that
    meet, the most promising ones.  First the best is verified; of the components that are still apart, the other
    ones; and where there were more, all.  Then every pair that the bitmaps leave is verified or lies inside a
    component.

    A group of near copies that the stars leave in k components would offer the square of k.  So a component is at
    first offered to its ``PARTNERS`` nearest components only; those that had more partners are looked at again
    without that limit, as the few components that they have become."""
    members = Stored(tile_members(tile_rows(sigs, parts), num, den), "jaccard-tiles").collect_garbage()
    live, most, partners = members.df, OFFERS, PARTNERS
    while True:
        pairs = Stored(best_offers(Stored(tile_offers(live, sigs, num, den, most, partners), "jaccard-offers").collect_garbage().df, most), "jaccard-best", narrow=True).df
        full = Stored(full_components(pairs, partners), "jaccard-full", narrow=True).df if partners is not None else None
        limited = full is not None and has_rows(full)
        if limited:
            pairs = Stored(nearest(pairs, partners), "jaccard-nearest", narrow=True).df
        within = F.lit(True) if most is None else F.col("turn") <= F.lit(most)
        if not has_rows(pairs):
            break
        sets = sets_of(pairs.where(within))
        for turn in (F.col("turn") == F.lit(1), within & (F.col("turn") > F.lit(1))):
            apart = _apart(pairs.where(turn), parts)
            found = Stored(exact_check(apart.select("a", "b"), sets.df, num, den).select("a", "b"), "jaccard-links", narrow=True).df
            old = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
            parts = Stored(connected_components(old.unionByName(found)), "jaccard-parts", narrow=True).df
            if most is None:
                break
        sets.drop()
        sets.collect_garbage()
        if most is None:
            break
        more = Stored(_apart(pairs.where(~within), parts).select("part_a", "part_b"), "jaccard-more", narrow=True).df
        if not limited and not has_rows(more):
            break
        # components that are apart and were offered more, or had more partners: their rows alone, in the components of now
        both = more.select(F.col("part_a").alias("_part")).unionByName(more.select(F.col("part_b").alias("_part")))
        if limited:  # a component's number is one of its classes
            both = both.unionByName(full.join(parts, F.col("part") == F.col("node"), "left").select(F.coalesce("component", "part").alias("_part")))
        both = both.distinct()
        live = live.drop("part").join(parts, F.col("class") == F.col("node"), "left") \
            .select("shingle", "tile", "side", "n", "place", "class", F.coalesce("component", "class").alias("part")) \
            .join(both, F.col("part") == F.col("_part"), "left_semi")
        live = Stored(tile_members(live, num, den), "jaccard-tiles-left").df
        most, partners = OFFERS if limited else None, None
    members.drop()
    return parts


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose classes lie in different components, with these (part_a, part_b)."""
    one, two = (parts.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"c_{x}")) for x in "ab")
    return pairs.join(one, F.col("a") == F.col("_a"), "left").join(two, F.col("b") == F.col("_b"), "left") \
        .select("a", "b", F.coalesce("c_a", "a").alias("part_a"), F.coalesce("c_b", "b").alias("part_b")).where("part_a <> part_b")


# --- the join ------------------------------------------------------------------------------------------------

def link_documents(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id reachable."""
    num, den = similarity
    all_facts = Stored(facts(docs), "jaccard-facts")
    rows = Stored(all_facts.df.where("block is null").select("doc_id", "n_shingles", "class"), "jaccard-rows").df
    levels = count_levels(all_facts.df)
    all_facts.drop()
    usable = rows.where("class is not null and doc_id is not null")
    classes = Stored(usable.groupBy("class").agg(F.min("doc_id").alias("rep")), "jaccard-classes", narrow=True).df
    again = Stored(usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("class").alias("least"), F.max("class").alias("most"))
                   .where("k > 1"), "jaccard-repeated", narrow=True).df  # ids that repeat
    repeated = has_rows(again)
    usable_docs = docs.where(docs["doc_id"].isNotNull())
    signed = Stored(signatures(usable_docs, levels, num, den).dropDuplicates(["class"]), "jaccard-signatures").collect_garbage()
    sigs = signed.df

    def sets_of(pairs: DataFrame) -> Stored:
        needed = pairs.select(F.col("a").alias("_n")).unionByName(pairs.select(F.col("b").alias("_n"))).distinct()
        wanted = Stored(classes.join(needed, F.col("class") == F.col("_n"), "left_semi"), "jaccard-wanted", narrow=True).df
        sets = class_sets(docs, wanted)
        return Stored(sets.dropDuplicates(["class"]) if repeated else sets, "jaccard-sets").collect_garbage()

    passed = Stored(bitmap_check(star_pairs(sigs, num, den), sigs, num, den), "jaccard-star-candidates").collect_garbage().df
    star_sets = sets_of(passed)
    stars = Stored(exact_check(passed, star_sets.df, num, den).select("a", "b"), "jaccard-star-links", narrow=True).df
    star_sets.drop()
    star_sets.collect_garbage()
    if repeated:
        same = usable.join(again.select(F.col("doc_id").alias("_d"), "least"), F.col("doc_id") == F.col("_d"))
        stars = stars.unionByName(same.select(F.col("class").alias("a"), F.col("least").alias("b")))
    parts = Stored(connected_components(stars), "jaccard-stars", narrow=True).df
    parts = tile_components(sigs, parts, sets_of, num, den)
    signed.drop()

    named = classes.join(parts, F.col("class") == F.col("node"), "left").select("class", "rep", F.coalesce("component", "class").alias("part"))
    named = Stored(named, "jaccard-named", narrow=True).df
    least = Stored(named.groupBy("part").agg(F.min("rep").alias("component_id")), "jaccard-least", narrow=True).df
    ids = Stored(named.join(least, "part").select(F.col("class").alias("_class"), "component_id"), "jaccard-ids", narrow=True).df
    return rows.join(ids, F.col("class") == F.col("_class"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
