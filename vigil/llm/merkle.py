"""Merkle manifest of a dataset, its subtrees in van Emde Boas layout.

Every row becomes a leaf; per group (``source``) the leaves, in id order, form a tree of
fan-out 16, and the groups' roots, in group order, one more tree.  Trees are cut into
aligned blocks of ``LEVELS`` node levels (at most 4096 leaves).  A block is one stored row:
its digests lie in one array whose order comes from splitting the subtree at half height,
again and again: the top half first, then the bottom subtrees from left to right, each laid
out in the same way.  ``address`` computes a node's place by arithmetic, for building
and for fetching siblings, without pointers and for any split.  The roots of the blocks are
the leaves of the next round, until every tree is one block.

Proofs go the other way: a block hands each of its leaves the siblings on the way to the
root, its own and those it was handed itself, so no row is ever joined with a whole block
of another one.  Texts are read once and never shuffled; leaves are ranked by stored sorted
partitions and their offsets, so a group may be of any size, and a task holds one block at
a time.

Defined cases: null fields are the text ``-``; a null group is a group of its own, the
first; rows without an id come first in their group, rows that repeat an id are ordered by
their digest, and equal rows are leaves of their own; rows without an id are never taken as
tampered; a single leaf is its tree's root and has no siblings there (the digest of its
proof is then that of the siblings above, or of the empty text); an empty table gives no
rows; further input columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Stored, has_rows

BITS = 4                           # fan-out 16
LEVELS = 4                         # node levels of a block
CAPACITY = 1 << BITS * (LEVELS - 1)
HEX = 64
RUN = HEX << BITS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "lefts array<string>, rights array<string>"


# --- layout --------------------------------------------------------------------------------------------------

def subtree_size(levels: int) -> int:
    return ((1 << BITS * levels) - 1) // ((1 << BITS) - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes ``index`` of one depth (0: the root) in a subtree of ``levels`` node levels."""
    index = np.asarray(index, np.int64)
    place = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        levels, depth = levels - top, depth - top
        place += subtree_size(top) + (index >> BITS * depth) * subtree_size(levels)
        index = index & ((1 << BITS * depth) - 1)
    return place


def levels_for(total: int) -> int:
    """Node levels of the blocks of a tree of ``total`` leaves in this round."""
    levels = 1
    while levels < LEVELS and 1 << BITS * (levels - 1) < total:
        levels += 1
    return levels


def build_block(digests: np.ndarray, levels: int) -> np.ndarray:
    """All digests (rows of 32 bytes) of a block from those of its leaves; unused places are zero."""
    nodes = np.zeros((subtree_size(levels), HEX // 2), np.uint8)
    nodes[address(levels - 1, np.arange(len(digests)), levels)] = digests
    for depth in range(levels - 2, -1, -1):
        text = digests.tobytes().hex()
        runs = [sha256(text[i:i + RUN].encode()).digest() for i in range(0, len(text), RUN)]
        digests = np.frombuffer(b"".join(runs), np.uint8).reshape(-1, HEX // 2)
        nodes[address(depth, np.arange(len(digests)), levels)] = digests
    return nodes


def level_texts(nodes: bytes, n: int, levels: int) -> list[str]:
    """The levels below the root, lowest first: each one's digests as one text."""
    table, out = np.frombuffer(nodes, np.uint8).reshape(-1, HEX // 2), []
    for depth in range(levels - 1, 0, -1):
        out.append(table[address(depth, np.arange(n), levels)].tobytes().hex())
        n = (n + (1 << BITS) - 1) >> BITS
    return out


def siblings(texts: list[str], leaf: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a leaf and of its ancestors in their runs, level by level."""
    lefts, rights = [], []
    for text in texts:
        at, start = leaf * HEX, (leaf >> BITS) * RUN
        lefts.append(text[start:at])
        rights.append(text[at + HEX:start + RUN])
        leaf >>= BITS
    return lefts, rights


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for a, b in zip(lefts, rights):
        digest = sha256(f"{a}{digest}{b}".encode()).hexdigest()
    return digest


# --- leaves --------------------------------------------------------------------------------------------------

def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, digest, changed): ``changed`` is the leaf after tampering, where there is some."""
    doc_id, rest, text = docs["doc_id"].cast("long"), [docs[c] for c in ("source", "lang", "n_chars")], docs["text"]
    picked = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == F.lit(0)
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("n")).alias("grp"), doc_id.alias("doc_id"),
        F.unhex(leaf_digest(doc_id, *rest, text)).alias("digest"),
        F.when(picked, F.unhex(leaf_digest(doc_id, *rest, lower_ascii(text)))).alias("changed"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0, in its ``grp``) and ``total`` (rows of the ``grp``).

    Sorted partitions are stored; a row's rank is its place there and the rows of its group before."""
    ordered = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order) \
        .withColumn("place", F.monotonically_increasing_id())
    ordered = Stored(ordered, "merkle-ordered").df.withColumn("part", F.shiftright("place", 33))
    all_parts = Window.partitionBy("grp")
    ahead = all_parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).select(
        "grp", "part", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(all_parts).alias("total"))
    offsets = Stored(offsets, "merkle-offsets").df  # a row for each group and task; its size is known when the join is planned
    return ordered.join(offsets, ["grp", "part"]).select(
        *rows.columns, (F.col("before") + F.col("place") - F.col("first")).alias("rank"), "total")


# --- blocks, bottom up ---------------------------------------------------------------------------------------

_BLOCK = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("levels", pa.int32()), ("n", pa.int32()),
                    ("nodes", pa.binary()), ("root", pa.binary()), ("ids", pa.list_(pa.int64())), ("changed", pa.list_(pa.binary()))])
_BLOCK_TYPE = "grp string, block long, total long, levels int, n int, nodes binary, root binary, ids array<long>, changed array<binary>"


def block_table(nodes: DataFrame) -> DataFrame:
    """One row per block of (grp, rank, total, digest, doc_id, changed)."""
    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank").combine_chunks()
        total = rows.column("total")[0].as_py()
        digests = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(-1, HEX // 2)
        levels = levels_for(total)
        table = build_block(digests, levels)
        return pa.Table.from_arrays(
            [pa.array([x], t) for x, t in zip((key[0].as_py(), key[1].as_py(), total, levels, rows.num_rows, table.tobytes(), table[0].tobytes(),
                                               rows.column("doc_id").to_pylist(), rows.column("changed").to_pylist()), _BLOCK.types)], schema=_BLOCK)

    return nodes.withColumn("block", F.floor(F.col("rank") / F.lit(CAPACITY))) \
        .select("grp", "block", "rank", "total", "digest", "doc_id", "changed").groupBy("grp", "block").applyInArrow(build, _BLOCK_TYPE)


def grow(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The block tables of all rounds; a tree is complete in the round in which it is one block."""
    rounds = [Stored(block_table(nodes), f"merkle-{name}-0").df]
    while has_rows(rounds[-1].where(F.col("total") > F.lit(CAPACITY))):
        upper = rounds[-1].where(F.col("total") > F.lit(CAPACITY)).select(
            "grp", F.col("block").alias("rank"), F.ceil(F.col("total") / F.lit(CAPACITY)).alias("total"), F.col("root").alias("digest"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))
        rounds.append(Stored(block_table(upper), f"merkle-{name}-{len(rounds)}").df)
    return rounds


# --- siblings, top down --------------------------------------------------------------------------------------

def hand_down(blocks: DataFrame) -> DataFrame:
    """(grp, rank, subroot, lefts, rights) for every leaf of blocks that have (subroot, lefts, rights) themselves."""
    def run(batches):
        for b in batches:
            for grp, block, n, levels, nodes, subroot, up_l, up_r in zip(*(b.column(i).to_pylist() for i in range(8))):
                texts = level_texts(nodes, n, levels)
                for start in range(0, n, 256):
                    own = [siblings(texts, i) for i in range(start, min(n, start + 256))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([grp] * len(own), pa.string()), pa.array(np.arange(start, start + len(own)) + block * CAPACITY), pa.array([subroot] * len(own), pa.string()),
                         pa.array([x + up_l for x, _ in own], pa.list_(pa.string())), pa.array([y + up_r for _, y in own], pa.list_(pa.string()))],
                        ["grp", "rank", "subroot", "lefts", "rights"])

    return blocks.select("grp", "block", "n", "levels", "nodes", "subroot", "lefts", "rights") \
        .mapInArrow(run, f"grp string, rank long, subroot string, {_PATH}")


def with_paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The blocks of the first round with (subroot, lefts, rights); ``tops`` has them for each grp's root."""
    handed, blocks = None, None
    for r in range(len(rounds) - 1, -1, -1):
        done = F.col("total") <= F.lit(CAPACITY)
        blocks = rounds[r].where(done).join(tops, "grp")
        if handed is not None:
            blocks = blocks.unionByName(rounds[r].where(~done).join(handed.withColumnRenamed("rank", "block"), ["grp", "block"]))
        if r:
            handed = Stored(hand_down(blocks), f"merkle-paths-{r}").df
    return blocks


def proofs(blocks: DataFrame, root: str) -> DataFrame:
    """The result rows of all leaves of the first round's blocks."""
    kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches):
        for b in batches:
            for n, levels, nodes, ids, changed, subroot, up_l, up_r in zip(*(b.column(i).to_pylist() for i in range(8))):
                texts, out = level_texts(nodes, n, levels), []
                own = np.frombuffer(nodes, np.uint8).reshape(-1, HEX // 2)[address(levels - 1, np.arange(n), levels)].tobytes().hex()
                for i, (doc, other) in enumerate(zip(ids, changed)):
                    lefts, rights = siblings(texts, i)
                    lefts, rights = lefts + up_l, rights + up_r
                    leaf = own[i * HEX:(i + 1) * HEX]
                    proof = sha256("".join([x + y for x, y in zip(lefts, rights)]).encode()).hexdigest()
                    folded = fold(leaf if other is None else other.hex(), lefts, rights)
                    out.append((doc, leaf, subroot, root, proof, folded, folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return blocks.select("n", "levels", "nodes", "ids", "changed", "subroot", "lefts", "rights").mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(block tables of the groups, block tables of the tree over them, (name, rank, digest) of the groups)."""
    rounds = grow(ranked(leaves(docs), ["doc_id", "digest"]), "leaves")
    subroots = None
    for table in rounds:
        own = table.where(F.col("total") <= F.lit(CAPACITY)).select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"))
        subroots = own if subroots is None else subroots.unionByName(own)
    groups = Stored(ranked(subroots, ["name"]).withColumns({"doc_id": F.lit(None).cast("long"), "changed": F.lit(None).cast("binary")}), "merkle-groups").df
    return rounds, grow(groups, "groups"), groups


def verify_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    rounds, above, groups = manifest(docs)
    last = above[-1].select("root").first()  # the one block of the last round
    root = last["root"].hex() if last else ""
    start = groups.select("grp").distinct().select(
        "grp", F.lit(None).cast("string").alias("subroot"), *[F.array().cast("array<string>").alias(c) for c in ("lefts", "rights")])
    handed = Stored(hand_down(with_paths(above, start)), "merkle-tops").df
    tops = handed.drop("subroot", "grp").join(groups.select("rank", "name", "digest"), "rank") \
        .select(F.col("name").alias("grp"), F.lower(F.hex("digest")).alias("subroot"), "lefts", "rights")
    return proofs(with_paths(rounds, Stored(tops, "merkle-subroots").df), root)
