"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node (pre-aggregated map side) and a join of the edges
with it; each round's edges are stored and counted, and the rounds end when the
edges no longer change.  Edges of a node with very many neighbours are one side of a
plain join, which adaptive execution splits; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Stored

MAX_ROUNDS = 60  # a path of 2 ** 60 nodes


def _least(edges: DataFrame, name: str) -> Stored:
    return Stored(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), "least"), name, narrow=True)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b) (longs, any direction, repeats and loops
    allowed): component is the smallest node that can be reached.  Nodes without edges do not appear."""
    proper = edges.where(F.col("a") != F.col("b"))
    held = Stored(proper.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges", narrow=True)
    state = _state(held.df)
    for _ in range(MAX_ROUNDS):
        # large star: a node's larger neighbours move to the smallest node it sees (itself included)
        both = held.df.unionByName(held.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both, "cc-large")
        large = both.join(least.df, F.col("a") == F.col("node")).where(F.col("b") > F.col("a")) \
            .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        # small star: a node's smaller neighbours, and the node, move to the smallest of them
        grown = Stored(large.distinct(), "cc-grown", narrow=True)
        low = _least(grown.df, "cc-small")
        moved = grown.df.join(low.df, F.col("a") == F.col("node")).where(F.col("b") != F.col("least")) \
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
        new = Stored(moved.unionByName(low.df.select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct(), "cc-edges", narrow=True)
        for old in (held, least, grown, low):
            old.drop()
        held, before, state = new, state, _state(new.df)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    nodes = held.df
    return nodes.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        nodes.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
