"""Sorts, limits, sampling and splits.

Splits are deterministic functions of the row key and a seed (a hash), so
the same rows land in the same part on every run and after executor loss —
unlike ``randomSplit``, whose result depends on partitioning.  Exact-share
stratified splits rank rows by hash within each class with the distributed
``dense_sequence`` (no single-task window per class).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.numeric import round_places
from vigil.operators.sequence import dense_sequence


def row_hash(key_cols: list[str], seed: int) -> Column:
    """md5 of 'k1:k2:…:seed' (hex text; orders uniformly)."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))


def hash_bucket(key_cols: list[str], seed: int, buckets: int = 10000) -> Column:
    """Integer bucket in [0, buckets) from the first 32 bits of the row hash."""
    return (F.conv(F.substring(row_hash(key_cols, seed), 1, 8), 16, 10).cast("long") % F.lit(buckets))


def hash_split(df: DataFrame, key_cols: list[str], shares: dict[str, float], seed: int = 42,
               out_col: str = "part") -> DataFrame:
    """Unstratified split by hash bucket: shares in order, e.g. train/val/test 70/15/15."""
    b = F.col("_bucket")  # the hash is taken once, not for every share
    expr, acc, names = None, 0.0, list(shares)
    for name in names[:-1]:
        acc += shares[name]
        cond = b < F.lit(int(round(acc * 10000)))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])
    return df.withColumn("_bucket", hash_bucket(key_cols, seed)).withColumn(out_col, expr).drop("_bucket")


def stratified_split(df: DataFrame, label: str, key_cols: list[str], test_share: float = 0.2,
                     seed: int = 42, out_col: str = "part", tiebreak: list[str] | None = None) -> DataFrame:
    """Exact per-class shares: the first round(n_class * test_share) rows in hash order are test."""
    work = df.withColumn("_h", row_hash(key_cols, seed))
    seq = dense_sequence(work, ["_h", *key_cols, *(tiebreak or [])], keys=[label], name="_rank")
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    seq = seq.join(n, on=label, how="inner")
    part = F.when(F.col("_rank") < round_places(F.col("_n") * F.lit(test_share), 0), F.lit("test")).otherwise(F.lit("train"))
    return seq.withColumn(out_col, part).drop("_h", "_rank", "_n")


def sample_n(df: DataFrame, n: int, key_cols: list[str], seed: int = 42,
             tiebreak: list[str] | None = None) -> DataFrame:
    """The ``n`` rows with the lowest seeded hash (a distributed top-k)."""
    order = [row_hash(key_cols, seed), *[F.col(c) for c in key_cols], *[F.col(c) for c in (tiebreak or [])]]
    return df.orderBy(*order).limit(n)


def retrain_pool(baseline: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Baseline rows and their rewritten copy, tagged; shuffling is left to the trainer."""
    types = dict(baseline.dtypes)
    aligned = rewritten.select(*[(F.col(c).cast(types[c]) if c in types else F.col(c)).alias(c)
                                 for c in rewritten.columns])
    return baseline.withColumn("copy", F.lit("original")).unionByName(
        aligned.withColumn("copy", F.lit("rewritten")), allowMissingColumns=True)


def recent_n(df: DataFrame, n: int, time_col: str, tiebreak: str | None = None) -> DataFrame:
    """Newest ``n`` rows (TakeOrderedAndProject: per-partition top-n, then merge)."""
    order = [F.col(time_col).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    return df.orderBy(*order).limit(n)
