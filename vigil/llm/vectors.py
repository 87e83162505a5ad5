"""Which vectors take part, and their numpy form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import has_rows


def is_valid(vector: Column) -> Column:
    """Neither null, empty or zero nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != F.lit(0.0)), F.lit(False))


def taking_part(vectors: DataFrame, id_col: str, vector_col: str, others: list[Column]) -> DataFrame:
    """(id, v, ...) of the valid vectors with an id, of any length; of rows that repeat an id the smallest stays."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"), *others) \
        .where(F.col("id").isNotNull() & is_valid(F.col("v")))
    if has_rows(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")):
        rest = [c for c in rows.columns if c != "id"]
        rows = rows.groupBy("id").agg(F.min(F.struct(*rest)).alias("s")).select("id", *[f"s.{c}" for c in rest])
    return rows


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists all have one length, as rows of doubles."""
    if not len(column):
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_length(column: pa.Array):
    """(row numbers, matrix) of the lists of each length in a column."""
    size = column.value_lengths().to_numpy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, matrix(column if len(at) == len(column) else column.take(pa.array(at)))


def row_cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The cosine of every row's two vectors, which have one length."""
    out, size = np.zeros(len(a)), a.value_lengths().to_numpy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x, y = (matrix(c.take(pa.array(at))) for c in (a, b))
        out[at] = (unit(x) * unit(y)).sum(axis=1)
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows divided by their length, safe for very large and very small components."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def directions(n: int, dim: int, seed: int) -> np.ndarray:
    """Random directions (dim, n), the same in every task."""
    return np.random.default_rng([seed, n, dim]).standard_normal((dim, n))
