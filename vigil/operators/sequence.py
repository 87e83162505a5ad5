"""Running totals and trailing windows over long, globally ordered series.

A plain ``Window.orderBy(...)`` without ``partitionBy`` (or partitioned by a
key that holds a third of all rows) moves the whole series into one task.
The two helpers here keep the work spread over all partitions:

* ``prefix_sum`` — cut the order into blocks whose bounds follow the data
  (approximate quantiles of the first order column), run a window per (key,
  block), and add the totals of earlier blocks from a small (key, block) table.
* ``halo_window`` — cut a dense sequence into fixed-size chunks, copy the
  last ``size - 1`` rows of every chunk into the next one (the halo), run the
  trailing window per (key, chunk), and drop the copies.  Window partitions
  are bounded by the chunk size whatever the key skew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import cut_lineage

BLOCK_ROWS = 1 << 20   # rows a (key, block) window should hold, about
KNOTS = 256            # approximate quantiles that steer the block bounds
TEXT_BOUNDS = 1024     # whole texts that steer them where the order is by text


def attach(df: DataFrame, small: DataFrame, keys: list[str], cols: list[str], how: str = "inner") -> DataFrame:
    """``cols`` of a table with one row per key, beside every row of ``df``.  NULL keys match each other;
    without keys the single row comes as scalar subqueries."""
    if not keys:
        return df.withColumns({c: small.select(c).scalar() for c in cols})
    named = small.select(*[F.col(k).alias(f"_at_{k}") for k in keys], *cols)
    cond = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    return df.join(named, cond, how).select(*df.columns, *cols)


def _as_number(df: DataFrame, order: str) -> Column:
    """A double that never falls where the column rises (ties are allowed): what blocks are cut by."""
    kind, c = df.schema[order].dataType, F.col(order)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _block(x: Column, n: int, knots: list[float]) -> Column:
    """Block number of ``x``: NULL first, then -inf, quantile intervals, and inf and NaN last.  An interval
    holds about 1 / KNOTS of the rows and is cut into equal parts if more blocks than that are wanted."""
    inner = max(1, -(-n // KNOTS))
    bounds = F.array(*[F.lit(float(k)) for k in knots])
    placed = F.struct(_last_not_above(x, [float(k) for k in knots]).alias("i"))
    low = F.element_at(bounds, placed["i"] + F.lit(1))
    high = F.coalesce(F.try_element_at(bounds, placed["i"] + F.lit(2)), low)
    part = F.when(high > low, F.least(F.greatest(F.floor((x - low) / (high - low) * F.lit(inner)), F.lit(0)), F.lit(inner - 1))).otherwise(F.lit(0))
    last = F.lit(len(knots) * inner)
    return (F.when(x.isNull(), F.lit(-2)).when(x == F.lit(float("-inf")), F.lit(-1))
            .when(F.isnan(x) | (x == F.lit(float("inf"))), last)
            .otherwise(placed["i"] * F.lit(inner) + part)).cast("long")


def _last_not_above(x: Column, bounds: list) -> Column:
    """0-based place of the last of the ascending ``bounds`` that is not above ``x`` (0 if all are), by halving."""
    held = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range((len(bounds) - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.coalesce(F.try_element_at(held, i + s + F.lit(1)) <= x, F.lit(False)), i + s).otherwise(i))


def _text_block(df: DataFrame, order: str, n: int) -> Column:
    """Block number of a text column, NULL first, then between whole texts of a random sample (at most
    TEXT_BOUNDS of them): texts that share a long beginning are still parted."""
    c = F.col(order)
    wanted = min(n, TEXT_BOUNDS)
    sample = df.where(c.isNotNull()).select(c.alias("t")).orderBy(F.rand(11)).limit(16 * wanted)
    texts = sorted((r["t"] for r in sample.collect()), key=lambda t: t.encode())  # as Spark orders them
    bounds = sorted({texts[i * len(texts) // wanted] for i in range(1, wanted)} if texts else set(), key=lambda t: t.encode())
    if not bounds:
        return F.when(c.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    place = F.when(c < F.lit(bounds[0]), F.lit(0)).otherwise(_last_not_above(c, bounds) + F.lit(1))
    return F.when(c.isNull(), F.lit(-1)).otherwise(place).cast("long")


def prefix_sum(df: DataFrame, order_cols: list[str], value_cols: list[str],
               keys: list[str] | None = None, out_suffix: str = "_cum", how: str = "sum",
               block_rows: int = BLOCK_ROWS, materialize: bool = False, rows: int | None = None) -> DataFrame:
    """Inclusive running sums (``how="sum"``), maxima (``how="max"``) or latest values that are
    not NULL (``how="last"``, of any type) of ``value_cols`` per ``keys`` in ``order_cols`` order
    (ascending, NULLs first).

    ``order_cols`` must give a total order within a key (add an id tiebreak).
    Adds one column ``<value><out_suffix>`` per value column.  NULLs count as
    0 for sums and are skipped for maxima and latest values; NULL keys are a key of their own.

    Blocks are cut by the first order column and ordered by all of them.  Their
    bounds follow approximate quantiles, so outliers do not empty the other
    blocks; only rows that tie on the first column cannot be parted.  The bounds
    change the work, never the result.  ``materialize=True`` writes the input
    once first (for aggregates or long pipelines, which would otherwise be
    evaluated for the bounds, the totals and the windows).  ``rows`` is about how
    many rows there are, where that is known without counting them.
    """
    keys = list(keys or [])
    if materialize:
        df = cut_lineage(df, "prefix-input")
    n = -(-(df.count() if rows is None else rows) // block_rows)

    def val(v):
        c = F.col(v)
        return c if how == "last" else c.cast("double") if how == "max" else F.coalesce(c.cast("double"), F.lit(0.0))

    def over(v, frame):  # the running value inside a frame
        return F.last(val(v), ignorenulls=True).over(frame) if how == "last" else (F.max if how == "max" else F.sum)(val(v)).over(frame)

    def total(v):  # of a whole block
        if how == "last":
            return F.max(F.when(F.col(v).isNotNull(), F.struct(*order_cols, F.col(v).alias("_v"))))["_v"]
        return (F.max if how == "max" else F.sum)(val(v))

    def joined_to(now, earlier):
        if how == "last":
            return F.coalesce(now, earlier)
        return F.greatest(now, earlier) if how == "max" else now + F.coalesce(earlier, F.lit(0.0))

    cum_names = [v + out_suffix for v in value_cols]
    if n <= 1:  # one block: nothing lies before it
        run = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[over(v, run).alias(c) for v, c in zip(value_cols, cum_names)])
    if isinstance(df.schema[order_cols[0]].dataType, T.StringType):
        block = _text_block(df, order_cols[0], n)
    else:
        x = _as_number(df, order_cols[0])
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        knots = df.where(finite).agg(F.percentile_approx(x, [i / KNOTS for i in range(KNOTS + 1)], 10 * KNOTS)).first()[0]
        block = _block(x, n, sorted(set(knots or [0.0])))
    withb = df.withColumn("_blk", block)
    totals = cut_lineage(withb.groupBy(*keys, "_blk").agg(*[total(v).alias(v + "_tot") for v in value_cols]), "blocks")
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    agg = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    offsets = totals.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_blk").alias("_k_blk"),
                            *[agg(v + "_tot").over(before).alias(v + "_off") for v in value_cols])
    run = Window.partitionBy(*keys, "_blk").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = withb.select("*", *[over(v, run).alias(c) for v, c in zip(value_cols, cum_names)])
    cond = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys] + [F.col("_blk") == F.col("_k_blk")]
    joined = local.join(offsets, on=cond, how="left")
    return joined.select(*[F.col(c) for c in df.columns],
                         *[joined_to(F.col(c), F.col(v + "_off")).alias(c) for v, c in zip(value_cols, cum_names)])


def dense_sequence(df: DataFrame, order_cols: list[str], keys: list[str] | None = None,
                   name: str = "seq", start: int = 0) -> DataFrame:
    """0-based (or ``start``-based) position of each row within its key, distributed."""
    tmp = df.withColumn("_one", F.lit(1.0))
    out = prefix_sum(tmp, order_cols, ["_one"], keys=keys)
    return out.withColumn(name, (F.col("_one_cum") - F.lit(1 - start)).cast("long")) \
              .drop("_one", "_one_cum")


def halo_window(df: DataFrame, seq_col: str, size: int,
                build: Callable[[DataFrame, Window], DataFrame],
                keys: list[str] | None = None, chunk_rows: int = 1 << 16) -> DataFrame:
    """Trailing ``size``-row windows over a dense sequence (0, 1, 2, ... per key; number the rows with
    ``dense_sequence`` first if it has gaps), chunked with a halo.

    ``build(frame, w)`` adds window columns using ``w`` (a rowsBetween(-(size-1), 0)
    frame partitioned by key and chunk, ordered by ``seq_col``).  Rows copied in as
    halo are dropped afterwards, so each row appears once with its full window.
    """
    keys = list(keys or [])
    if chunk_rows < size:
        chunk_rows = size
    seq = F.col(seq_col)
    chunk = F.floor(seq / F.lit(chunk_rows)).cast("long")
    own = F.struct(chunk.alias("_chunk"), F.lit(False).alias("_halo"))
    # the last size-1 rows of every chunk are also needed by the next chunk; copied in passing, so ``df`` is evaluated once
    tail = F.struct((chunk + F.lit(1)).alias("_chunk"), F.lit(True).alias("_halo"))
    places = F.when(F.pmod(seq, F.lit(chunk_rows)) >= F.lit(chunk_rows - (size - 1)), F.array(own, tail)).otherwise(F.array(own)) if size > 1 else F.array(own)
    both = df.withColumn("_place", F.explode(places)).withColumns({c: F.col("_place")[c] for c in ("_chunk", "_halo")}).drop("_place")
    w = (Window.partitionBy(*keys, "_chunk").orderBy(seq_col)
         .rowsBetween(-(size - 1), 0))
    built = build(both, w)
    return built.where(~F.col("_halo")).drop("_chunk", "_halo")
