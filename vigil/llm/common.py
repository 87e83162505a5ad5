"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.session import scratch_path


NARROW = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Stored:
    """A table written once into the shared scratch folder; ``drop`` removes its files.

    ``df`` reads it back: no lineage to recompute, and a lost executor loses nothing.  The shuffle files
    behind it are then of no use; ``collect_garbage`` lets Spark's cleaner find that out at once instead
    of at the driver's next full collection.  ``narrow`` tables, pairs of ids and the like, are written by
    ``NARROW`` tasks a core at most, however many partitions they come in, so they do not end up as thousands
    of tiny files."""

    def __init__(self, df: DataFrame, name: str, compression: str = "zstd", narrow: bool = False):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        if narrow:
            df = df.coalesce(NARROW * self.spark.sparkContext.defaultParallelism)
        df.write.option("compression", compression).parquet(self.path)
        self.df = self.spark.read.parquet(self.path)

    def collect_garbage(self) -> Stored:
        gc.collect()
        self.spark._jvm.System.gc()
        return self

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def running_sum(df: DataFrame, order: str, values: list[str], block: int) -> DataFrame:
    """Adds ``before_<v>``: the sum of ``v`` over all rows with a smaller ``order`` (a unique whole
    number from 0).

    Rows are cut into blocks of ``block`` order values; only the block totals meet in one task."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    totals = blocked.groupBy("_block").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", *[F.coalesce(F.sum(f"_t_{v}").over(ahead), F.lit(0)).alias(f"_o_{v}")
                                        for v in values])
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(offsets, "_block").select(
        *df.columns,
        *[(F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"before_{v}") for v in values])
