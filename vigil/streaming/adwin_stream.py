"""ADWIN over streams: one adaptive window per series as state of ``transformWithStateInPandas``.

The state of a series is a few hundred bytes whatever its length (see ``operators.adwin``), so
the number of series may grow with the data.  The operator needs the RocksDB state store
(``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.operators.adwin import DELTA, Adwin
from vigil.operators.drift import valid_number

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class AdwinProcessor(StatefulProcessor):
    """Adds a trigger's values, oldest first, to the series' window and gives one row for the trigger."""

    def __init__(self, delta: float = DELTA):
        self.delta = delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", T.StructType([T.StructField("state", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.window.get() if self.window.exists() else None
        adwin = Adwin.loads(held[0]) if held else Adwin(self.delta)
        values = pd.concat(list(rows)).sort_values(["at", "value"])["value"]
        before = adwin.changes
        for v in values:
            adwin.add(v)
        self.window.update((adwin.dumps(),))
        yield pd.DataFrame({"series": [key[0]], "n_seen": [adwin.seen], "width": [adwin.width], "window_mean": [adwin.mean()], "n_changes": [adwin.changes],
                            "last_change": [adwin.last_change if adwin.last_change >= 0 else None], "changed": [adwin.changes > before]})

    def close(self) -> None:
        pass


RESULT = "series string, n_seen long, width long, window_mean double, n_changes long, last_change long, changed boolean"


def adaptive_window_stream(stream: DataFrame, value_col: str, order_col: str, series_col: str | None = None, delta: float = DELTA) -> DataFrame:
    """(series, n_seen, width, window_mean, n_changes, last_change, changed) per series and trigger, in update mode.

    Values are taken trigger by trigger, inside a trigger by ``order_col``; NULL and NaN values are left out.
    ``changed`` tells whether the trigger cut the window, ``last_change`` the number of the value (from 0)
    at which that last happened.  A NULL series is a series of its own (``''``)."""
    series = F.coalesce(F.col(series_col).cast("string"), F.lit("")) if series_col else F.lit("all")
    rows = stream.where(valid_number(F.col(value_col).cast("double"))).select(
        series.alias("series"), F.col(order_col).alias("at"), F.col(value_col).cast("double").alias("value"))
    return rows.groupBy("series").transformWithStateInPandas(
        statefulProcessor=AdwinProcessor(delta), outputStructType=RESULT, outputMode="Update", timeMode="None")
