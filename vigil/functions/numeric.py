"""Numeric helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_places(c, places: int = 6) -> Column:
    """Round half away from zero on the scaled double: sign(v) * floor(|v| + 0.5) / 10^p.

    Pure double arithmetic (Spark's ``round`` goes through BigDecimal per value);
    it equals ``std::round(x * 10^p) / 10^p`` exactly while |v| < 2^51, beyond
    which the value is returned unchanged.
    """
    x = F.col(c) if isinstance(c, str) else c
    k = float(10 ** places)
    v = x * F.lit(k)
    fast = F.signum(v) * F.floor(F.abs(v) + F.lit(0.5)).cast("double") / F.lit(k)
    return F.when(F.abs(v) < F.lit(float(2 ** 51)), fast).otherwise(x)
