"""JSON payload codec for the transaction stream.

Decoding trap: producers send the flags as JSON booleans and whole numbers
as ``7.0``; ``from_json`` with an IntegerType field turns both into NULL.
So flags are decoded as STRING and mapped (true/false/1/0), and every
numeric field is decoded as DOUBLE and cast afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import config as C

INT_FIELDS = ["user_id", "product_id", "account_age_days", "prior_orders", "prior_chargebacks",
              "hour_of_day", "is_weekend", "cart_size"]
FLAG_FIELDS = ["is_high_value", "is_fraud"]
STRING_FIELDS = ["event_time", "event_type", "category", "device_type", "channel", "country", "shipping_speed"]
# the 21 payload fields in the stream's order
PAYLOAD_FIELDS = ["event_time", "user_id", "product_id", "price", "event_type", "category", "device_type",
                  "channel", "country", "session_duration", "account_age_days", "prior_orders",
                  "prior_chargebacks", "discount_pct", "shipping_speed", "hour_of_day", "is_weekend",
                  "cart_size", "merchant_risk_score", "is_high_value", "is_fraud"]


def wire_schema() -> T.StructType:
    """Schema used to parse: strings for text and flags, doubles for every number."""
    fields = []
    for f in PAYLOAD_FIELDS:
        t = T.StringType() if (f in STRING_FIELDS or f in FLAG_FIELDS) else T.DoubleType()
        fields.append(T.StructField(f, t, True))
    return T.StructType(fields)


def flag_to_int(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("true", "1", "1.0"), F.lit(1)).when(s.isin("false", "0", "0.0"), F.lit(0))


def json_decode(df: DataFrame, col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """bytes/string JSON -> the 21 typed payload fields (flags 0/1, ints as long)."""
    parsed = df.select(*[F.col(k) for k in (keep or [])],
                       F.from_json(F.col(col).cast("string"), wire_schema()).alias("_d"))
    out = [F.col(k) for k in (keep or [])]
    for f in PAYLOAD_FIELDS:
        x = F.col(f"_d.{f}")
        if f in FLAG_FIELDS:
            out.append(flag_to_int(x).alias(f))
        elif f in INT_FIELDS:
            out.append(x.try_cast("long").alias(f))
        else:
            out.append(x.alias(f))
    return parsed.select(*out)


def json_encode(df: DataFrame, columns: list[str] | None = None, out_col: str = "value") -> DataFrame:
    cols = columns or df.columns
    return df.select(F.to_json(F.struct(*[F.col(c) for c in cols])).alias(out_col))


def payload_project(df: DataFrame, extra: tuple[str, ...] = ("event_time", "is_fraud")) -> DataFrame:
    """Keep the model's features plus event time and label; drop everything else."""
    allowed = set(C.MODEL_FEATURES) | set(extra)
    return df.select(*[c for c in df.columns if c in allowed])
