"""Sources: table loading, the transaction CSV/Parquet scan, and the
bindings of the driver's test tables to the transaction model.

Bindings (deterministic, derived from the tables so the work grows with them):

* ``transactions`` ← ``lineitem``: price = l_extendedprice / 100,
  discount_pct = l_discount, session_duration = 10·l_quantity,
  merchant_risk_score = 5·l_tax, event time = l_shipdate, user = supplier,
  product = part; categorical fields are picked by key residues; the label is
  the rule label of the transaction model.
* ``stream_events`` ← ``events``: step = event_id, price = value,
  scenario = event_type, the JSON ``props`` carries a number ``k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import config as C
from vigil.functions.features import rule_label, time_features

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# split points between baseline and current periods (parameters of the binding)
TXN_CURRENT_FROM = "1998-01-01"
EVENTS_CURRENT_FROM = "2024-01-16"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without a zone become plain timestamps, whatever the session infers."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


# the transaction table schema (explicit: no inference on CSV)
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("event_time", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("session_duration", T.DoubleType()),
    T.StructField("account_age_days", T.LongType()),
    T.StructField("prior_orders", T.LongType()),
    T.StructField("prior_chargebacks", T.LongType()),
    T.StructField("discount_pct", T.DoubleType()),
    T.StructField("shipping_speed", T.StringType()),
    T.StructField("hour_of_day", T.LongType()),
    T.StructField("is_weekend", T.LongType()),
    T.StructField("cart_size", T.LongType()),
    T.StructField("merchant_risk_score", T.DoubleType()),
    T.StructField("is_high_value", T.LongType()),
    T.StructField("is_fraud", T.LongType()),
])


def scan_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a transaction table: CSV with header and the explicit schema, or Parquet.

    ``event_time`` is parsed to a timestamp on ingestion.
    """
    if fmt == "csv":
        df = spark.read.schema(TRANSACTION_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    else:
        df = spark.read.parquet(path)
    if "event_time" in df.columns and dict(df.dtypes)["event_time"] == "string":
        df = df.withColumn("event_time", F.try_to_timestamp(F.col("event_time")))
    return df


def _pick(key, values: list[str]):
    """values[key mod len(values)] as a CASE expression (keys are non-negative)."""
    m = F.col(key) % F.lit(len(values)) if isinstance(key, str) else key % F.lit(len(values))
    expr = None
    for i, v in enumerate(values):
        expr = F.when(m == i, F.lit(v)) if expr is None else expr.when(m == i, F.lit(v))
    return expr


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` bound to the 21-column transaction model (+ ``is_current``)."""
    li = load(spark, sf_dir, "lineitem")
    hour, weekend = time_features("l_shipdate")
    base = li.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_shipdate").alias("event_time"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        (F.col("l_extendedprice") / F.lit(100.0)).alias("price"),
        F.when(F.col("l_linestatus") == "F", F.lit("purchase")).otherwise(F.lit("cart")).alias("event_type"),
        _pick("l_partkey", list(C.CATEGORY_MAPS["category"])).alias("category"),
        _pick("l_suppkey", list(C.CATEGORY_MAPS["device_type"])).alias("device_type"),
        _pick("l_orderkey", list(C.CATEGORY_MAPS["channel"])).alias("channel"),
        F.upper(_pick("l_suppkey", list(C.CATEGORY_MAPS["country"]))).alias("country"),
        (F.col("l_quantity") * F.lit(10.0)).alias("session_duration"),
        (F.col("l_orderkey") % F.lit(3650)).alias("account_age_days"),
        (F.col("l_partkey") % F.lit(121)).alias("prior_orders"),
        (F.col("l_linenumber") - F.lit(1)).alias("prior_chargebacks"),
        F.col("l_discount").alias("discount_pct"),
        _pick("l_linenumber", list(C.CATEGORY_MAPS["shipping_speed"])).alias("shipping_speed"),
        hour, weekend,
        F.col("l_linenumber").alias("cart_size"),
        (F.col("l_tax") * F.lit(5.0)).alias("merchant_risk_score"),
        F.col("l_returnflag").alias("return_flag"),
    )
    return base.withColumn("is_high_value", (F.col("price") > F.lit(C.HIGH_VALUE_PRICE)).cast("int")) \
               .withColumn("is_fraud", rule_label()) \
               .withColumn("is_current", F.col("event_time") >= F.lit(TXN_CURRENT_FROM).cast("timestamp"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a scored stream: one series per event type (the scenario)."""
    ev = load(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").try_cast("double")
    return ev.select(
        F.col("event_id").alias("step"),
        F.col("ts").alias("event_time"),
        F.col("user_id"),
        F.col("event_type").alias("scenario"),
        F.col("event_type"),
        F.col("value").alias("price"),
        k.alias("prop_k"),
        F.col("props"),
        (F.col("ts") >= F.lit(EVENTS_CURRENT_FROM).cast("timestamp")).alias("is_current"),
    )


def stream_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` bound to the full transaction model, one row per event.

    ``step`` = event_id (dense); ``k`` is the number inside ``props``; the
    other fields are picked from event and user ids so every row is complete.
    """
    ev = load(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").try_cast("long")
    hour, weekend = time_features("ts")
    base = ev.select(
        F.col("event_id").alias("step"),
        F.col("ts").alias("event_time"),
        F.col("user_id"),
        k.alias("product_id"),
        F.col("value").alias("price"),
        F.col("event_type"),
        _pick("user_id", list(C.CATEGORY_MAPS["category"])).alias("category"),
        _pick("event_id", list(C.CATEGORY_MAPS["device_type"])).alias("device_type"),
        _pick(F.col("user_id") + F.lit(1), list(C.CATEGORY_MAPS["channel"])).alias("channel"),
        F.upper(_pick("user_id", list(C.CATEGORY_MAPS["country"]))).alias("country"),
        (k * F.lit(10.0)).alias("session_duration"),
        ((F.col("user_id") * F.lit(37)) % F.lit(3650)).alias("account_age_days"),
        (F.col("user_id") % F.lit(121)).alias("prior_orders"),
        ((F.col("event_id") % F.lit(7)) == 0).cast("long").alias("prior_chargebacks"),
        ((k % F.lit(50)) / F.lit(100.0)).alias("discount_pct"),
        _pick(k, list(C.CATEGORY_MAPS["shipping_speed"])).alias("shipping_speed"),
        hour, weekend,
        (k % F.lit(19)).alias("cart_size"),
        ((F.col("user_id") % F.lit(45)) / F.lit(100.0)).alias("merchant_risk_score"),
        (F.col("ts") >= F.lit(EVENTS_CURRENT_FROM).cast("timestamp")).alias("is_current"),
    )
    return base.withColumn("is_high_value", (F.col("price") > F.lit(C.HIGH_VALUE_PRICE)).cast("int")) \
               .withColumn("is_fraud", rule_label())
