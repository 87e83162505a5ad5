"""Registered queries: projections, filters and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import round_places

from vigil import config as C
from vigil.functions import features as X
from vigil.operators import drift as D
from vigil.operators import schema as S
from vigil.plans.registry import query
from vigil.plans.sqlbind import STX, TXN, with_ctes
from vigil.sources.tables import stream_events, stream_transactions, transactions

# the benchmark's model feature split (fixed values)
CANONICAL = ["price", "hour_of_day", "is_weekend", "is_high_value", "account_age_days", "device_type", "category"]
PREDICTIVE = ["merchant_risk_score", "session_duration", "prior_orders", "prior_chargebacks", "discount_pct",
              "cart_size"]
MODEL = CANONICAL + PREDICTIVE


def r6(c):
    return round_places(c, 6)


def cat_sql(col: str, name: str) -> str:
    m = C.CATEGORY_MAPS[name]
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items())
    return f"(CASE lower(CAST({col} AS VARCHAR)) {whens} ELSE {max(m.values())} END)"


def num_sql(col: str, default: float) -> str:
    x = f"TRY_CAST({col} AS DOUBLE)"
    return f"coalesce(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, {float(default)})"


# ---------------------------------------------------------------- numeric_coerce
@query("numeric_coerce", sql=with_ctes("e AS (SELECT * FROM events)") + f"""
SELECT event_id, round({num_sql('value', 0.0)}, 6) AS price,
       {num_sql("json_extract_string(props, '$.k')", 0.0)} AS session_duration,
       {num_sql('event_type', 0)} AS cart_size
FROM e""")
def q_numeric_coerce(spark, sf):
    """Lenient numbers: text k from the JSON parses, event-type text falls back to the default."""
    ev = stream_events(spark, sf).select(
        F.col("step").alias("event_id"), F.col("price"),
        F.get_json_object("props", "$.k").alias("session_duration"), F.col("event_type").alias("cart_size"))
    out = X.numeric_coerce(ev, ["price", "session_duration", "cart_size"])
    return out.select("event_id", r6("price").alias("price"), "session_duration", "cart_size")


# ---------------------------------------------------------------- flags
@query("flag_high_value", sql=with_ctes(TXN) + f"""
SELECT order_key, line_number, CAST(price > {C.HIGH_VALUE_PRICE} AS INTEGER) AS hv_from_price,
       CAST({num_sql('is_high_value', 0)} AS INTEGER) AS hv_given,
       CAST(price > 400.0 AS INTEGER) AS hv_400
FROM txn""")
def q_flag_high_value(spark, sf):
    t = transactions(spark, sf)
    absent = t.drop("is_high_value")
    return t.select("order_key", "line_number",
                    X.flag_high_value(absent).alias("hv_from_price"), X.flag_high_value(t).alias("hv_given"),
                    X.flag_high_value(absent, threshold=400.0).alias("hv_400"))


@query("flag_weekend", sql=with_ctes(TXN) + f"""
SELECT order_key, line_number, CAST({num_sql('is_weekend', 0)} AS INTEGER) AS weekend_given,
       0 AS weekend_absent FROM txn""")
def q_flag_weekend(spark, sf):
    t = transactions(spark, sf)
    return t.select("order_key", "line_number", X.flag_weekend(t).alias("weekend_given"),
                    X.flag_weekend(t.drop("is_weekend")).alias("weekend_absent"))


@query("stream_high_value", sql=with_ctes(STX) + f"""
SELECT step, CASE WHEN price * 3.0 > {C.HIGH_VALUE_PRICE} THEN 1 ELSE CAST(product_id % 2 AS INTEGER) END
       AS is_high_value FROM stx""")
def q_stream_high_value(spark, sf):
    """price > 500 -> 1, else keep the incoming flag (here: parity of k); prices tripled."""
    s = stream_transactions(spark, sf)
    return s.select("step", X.stream_high_value(F.col("price") * 3.0, (F.col("product_id") % 2).cast("int"))
                    .alias("is_high_value"))


# ---------------------------------------------------------------- category_encode
@query("category_encode", sql=with_ctes("e AS (SELECT * FROM events)") + f"""
SELECT event_id, {cat_sql('event_type', 'event_type')} AS event_type_code,
       {cat_sql("upper(event_type)", 'event_type')} AS upper_code,
       {cat_sql('NULL', 'channel')} AS null_code, 0 AS absent_code
FROM e""")
def q_category_encode(spark, sf):
    """Event types to fixed codes: unknown types collide with the largest code; NULL too."""
    ev = stream_events(spark, sf)
    return ev.select(F.col("step").alias("event_id"),
                     X.category_encode(ev, "event_type").alias("event_type_code"),
                     X.category_code(F.upper("event_type"), C.CATEGORY_MAPS["event_type"]).alias("upper_code"),
                     X.category_code(F.lit(None).cast("string"), C.CATEGORY_MAPS["channel"]).alias("null_code"),
                     X.category_encode(ev, "device_type").alias("absent_code"))


# ---------------------------------------------------------------- encode_features
def encode_sql(src: str, keys: str) -> str:
    cols = []
    for n in C.NUMERIC_FEATURES:
        if n in ("is_high_value", "is_weekend"):
            cols.append(f"CAST({num_sql(n, 0)} AS INTEGER) AS {n}")
        else:
            cols.append(f"round({num_sql(n, C.DEFAULT_NUMERIC_VALUES[n])}, 6) AS {n}")
    for n in C.CATEGORICAL_FEATURES:
        cols.append(f"{cat_sql(n, n)} AS {n}")
    return f"SELECT {keys}, {', '.join(cols)} FROM {src}"


@query("encode_features", sql=with_ctes(TXN) + encode_sql("txn", "order_key, line_number"))
def q_encode_features(spark, sf):
    t = transactions(spark, sf)
    enc = X.encode_features(t, keep=["order_key", "line_number"])
    return enc.select("order_key", "line_number",
                      *[(r6(n) if n not in ("is_high_value", "is_weekend") else F.col(n)).alias(n)
                        for n in C.NUMERIC_FEATURES], *C.CATEGORICAL_FEATURES)


# ---------------------------------------------------------------- medians
MED_FEATURES = ["price", "session_duration", "account_age_days", "prior_orders", "discount_pct",
                "merchant_risk_score", "cart_size"]


@query("medians", sql=with_ctes(TXN) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(quantile_cont({f}, 0.5), 6) AS median FROM txn WHERE NOT is_current"
    for f in MED_FEATURES))
def q_medians(spark, sf):
    t = transactions(spark, sf).where(~F.col("is_current"))
    m = S.medians(t, MED_FEATURES)
    return m.select("feature", r6("median").alias("median"))


@query("median_impute", sql=with_ctes(STX) + """
, m AS (SELECT quantile_cont(price, 0.5) AS med FROM stx WHERE NOT is_current)
SELECT step, round(coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE price END, m.med), 6) AS price
FROM stx, m""")
def q_median_impute(spark, sf):
    """Missing prices (error events) take the baseline-period median."""
    s = stream_transactions(spark, sf)
    holes = s.withColumn("price", F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("price")))
    meds = S.medians(s.where(~F.col("is_current")), ["price"])
    out = S.median_impute(holes, meds, ["price"])
    return out.select("step", r6("price").alias("price"))


# ---------------------------------------------------------------- feature_assemble
@query("feature_assemble", sql=with_ctes(TXN) + """
, med AS (SELECT quantile_cont(session_duration, 0.5) AS sd, quantile_cont(account_age_days, 0.5) AS aad,
                 quantile_cont(prior_orders, 0.5) AS po, quantile_cont(prior_chargebacks, 0.5) AS pc,
                 quantile_cont(discount_pct, 0.5) AS dp, quantile_cont(merchant_risk_score, 0.5) AS mrs,
                 quantile_cont(cart_size, 0.5) AS cs, quantile_cont(hour_of_day, 0.5) AS hod,
                 quantile_cont(is_weekend, 0.5) AS iw, quantile_cont(is_high_value, 0.5) AS ihv
          FROM txn WHERE NOT is_current)
SELECT event_id AS step, round(value, 6) AS price, round(med.hod, 6) AS hour_of_day, round(med.iw, 6) AS is_weekend,
       round(med.ihv, 6) AS is_high_value, round(med.aad, 6) AS account_age_days, event_type AS device_type,
       event_type AS category, round(med.mrs, 6) AS merchant_risk_score, round(med.sd, 6) AS session_duration,
       round(med.po, 6) AS prior_orders, round(med.pc, 6) AS prior_chargebacks, round(med.dp, 6) AS discount_pct,
       round(med.cs, 6) AS cart_size
FROM events, med""")
def q_feature_assemble(spark, sf):
    """Events scored by a model trained on transactions: own column -> mapped column -> median."""
    ev = stream_events(spark, sf).select("step", "price", "event_type")
    t = transactions(spark, sf).where(~F.col("is_current"))
    numeric = [f for f in MODEL if f not in ("device_type", "category")]
    meds = S.medians(t, numeric)
    out = S.feature_assemble(ev, MODEL, mapping={"device_type": "event_type", "category": "event_type"},
                             medians=meds, keep=["step"])
    return out.select("step", *[(F.col(f) if f in ("device_type", "category") else r6(F.col(f).cast("double")))
                                .alias(f) for f in MODEL])


# ---------------------------------------------------------------- payload_defaults
@query("payload_defaults", sql=with_ctes("e AS (SELECT * FROM events)") + """
SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, round(value, 6) AS price, event_type,
       coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE 'mobile' END, 'desktop') AS device_type,
       'electronics' AS category, 'organic' AS channel, 'US' AS country, 0.0 AS session_duration,
       0.0 AS account_age_days, 0.0 AS prior_orders, 0.0 AS prior_chargebacks, 0.0 AS discount_pct,
       'standard' AS shipping_speed, 0.0 AS hour_of_day, 0 AS is_weekend, 0.0 AS cart_size,
       0.0 AS merchant_risk_score, false AS is_high_value, false AS is_fraud
FROM e""")
def q_payload_defaults(spark, sf):
    """Requests carrying only ids, price, type and (sometimes) device get typed defaults."""
    ev = stream_events(spark, sf).select(
        F.col("step").alias("event_id"), F.col("user_id").cast("double").alias("user_id"),
        r6("price").alias("price"), "event_type",
        F.when(F.col("event_type") == "view", F.lit(None).cast("string")).otherwise(F.lit("mobile"))
         .alias("device_type"))
    return X.payload_defaults(ev)


# ---------------------------------------------------------------- validate_rows
@query("validate_rows", sql=with_ctes("e AS (SELECT * FROM events)") + """
, r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS session_duration,
              CASE WHEN event_type = 'error' THEN event_type ELSE CAST(value AS VARCHAR) END AS price,
              CASE WHEN event_type = 'signup' THEN 'n/a' ELSE '1' END AS cart_size FROM e),
b AS (SELECT event_id, list_filter([
        CASE WHEN user_id IS NOT NULL AND TRY_CAST(user_id AS DOUBLE) IS NULL THEN 'user_id' END,
        CASE WHEN price IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NULL THEN 'price' END,
        CASE WHEN session_duration IS NOT NULL AND TRY_CAST(session_duration AS DOUBLE) IS NULL THEN 'session_duration' END,
        CASE WHEN cart_size IS NOT NULL AND TRY_CAST(cart_size AS DOUBLE) IS NULL THEN 'cart_size' END], lambda x: x IS NOT NULL) AS bad
      FROM r)
SELECT event_id, bad[1] AS reject_field, len(bad) = 0 AS is_valid,
       array_to_string(list_transform(bad, lambda x: 'not a number: ' || x), '; ') AS reasons FROM b""")
def q_validate_rows(spark, sf):
    """All non-numeric numeric fields per request (error events carry text prices)."""
    ev = stream_events(spark, sf)
    req = ev.select(F.col("step").alias("event_id"), F.col("user_id").cast("string").alias("user_id"),
                    F.get_json_object("props", "$.k").alias("session_duration"),
                    F.when(F.col("event_type") == "error", F.col("event_type"))
                     .otherwise(F.col("price").cast("string")).alias("price"),
                    F.when(F.col("event_type") == "signup", F.lit("n/a")).otherwise(F.lit("1")).alias("cart_size"))
    return X.validate_rows(req).select("event_id", "reject_field", "is_valid", F.array_join("reasons", "; ").alias("reasons"))


# ---------------------------------------------------------------- validate_schema / schema_summary (rows-only)
@query("validate_schema")
def q_validate_schema(spark, sf):
    """Schema check of the transaction table against the benchmark's feature split."""
    t = transactions(spark, sf)
    missing = [f for f in C.MODEL_FEATURES if f not in CANONICAL]
    return S.validate_schema(spark, t, target="is_fraud", canonical=CANONICAL, predictive=PREDICTIVE,
                             missing=missing)


@query("schema_summary")
def q_schema_summary(spark, sf):
    missing = [f for f in C.MODEL_FEATURES if f not in CANONICAL]
    return S.schema_summary(spark, canonical=CANONICAL, predictive=PREDICTIVE, missing=missing)


# ---------------------------------------------------------------- concat_features
@query("concat_features", sql=with_ctes(TXN) + f"""
SELECT order_key, line_number, round({num_sql('price', 0)}, 6) AS price, round({num_sql('hour_of_day', 0)}, 6) AS hour_of_day,
       CAST({num_sql('is_weekend', 0)} AS INTEGER) AS is_weekend, CAST({num_sql('is_high_value', 0)} AS INTEGER) AS is_high_value,
       round({num_sql('account_age_days', 0)}, 6) AS account_age_days, {cat_sql('device_type', 'device_type')} AS device_type,
       {cat_sql('category', 'category')} AS category, round(merchant_risk_score, 6) AS merchant_risk_score,
       round(session_duration, 6) AS session_duration, round(prior_orders, 6) AS prior_orders,
       round(prior_chargebacks, 6) AS prior_chargebacks, round(discount_pct, 6) AS discount_pct,
       round(cart_size, 6) AS cart_size
FROM txn""")
def q_concat_features(spark, sf):
    """Canonical features encoded, predictive features raw, side by side in model order."""
    t = transactions(spark, sf)
    out = S.concat_features(t, CANONICAL, PREDICTIVE, keep=["order_key", "line_number"])
    types = dict(out.dtypes)
    return out.select("order_key", "line_number",
                      *[(r6(F.col(f)) if types[f] == "double" else F.col(f)).alias(f) for f in MODEL])


# ---------------------------------------------------------------- time_features
@query("time_features", sql="""SELECT event_id, hour(ts) AS hour_of_day, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend
FROM events""")
def q_time_features(spark, sf):
    ev = stream_events(spark, sf)
    hour, weekend = X.time_features("event_time")
    return ev.select(F.col("step").alias("event_id"), hour, weekend)


# ---------------------------------------------------------------- rule_label
@query("rule_label", sql=with_ctes(STX) + """
SELECT step,
  CAST(coalesce(price > 180.0 AND merchant_risk_score > 0.25, false) OR coalesce(prior_chargebacks >= 1 AND discount_pct > 0.20, false) AS INTEGER) AS label_base,
  CAST(coalesce(price > 180.0 AND merchant_risk_score > 0.25, false) OR coalesce(prior_chargebacks >= 1 AND discount_pct > 0.20, false)
       OR coalesce(device_type = 'tablet' AND merchant_risk_score < 0.10, false) AS INTEGER) AS label_shifted,
  CAST(CASE WHEN is_current THEN coalesce(price > 180.0 AND merchant_risk_score > 0.25, false) OR coalesce(prior_chargebacks >= 1 AND discount_pct > 0.20, false)
       OR coalesce(device_type = 'tablet' AND merchant_risk_score < 0.10, false)
       ELSE coalesce(price > 180.0 AND merchant_risk_score > 0.25, false) OR coalesce(prior_chargebacks >= 1 AND discount_pct > 0.20, false) END AS INTEGER) AS label_by_period
FROM stx""")
def q_rule_label(spark, sf):
    """Base rule, concept-shift rule, and the shift switched on in the current period."""
    s = stream_transactions(spark, sf)
    return s.select("step", X.rule_label().alias("label_base"), X.rule_label(concept_shift=True).alias("label_shifted"),
                    X.rule_label(concept_shift=F.col("is_current")).alias("label_by_period"))


# ---------------------------------------------------------------- scorecard / linear_score
def scorecard_sql() -> str:
    from vigil.plans.q_metrics import score_sql
    return score_sql()


@query("scorecard", sql=with_ctes(STX) + f"SELECT step, round({scorecard_sql()}, 6) AS score FROM stx")
def q_scorecard(spark, sf):
    s = stream_transactions(spark, sf)
    return s.select("step", r6(X.scorecard()).alias("score"))


@query("linear_score", sql="""SELECT event_id, round(0.01 + least(greatest((value - 10.0) / 2000.0, 0.0), 0.99), 6)
       AS score, round(0.01 + least(greatest((value * 10.0 - 10.0) / 2000.0, 0.0), 0.99), 6) AS score_scaled
FROM events""")
def q_linear_score(spark, sf):
    ev = stream_events(spark, sf)
    return ev.select(F.col("step").alias("event_id"), r6(X.linear_score("price")).alias("score"),
                     r6(X.linear_score(F.col("price") * 10.0)).alias("score_scaled"))


# ---------------------------------------------------------------- cohort_rewrite
def what_if_cohorts() -> list:
    """Rows with chargebacks get twice the risk; of the others, mobile rows over 100 get a discount."""
    return [(F.col("prior_chargebacks") >= 1, {"merchant_risk_score": F.least(F.col("merchant_risk_score") * 2.0, F.lit(1.0))}),
            ((F.col("device_type") == "mobile") & (F.col("price") > 100.0),
             {"price": F.col("price") * 0.9, "discount_pct": F.col("discount_pct") + 0.1, "channel": F.lit("email")})]


@query("cohort_rewrite", sql=with_ctes(STX) + """, c AS (
  SELECT *, prior_chargebacks >= 1 AS a, prior_chargebacks < 1 AND device_type = 'mobile' AND price > 100.0 AS b FROM stx)
SELECT step, round(CASE WHEN b THEN price * 0.9 ELSE price END, 6) AS price,
       round(CASE WHEN b THEN discount_pct + 0.1 ELSE discount_pct END, 6) AS discount_pct,
       round(CASE WHEN a THEN least(merchant_risk_score * 2.0, 1.0) ELSE merchant_risk_score END, 6) AS merchant_risk_score,
       CASE WHEN b THEN 'email' ELSE channel END AS channel, is_fraud
FROM c""")
def q_cohort_rewrite(spark, sf):
    """Two what-if cohorts over the event stream; the first that fits a row rewrites it."""
    out = X.cohort_rewrite(stream_transactions(spark, sf), what_if_cohorts())
    return out.select("step", *[r6(c).alias(c) for c in ("price", "discount_pct", "merchant_risk_score")], "channel", "is_fraud")


@query("cohort_share")
def q_cohort_share(spark, sf):
    """A quarter of the rows of every 1000, by hash, rewritten (rows-only: the hash is Spark's)."""
    s = stream_transactions(spark, sf)
    out = X.cohort_rewrite(s, [(X.hash_share("step", 42, 0.25), {"device_type": F.lit("kiosk")})])
    return out.groupBy((F.col("step") / 1000).cast("long").alias("block")).agg(
        F.count_if(F.col("device_type") == "kiosk").alias("rewritten_rows"), F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- adapt
@query("adapt", sql=with_ctes(TXN) + """
SELECT order_key, line_number, round(price, 6) AS price, device_type, category, round(session_duration, 6) AS session_duration,
       round(discount_pct, 6) AS discount_pct, is_fraud
FROM txn""")
def q_adapt(spark, sf):
    """Adapter contract: raw lineitem -> canonical names by mapping, predictive kept, target named."""
    t = transactions(spark, sf)
    src = t.select("order_key", "line_number", F.col("price").alias("amount"), "device_type",
                   F.col("category").alias("product_group"), "session_duration", "discount_pct",
                   F.col("is_fraud").alias("label"))
    out = S.adapt(src, mapping={"price": "amount", "category": "product_group", "device_type": "device_type"},
                  predictive=["session_duration", "discount_pct"], target="label", keep=["order_key", "line_number"])
    frame = out["frame"]
    return frame.select("order_key", "line_number", r6("price").alias("price"), "device_type", "category",
                        r6("session_duration").alias("session_duration"), r6("discount_pct").alias("discount_pct"),
                        "is_fraud")
