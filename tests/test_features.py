import json

import pytest
from pyspark.sql import functions as F

from vigil import config as C
from vigil.functions import features as X
from vigil.sources import codec as K


def test_category_codes_unknown_null_mixed_case_absent(spark):
    df = spark.createDataFrame([("Mobile",), ("tablet",), ("phone",), (None,)], "device_type string")
    got = [r[0] for r in df.select(X.category_encode(df, "device_type")).collect()]
    assert got == [1, 2, 2, 2]  # unknown and NULL collide with the largest code
    absent = df.select(X.category_encode(df, "channel").alias("c")).distinct().collect()
    assert [r.c for r in absent] == [0]  # absent column -> first category


def test_numeric_coerce_malformed_nan_and_absent(spark):
    df = spark.createDataFrame([("12.5", float("nan")), ("abc", 2.0), (None, None)], "price string, discount_pct double")
    out = X.numeric_coerce(df, ["price", "discount_pct", "cart_size"]).collect()
    assert [(r.price, r.discount_pct, r.cart_size) for r in out] == [(12.5, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 0.0)]


def test_flags_absent_and_present(spark):
    df = spark.createDataFrame([(600.0, "1"), (400.0, "x"), (None, None)], "price double, is_high_value string")
    assert [r[0] for r in df.select(X.flag_high_value(df)).collect()] == [1, 0, 0]
    no_flag = df.drop("is_high_value")
    assert [r[0] for r in df.select(X.flag_high_value(no_flag)).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(X.flag_high_value(no_flag, threshold=400.0)).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(X.stream_high_value("price", F.lit(7))).collect()] == [1, 7, 7]


def test_encode_features_order_and_defaults(spark):
    df = spark.createDataFrame([(100.0, "CART", "US")], "price double, event_type string, country string")
    enc = X.encode_features(df)
    assert enc.columns == C.MODEL_FEATURES
    r = enc.first()
    assert (r.price, r.event_type, r.country, r.category, r.is_high_value, r.user_id) == (100.0, 1, 0, 0, 0, 0.0)


def test_validate_rows_first_bad_field(spark):
    df = spark.createDataFrame([("1", "x", "y"), ("1", "2", "3")], "user_id string, price string, cart_size string")
    out = X.validate_rows(df).collect()
    assert [(r.reject_field, r.is_valid) for r in out] == [("price", False), (None, True)]


def test_rejects_carry_all_their_reasons(spark):
    df = spark.createDataFrame([(1, "1", "x", "y"), (2, "1", "2", "3"), (3, None, "", "1e3"), (4, "u", "2", "3")], "id int, user_id string, price string, cart_size string")
    valid, rejects = X.split_valid(df)
    assert valid.columns == df.columns and [r.id for r in valid.collect()] == [2]
    assert {r.id: r.reasons for r in rejects.collect()} == {1: ["not a number: price", "not a number: cart_size"], 3: ["not a number: price"], 4: ["not a number: user_id"]}


def test_weekend_monday_zero(spark):
    df = spark.createDataFrame([("2024-01-06 10:00:00",), ("2024-01-08 23:00:00",)], "t string") \
        .select(F.to_timestamp("t").alias("t"))
    hour, weekend = X.time_features("t")
    assert [(r.hour_of_day, r.is_weekend) for r in df.select(hour, weekend).collect()] == [(10, 1), (23, 0)]


def test_rule_label_concept_shift(spark):
    df = spark.createDataFrame([(10.0, 0.05, 0, 0.0, "tablet", True), (10.0, 0.05, 0, 0.0, "tablet", False),
                                (200.0, 0.3, 0, 0.0, "desktop", False), (10.0, 0.0, 1, 0.3, "mobile", False)],
                               "price double, merchant_risk_score double, prior_chargebacks int, discount_pct double, "
                               "device_type string, shifted boolean")
    got = [r[0] for r in df.select(X.rule_label(concept_shift=F.col("shifted"))).collect()]
    assert got == [1, 0, 1, 1]


def test_json_decode_booleans_and_whole_doubles(spark):
    payload = {"event_time": "2025-01-01 00:00:00", "user_id": 7.0, "price": 12.5, "is_fraud": True,
               "is_high_value": "false", "cart_size": 3}
    df = spark.createDataFrame([(json.dumps(payload),)], "value string")
    r = K.json_decode(df).first()
    assert (r.user_id, r.is_fraud, r.is_high_value, r.cart_size, r.price) == (7, 1, 0, 3, 12.5)


def test_cohort_rewrite_first_match_reads_old_values(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "a"), (3, 30.0, "b")], "id long, x double, c string")
    out = {r.id: (r.x, r.c) for r in X.cohort_rewrite(
        df, [(F.col("x") > 25, {"x": F.col("x") * 2}), (F.col("x") > 15, {"x": F.col("x") + 1, "c": F.lit("z")})]).collect()}
    assert out == {1: (10.0, "a"), 2: (21.0, "z"), 3: (60.0, "b")}


def test_out_of_range_flags_are_bad(spark):
    df = spark.createDataFrame([("1e10",), ("1",), ("x",)], "is_weekend string")
    assert [r[0] for r in df.select(X.flag_weekend(df)).collect()] == [0, 1, 0]


def test_scorecard_clipped(spark):
    df = spark.createDataFrame([(0.0,), (1e6,)], "price double")
    vals = [r[0] for r in df.select(X.scorecard([("price", 0.0023)])).collect()]
    assert vals[0] == pytest.approx(0.0181, abs=1e-3) and vals[1] == 0.99
