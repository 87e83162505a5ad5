"""The same test-table bindings as ``vigil.sources.tables``, written as ANSI
SQL common table expressions for the DuckDB oracle."""

from __future__ import annotations

from vigil import config as C
from vigil.sources.tables import EVENTS_CURRENT_FROM, TXN_CURRENT_FROM


def sql_pick(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({expr}) % {len(values)} {whens} END)"


def sql_round(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places})"


TXN = f"""txn AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_shipdate AS event_time,
         l_suppkey AS user_id, l_partkey AS product_id, l_extendedprice / 100.0 AS price,
         CASE WHEN l_linestatus = 'F' THEN 'purchase' ELSE 'cart' END AS event_type,
         {sql_pick('l_partkey', list(C.CATEGORY_MAPS['category']))} AS category,
         {sql_pick('l_suppkey', list(C.CATEGORY_MAPS['device_type']))} AS device_type,
         {sql_pick('l_orderkey', list(C.CATEGORY_MAPS['channel']))} AS channel,
         upper({sql_pick('l_suppkey', list(C.CATEGORY_MAPS['country']))}) AS country,
         l_quantity * 10.0 AS session_duration,
         l_orderkey % 3650 AS account_age_days,
         l_partkey % 121 AS prior_orders,
         l_linenumber - 1 AS prior_chargebacks,
         l_discount AS discount_pct,
         {sql_pick('l_linenumber', list(C.CATEGORY_MAPS['shipping_speed']))} AS shipping_speed,
         hour(l_shipdate) AS hour_of_day,
         CAST(isodow(l_shipdate) >= 6 AS INTEGER) AS is_weekend,
         l_linenumber AS cart_size,
         l_tax * 5.0 AS merchant_risk_score,
         l_returnflag AS return_flag,
         CAST(l_extendedprice / 100.0 > {C.HIGH_VALUE_PRICE} AS INTEGER) AS is_high_value,
         CAST((l_extendedprice / 100.0 > 180.0 AND l_tax * 5.0 > 0.25)
              OR (l_linenumber - 1 >= 1 AND l_discount > 0.20) AS INTEGER) AS is_fraud,
         l_shipdate >= TIMESTAMP '{TXN_CURRENT_FROM}' AS is_current
  FROM lineitem)"""

EVT = f"""evt AS (
  SELECT event_id AS step, ts AS event_time, user_id, event_type AS scenario, event_type,
         value AS price, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS prop_k, props,
         ts >= TIMESTAMP '{EVENTS_CURRENT_FROM}' AS is_current
  FROM events)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

STX = f"""stx AS (
  SELECT *, CAST(price > {C.HIGH_VALUE_PRICE} AS INTEGER) AS is_high_value,
         CAST((price > 180.0 AND merchant_risk_score > 0.25) OR (prior_chargebacks >= 1 AND discount_pct > 0.20)
              AS INTEGER) AS is_fraud
  FROM (SELECT event_id AS step, ts AS event_time, user_id, k AS product_id, value AS price, event_type,
          {sql_pick('user_id', list(C.CATEGORY_MAPS['category']))} AS category,
          {sql_pick('event_id', list(C.CATEGORY_MAPS['device_type']))} AS device_type,
          {sql_pick('user_id + 1', list(C.CATEGORY_MAPS['channel']))} AS channel,
          upper({sql_pick('user_id', list(C.CATEGORY_MAPS['country']))}) AS country,
          CAST(k AS DOUBLE) * 10.0 AS session_duration, (user_id * 37) % 3650 AS account_age_days,
          user_id % 121 AS prior_orders, CAST(event_id % 7 = 0 AS BIGINT) AS prior_chargebacks,
          CAST(k % 50 AS DOUBLE) / 100.0 AS discount_pct,
          {sql_pick('k', list(C.CATEGORY_MAPS['shipping_speed']))} AS shipping_speed,
          hour(ts) AS hour_of_day, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
          k % 19 AS cart_size, CAST(user_id % 45 AS DOUBLE) / 100.0 AS merchant_risk_score,
          ts >= TIMESTAMP '{EVENTS_CURRENT_FROM}' AS is_current
        FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"""
