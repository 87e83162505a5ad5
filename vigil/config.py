"""Fixed values of the transaction model.

Fixed values: these lists, maps and defaults must equal the reference's for
encodings, defaults and monitoring to give the same results.  They are stated
plainly, in natural order.
"""

from __future__ import annotations

# ---- fixed values: feature names (order is the model's column order) ----
NUMERIC_FEATURES = [
    "user_id", "product_id", "price", "session_duration", "account_age_days",
    "prior_orders", "prior_chargebacks", "discount_pct", "hour_of_day",
    "cart_size", "merchant_risk_score", "is_high_value", "is_weekend",
]
CATEGORICAL_FEATURES = [
    "event_type", "category", "device_type", "channel", "country", "shipping_speed",
]
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES

# ---- fixed values: category codes (keys lower case) ----
CATEGORY_MAPS = {
    "event_type": {"view": 0, "cart": 1, "purchase": 2},
    "category": {"electronics": 0, "fashion": 1, "home": 2, "beauty": 3,
                 "sports": 4, "grocery": 5, "travel": 6, "luxury": 7},
    "device_type": {"desktop": 0, "mobile": 1, "tablet": 2},
    "channel": {"organic": 0, "email": 1, "social": 2, "paid_search": 3, "affiliate": 4},
    "country": {"us": 0, "ca": 1, "gb": 2, "de": 3, "in": 4, "br": 5, "ae": 6, "sg": 7},
    "shipping_speed": {"standard": 0, "expedited": 1, "overnight": 2, "pickup": 3},
}

# ---- fixed values: numeric defaults for absent / malformed values ----
DEFAULT_NUMERIC_VALUES = {
    "user_id": 0, "product_id": 0, "price": 0.0, "session_duration": 0.0,
    "account_age_days": 0, "prior_orders": 0, "prior_chargebacks": 0,
    "discount_pct": 0.0, "hour_of_day": 0, "cart_size": 0,
    "merchant_risk_score": 0.0, "is_high_value": 0, "is_weekend": 0,
}

# ---- fixed values: request defaults of the scoring payload ----
PAYLOAD_DEFAULTS = {
    "category": "electronics", "device_type": "desktop", "channel": "organic",
    "country": "US", "session_duration": 0.0, "account_age_days": 0.0,
    "prior_orders": 0.0, "prior_chargebacks": 0.0, "discount_pct": 0.0,
    "shipping_speed": "standard", "hour_of_day": 0.0, "is_weekend": 0,
    "cart_size": 0.0, "merchant_risk_score": 0.0, "is_high_value": False,
    "is_fraud": False,
}
# fields of the request that must be numeric
REQUEST_NUMERIC_FIELDS = [
    "user_id", "product_id", "price", "session_duration", "account_age_days",
    "prior_orders", "prior_chargebacks", "discount_pct", "hour_of_day",
    "is_weekend", "cart_size", "merchant_risk_score",
]

# ---- fixed values: monitoring ----
MONITORED_FEATURES = ["price", "discount_pct", "session_duration", "merchant_risk_score"]
PSI_BUCKETS = 10
PSI_ALERT = 0.2                 # alert when mean PSI > 0.2 (strict)
PSI_FLOOR = 0.0001              # zero share replaced by this
PSI_MIN_ROWS = 10               # no report at <= 10 current rows
MONITOR_RECENT_ROWS = 200
RETRAIN_RECENT_ROWS = 1000
MEAN_SHIFT_LIMIT = 0.25
JOB_TIMEOUT_SECONDS = 300       # 5 minutes
JOB_COOLDOWN_SECONDS = 40
MIN_RETRAIN_ROWS = 50
HIGH_VALUE_PRICE = 500.0
FINISHED_JOB_STATES = ["COMPLETED", "FAILED", "REJECTED"]
JOB_STATES = ["PENDING", "STARTED", "SHAP_ANALYSIS", "EVALUATING",
              "TRAINING_CHALLENGER", "COMPARING", "COMPLETED", "FAILED", "REJECTED"]

# ---- fixed values: synthetic benchmark timeline ----
WINDOW_SIZE = 50
SMOOTH_WINDOW = 15
DRIFT_START = 300
RETRAIN_TRIGGER = 500
MODEL_DEPLOYED = 650
SECOND_DRIFT_START = 700
SECOND_RETRAIN_TRIGGER = 820
SECOND_MODEL_DEPLOYED = 920

# stages of a monitored series, in order; each is measured (see operators.rolling.stage_of_step)
STAGES = {
    "Warm-up": "window not full",
    "Monitoring": "no breach so far",
    "Drift Detected": "first rolling PSI over the alert level",
    "Drift Active": "rolling PSI over the alert level",
    "Recovered": "rolling PSI back under the alert level",
}

# ---- fixed values: fallback pseudo-label weights (rank-percent terms) ----
PSEUDO_LABEL_WEIGHTS = {
    "price": 0.30, "session_duration": -0.10, "prior_chargebacks": 0.25,
    "merchant_risk_score": 0.20, "discount_pct": -0.10, "account_age_days": -0.15,
}
PSEUDO_LABEL_BIASES = [  # (column, values, weight)
    ("event_type", ["cart", "purchase"], 0.12),
    ("channel", ["social", "affiliate"], 0.14),
    ("device_type", ["mobile"], 0.08),
]

# ---- fixed values: scorecard weights of the mock generator (no noise term) ----
SCORECARD_INTERCEPT = -4.0
SCORECARD_TERMS = [
    # (sql condition or numeric expression, weight)
    ("price", 0.0023),
    ("CAST(event_type = 'purchase' AS DOUBLE)", 1.00),
    ("CAST(event_type = 'cart' AS DOUBLE)", 0.55),
    ("CAST(device_type = 'mobile' AS DOUBLE)", 0.55),
    ("CAST(channel = 'social' AS DOUBLE)", 0.75),
    ("CAST(channel = 'affiliate' AS DOUBLE)", 0.85),
    ("CAST(country IN ('BR', 'IN', 'AE') AS DOUBLE)", 0.70),
    ("CAST(shipping_speed = 'overnight' AS DOUBLE)", 0.60),
    ("CAST(discount_pct < 0.05 AS DOUBLE)", 0.90),
    ("CAST(prior_chargebacks > 0 AS DOUBLE)", 1.10),
    ("CAST(account_age_days < 60 AS DOUBLE)", 0.35),
    ("CAST(session_duration < 120 AS DOUBLE)", 0.30),
    ("CAST(cart_size >= 4 AS DOUBLE)", 0.25),
    ("merchant_risk_score", 0.45),
    ("CAST(prior_orders > 20 AS DOUBLE)", -0.30),
    ("is_weekend", 0.20),
]

# ---- fixed values: champion / challenger training parameters ----
CHAMPION_PARAMS = {"max_iter": 100, "max_depth": 5, "step_size": 0.1, "pos_weight": 15.0, "seed": 42}
CHALLENGER_PARAMS = {"max_iter": 100, "max_depth": 4, "step_size": 0.1, "pos_weight": 1.0, "seed": 100}
STRONG_CHALLENGER_PARAMS = {"max_iter": 300, "max_depth": 6, "step_size": 0.05, "pos_weight": 1.0, "seed": 123}

# ---- fixed values: the inference log table (column, type) in order ----
LOG_COLUMNS = [
    ("timestamp", "string"), ("user_id", "double"), ("product_id", "double"), ("price", "double"),
    ("event_type", "string"), ("category", "string"), ("device_type", "string"), ("channel", "string"),
    ("country", "string"), ("session_duration", "double"), ("account_age_days", "double"),
    ("prior_orders", "double"), ("prior_chargebacks", "double"), ("discount_pct", "double"),
    ("shipping_speed", "string"), ("hour_of_day", "double"), ("is_weekend", "int"), ("cart_size", "double"),
    ("merchant_risk_score", "double"), ("is_high_value", "int"), ("is_fraud", "int"),
    ("fraud_probability", "double"), ("model_version", "string"),
]
