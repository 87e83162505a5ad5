"""Column expressions for feature preparation, labels and scores.

Every function here returns a ``Column`` (or a DataFrame built from one
``select``), so the whole preparation stays inside one whole-stage-codegen
span: no Python UDF, no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config as C


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


# ---------------------------------------------------------------- numbers

def to_number(c, default: float | None = None) -> Column:
    """Lenient number: malformed text -> NULL, NaN -> NULL, then the default.

    ANSI mode is on in Spark 4, so a plain cast of ``'abc'`` raises; ``try_cast``
    gives NULL instead.
    """
    x = _c(c).try_cast("double")
    x = F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def numeric_coerce(df: DataFrame, columns: list[str] | None = None,
                   defaults: dict | None = None) -> DataFrame:
    """Coerce the named columns to double; absent columns take the default."""
    defaults = defaults or C.DEFAULT_NUMERIC_VALUES
    columns = columns or list(defaults)
    out = []
    for name in columns:
        d = float(defaults.get(name, 0.0))
        out.append((to_number(name, d) if has_column(df, name) else F.lit(d)).alias(name))
    keep = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*keep, *out)


def flag_high_value(df: DataFrame, price_col: str = "price",
                    flag_col: str = "is_high_value", threshold: float = C.HIGH_VALUE_PRICE) -> Column:
    """Absent flag -> price > threshold; present -> coerced int, bad -> 0."""
    if not has_column(df, flag_col):
        return (to_number(price_col, 0.0) > F.lit(threshold)).cast("int")
    return F.coalesce(to_number(flag_col, 0.0).try_cast("int"), F.lit(0))  # out of range counts as bad


def flag_weekend(df: DataFrame, flag_col: str = "is_weekend") -> Column:
    if not has_column(df, flag_col):
        return F.lit(0)
    return F.coalesce(to_number(flag_col, 0.0).try_cast("int"), F.lit(0))  # out of range counts as bad


def stream_high_value(price="price", flag="is_high_value", threshold: float = C.HIGH_VALUE_PRICE) -> Column:
    """price > threshold -> 1, else keep the incoming flag (NULL price keeps it)."""
    return F.when(_c(price) > F.lit(threshold), F.lit(1)).otherwise(_c(flag).try_cast("int"))


# ---------------------------------------------------------------- categories

def category_code(c, mapping: dict[str, int]) -> Column:
    """lower-case lookup; unknown or NULL -> the largest code."""
    default = max(mapping.values())
    low = F.lower(_c(c).cast("string"))
    expr = None
    for key, code in mapping.items():
        expr = (F.when(low == F.lit(key), F.lit(code)) if expr is None
                else expr.when(low == F.lit(key), F.lit(code)))
    return expr.otherwise(F.lit(default))


def category_encode(df: DataFrame, name: str, mapping: dict[str, int] | None = None) -> Column:
    mapping = mapping or C.CATEGORY_MAPS[name]
    if not has_column(df, name):
        return F.lit(mapping[next(iter(mapping))])
    return category_code(name, mapping)


def encoded_column(df: DataFrame, name: str, high_value_threshold: float = C.HIGH_VALUE_PRICE) -> Column:
    """One model feature as the encoder produces it (numeric double, flags int, codes int)."""
    if name == "is_high_value":
        if has_column(df, name):
            return flag_high_value(df).alias(name)
        return (to_number("price", 0.0) > F.lit(high_value_threshold)).cast("int").alias(name)
    if name == "is_weekend":
        return flag_weekend(df).alias(name)
    if name in C.CATEGORY_MAPS:
        return category_encode(df, name).alias(name)
    if has_column(df, name):
        return to_number(name, C.DEFAULT_NUMERIC_VALUES.get(name, 0.0)).alias(name)
    return F.lit(float(C.DEFAULT_NUMERIC_VALUES.get(name, 0.0))).alias(name)


def encode_features(df: DataFrame, high_value_threshold: float = C.HIGH_VALUE_PRICE,
                    keep: list[str] | None = None) -> DataFrame:
    """The 19 model features in fixed order (numeric as double, codes as int)."""
    cols = [F.col(k) for k in (keep or [])]
    cols += [encoded_column(df, n, high_value_threshold) for n in C.MODEL_FEATURES]
    return df.select(*cols)


# ---------------------------------------------------------------- payloads

def payload_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Absent request fields get typed defaults; NULLs take them too."""
    defaults = defaults or C.PAYLOAD_DEFAULTS
    out = []
    for name in df.columns:
        if name in defaults:
            out.append(F.coalesce(F.col(name), F.lit(defaults[name])).alias(name))
        else:
            out.append(F.col(name))
    for name, value in defaults.items():
        if name not in df.columns:
            out.append(F.lit(value).alias(name))
    return df.select(*out)


def validate_rows(df: DataFrame, numeric_fields: list[str] | None = None) -> DataFrame:
    """Adds ``reasons`` (one text per non-numeric field, in field order; empty if the row is valid),
    ``reject_field`` (the first such field) and ``is_valid``.

    A field is bad when a value is present but does not parse as a number.
    """
    fields = [f for f in (numeric_fields or C.REQUEST_NUMERIC_FIELDS) if has_column(df, f)]
    bad = [F.when(F.col(f).isNotNull() & F.col(f).try_cast("double").isNull(), F.lit(f)) for f in fields]
    found = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return df.withColumn("_bad", found).select(
        *df.columns, F.transform("_bad", lambda f: F.concat(F.lit("not a number: "), f)).alias("reasons"),
        F.try_element_at("_bad", F.lit(1)).alias("reject_field"), (F.size("_bad") == 0).alias("is_valid"))


def split_valid(df: DataFrame, numeric_fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows as they came, rejects with all their ``reasons``)."""
    seen = validate_rows(df, numeric_fields)
    return seen.where("is_valid").select(*df.columns), seen.where("NOT is_valid").select(*df.columns, "reasons")


def time_features(ts="event_time") -> tuple[Column, Column]:
    """hour of day and weekend flag (Monday = 0, weekend = day >= 5)."""
    t = _c(ts)
    return F.hour(t).alias("hour_of_day"), (F.weekday(t) >= 5).cast("int").alias("is_weekend")


# ---------------------------------------------------------------- labels and scores

def rule_label(price="price", risk="merchant_risk_score", chargebacks="prior_chargebacks",
               discount="discount_pct", device="device_type", concept_shift=False) -> Column:
    """Rule label; the concept-shift variant adds tablet with low risk.

    ``concept_shift`` may be a bool or a boolean Column (e.g. ``step >= 300``).
    NULL comparisons count as false, as numpy's do for NaN.
    """
    p, r, cb, d = _c(price), _c(risk), _c(chargebacks), _c(discount)
    base = F.coalesce((p > 180.0) & (r > 0.25), F.lit(False)) | \
        F.coalesce((cb >= 1) & (d > 0.20), F.lit(False))
    shifted = base | F.coalesce((_c(device) == F.lit("tablet")) & (r < 0.10), F.lit(False))
    if isinstance(concept_shift, bool):
        return (shifted if concept_shift else base).cast("int")
    return F.when(F.coalesce(concept_shift, F.lit(False)), shifted).otherwise(base).cast("int")


def scorecard(terms=None, intercept: float | None = None) -> Column:
    """Weighted sum of conditions -> logistic -> clipped to [0.01, 0.99]."""
    terms = terms or C.SCORECARD_TERMS
    z = F.lit(C.SCORECARD_INTERCEPT if intercept is None else intercept)
    for expr, w in terms:
        z = z + F.lit(w) * F.coalesce(F.expr(expr).cast("double"), F.lit(0.0))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    # quantised to 1e-10 so score ties do not hinge on the last bit of exp()
    return round_half_up(F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99)), 10)


def linear_score(price="price") -> Column:
    """Fallback scorer: 0.01 + clip((price - 10) / 2000, 0, 0.99)."""
    x = (_c(price) - F.lit(10.0)) / F.lit(2000.0)
    return F.lit(0.01) + F.least(F.greatest(x, F.lit(0.0)), F.lit(0.99))


def round_half_up(c, places: int) -> Column:
    """floor(x * 10^p + 0.5) / 10^p on binary doubles (engine independent)."""
    k = float(10 ** places)
    return F.floor(_c(c) * F.lit(k) + F.lit(0.5)) / F.lit(k)


# ---------------------------------------------------------------- cohort rewrite

def cohort_rewrite(df: DataFrame, cohorts: list[tuple[Column, dict]],
                   otherwise: dict | None = None) -> DataFrame:
    """What-if replay: rows in a cohort get columns rewritten.

    ``cohorts`` is a list of (condition, {column: Column}); the first matching
    cohort wins.  All new values read the *original* columns (one ``select``).
    ``otherwise`` gives expressions for rows in no cohort.
    """
    otherwise = otherwise or {}
    touched = []
    for _, spec in cohorts:
        touched += [c for c in spec if c not in touched]
    touched += [c for c in otherwise if c not in touched]
    out = []
    for name in df.columns:
        if name not in touched:
            out.append(F.col(name))
    for name in touched:
        base = F.col(name) if name in df.columns else F.lit(None)
        expr = None
        for cond, spec in cohorts:  # a cohort that leaves the column alone still takes the row
            value = spec.get(name, base)
            expr = F.when(cond, value) if expr is None else expr.when(cond, value)
        rest = otherwise.get(name, base)
        out.append((rest if expr is None else expr.otherwise(rest)).alias(name))
    return df.select(*out)


def hash_share(key, seed: int, share) -> Column:
    """Deterministic share of rows: pmod(xxhash64(key, seed), 10000) < share * 10000."""
    return F.pmod(F.xxhash64(_c(key), F.lit(seed)), F.lit(10000)) < (
        (share if isinstance(share, Column) else F.lit(float(share))) * F.lit(10000.0))
