"""Schema-level operators: validation, medians, imputation, feature assembly,
canonical/predictive concatenation and the adapter contract (SURVEY §2.2, §2.9).

Resolution of which column feeds which model feature happens at plan time
(``df.columns``); the data work is a single ``select`` per frame.  Medians are
computed once as a small (feature, median) table and attached as scalar
subqueries — never collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import config as C
from vigil.functions.features import encoded_column
from vigil.operators.drift import quantiles, to_long


def medians(df: DataFrame, features: list[str], keys=None, method: str = "exact") -> DataFrame:
    """Exact (or approximate) median of each numeric feature: (keys…, feature, median)."""
    keys = list(keys or [])
    long = to_long(df, features, keys)
    q = quantiles(long, "value", [0.5], keys=[*keys, "feature"], method=method, out_col="_q")
    return q.select(*keys, "feature", F.col("_q")[0].alias("median"))


def _median_of(meds: DataFrame, feature: str):
    return meds.where(F.col("feature") == F.lit(feature)).select("median").scalar()


def median_impute(df: DataFrame, meds: DataFrame, columns: list[str]) -> DataFrame:
    """NULL (and NaN) values take the feature's median."""
    out = []
    for c in df.columns:
        if c in columns:
            x = F.col(c)
            out.append(F.coalesce(F.when(F.isnan(x), F.lit(None)).otherwise(x), _median_of(meds, c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def feature_assemble(df: DataFrame, model_features: list[str], mapping: dict[str, str] | None = None,
                     medians: DataFrame | None = None, median_features: list[str] | None = None,
                     keep: list[str] | None = None) -> DataFrame:
    """Per model feature: own column -> mapped source column -> median -> missing.

    Raises ``ValueError`` listing every feature that cannot be supplied.
    """
    mapping = mapping or {}
    if medians is not None and median_features is None:
        # the feature list of the medians table (bounded by the schema, not the data)
        median_features = [r[0] for r in medians.select("feature").distinct().collect()]
    median_features = median_features or []
    cols, missing = [F.col(k) for k in (keep or [])], []
    for f in model_features:
        if f in df.columns:
            cols.append(F.col(f).alias(f))
        elif mapping.get(f) in df.columns:
            cols.append(F.col(mapping[f]).alias(f))
        elif medians is not None and f in median_features:
            cols.append(_median_of(medians, f).alias(f))
        else:
            missing.append(f)
    if missing:
        raise ValueError(f"model requires features {missing} that are not supplied and have no default")
    return df.select(*cols)


def concat_features(df: DataFrame, canonical: list[str], predictive: list[str],
                    keep: list[str] | None = None) -> DataFrame:
    """Canonical features encoded + predictive features raw, in model order (one select)."""
    cols = [F.col(k) for k in (keep or [])]
    cols += [encoded_column(df, f) for f in canonical]
    cols += [F.col(f) for f in predictive]
    return df.select(*cols)


def validate_schema(spark: SparkSession, df: DataFrame, target: str, canonical: list[str],
                    predictive: list[str], missing: list[str]) -> DataFrame:
    """One row per violation (rule, feature); empty when the schema is valid."""
    rows = []
    if target not in df.columns:
        rows.append(("target_absent", target))
    rows += [("feature_absent", f) for f in canonical + predictive if f not in df.columns]
    rows += [("not_canonical", f) for f in canonical if f not in C.MODEL_FEATURES]
    rows += [("unaccounted", f) for f in C.MODEL_FEATURES if f not in canonical and f not in missing]
    schema = T.StructType([T.StructField("rule", T.StringType()), T.StructField("feature", T.StringType())])
    return spark.createDataFrame(rows, schema)


def schema_summary(spark: SparkSession, canonical: list[str], predictive: list[str],
                   missing: list[str]) -> DataFrame:
    """Counts of required / available / engineered / predictive / missing / total features."""
    row = (len(C.MODEL_FEATURES), len(canonical), 0, len(predictive), len(missing),
           len(canonical) + len(predictive))
    names = ["required", "available", "engineered", "predictive", "missing", "total"]
    return spark.createDataFrame([row], T.StructType([T.StructField(n, T.IntegerType()) for n in names]))


def adapt(df: DataFrame, mapping: dict[str, str], predictive: list[str], target: str,
          keep: list[str] | None = None, median_method: str = "exact") -> dict:
    """Adapter contract: canonical columns by mapping (canonical -> source), predictive
    columns kept, target renamed ``is_fraud``, missing canonical features declared,
    medians of the numeric model features as a small table."""
    cols = [F.col(k) for k in (keep or [])]
    canonical = [c for c, src in mapping.items() if src in df.columns]
    cols += [F.col(mapping[c]).alias(c) for c in canonical]
    cols += [F.col(p) for p in predictive if p in df.columns]
    cols.append(F.col(target).alias("is_fraud"))
    frame = df.select(*cols)
    numeric = [c for c in canonical + predictive if c not in C.CATEGORY_MAPS]
    missing = [f for f in C.MODEL_FEATURES if f not in canonical]
    return {"frame": frame, "medians": medians(frame, numeric, method=median_method),
            "mapping": dict(mapping), "canonical": canonical, "predictive": list(predictive),
            "missing": missing}
