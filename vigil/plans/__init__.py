"""Registered queries over the driver's test tables (import to register)."""

from vigil.plans import q_drift, q_features, q_io, q_jobs, q_metrics, q_models, q_rolling  # noqa: F401
from vigil.plans.registry import ORACLES, QUERIES  # noqa: F401
