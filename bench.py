"""Benchmark: headline queries on $BENCH_SF_DIR (default sf0.1) with local[$BENCH_CPUS].

Each query is executed fully through the ``noop`` sink (no driver collect).
Untimed warm-up first: JVM, Python workers, one flagship pass on sf0.001.
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigil.plans import QUERIES  # noqa: E402
from vigil.session import build_session  # noqa: E402

HEADLINE = [
    "psi_report",          # flagship: mean PSI over four features, baseline vs current
    "psi",                 # keyed PSI per event type
    "ks_two_sample",       # KS statistic per event type
    "encode_features",     # 19-feature encoding of every transaction
    "scorecard",           # scoring
    "threshold_curve",     # 99-threshold curve in one aggregation
    "roc_auc",             # ties-averaged AUC per event type
    "rolling_confusion",   # 50-row windows at the row's own threshold
    "rolling_psi",         # 50-row rolling PSI vs a static baseline
    "job_current",         # latest-non-null per job field
    "train_champion",      # gradient-boosted trees on the encoded baseline
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app_name="vigil-bench", shuffle_partitions=max(cpus, 8))
    # warm-up: JVM, file listing and the Arrow Python workers used by prefix_sum
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ev.write.format("noop").mode("overwrite").save()
    ev.select("event_id").mapInPandas(lambda it: it, "event_id long").write.format("noop").mode("overwrite").save()
    # JIT warm-up: one untimed pass of the flagship query on the smallest scale, if present
    smoke = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(smoke):
        QUERIES["psi_report"](spark, smoke).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
