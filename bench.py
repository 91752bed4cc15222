"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is executed in full with the ``noop`` sink (every row is produced, nothing is
collected).  Prints one JSON line:
``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ridelens.plans.catalog import QUERIES  # noqa: E402
from ridelens.session import local_session  # noqa: E402

HEADLINE = [
    "forecast_metrics",          # flagship: AG7 -> FC1 -> FC2/FC3/FC5 -> ME
    "forecast_all",              # AG7 + FC8
    "forecast_future",           # FC6
    "customer_features_orders",  # AG1 + AG2 + lookup join
    "trips_with_segment",        # JN1
    "crosstab_segment_priority", # AG5
    "dedup_lineitem",            # FL1
    "quantile_cap_lineitem",     # FE2 (distributed exact quantiles)
    "collapse_rare_bookings",    # FE3
    "clean_bookings",            # whole cleaning job
    "normality_lineitem",        # DI1
    "assign_nearest",            # SG10
    "kmeans_customers",          # SG2
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
