"""Command line for the end-to-end jobs: ``python -m ridelens <job> ...``.

    python -m ridelens clean RAW_CSV OUT_DIR [--date-format 'd/M/yyyy H:mm:ss']
    python -m ridelens segment-trips CLEAN_DIR OUT_DIR [--k 3]
    python -m ridelens segment-customers CLEAN_DIR OUT_DIR [--k 3]
    python -m ridelens evaluate-k CLEAN_DIR OUT_DIR [--max-k 8] [--completed-only] [--min-value X] [--fast] [--sample 0.1]
    python -m ridelens forecast-global CLEAN_DIR OUT_DIR [--metrics v1|v2] [--models a,b,...]
    python -m ridelens forecast-vehicle CLEAN_DIR OUT_DIR [--horizon 168] [--future-model fourier]
    python -m ridelens profile CLEAN_DIR OUT_DIR
    python -m ridelens distribution CLEAN_DIR OUT_DIR

On a cluster the session comes from ``spark-submit``; locally a ``local[*]`` session is made.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ridelens.plans import jobs


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ridelens")
    p.add_argument("job", choices=["clean", "segment-trips", "segment-customers", "evaluate-k", "forecast-global",
                                   "forecast-vehicle", "profile", "distribution"])
    p.add_argument("src")
    p.add_argument("out")
    p.add_argument("--k", type=int, default=3)
    p.add_argument("--max-k", type=int, default=8)
    p.add_argument("--completed-only", action="store_true")
    p.add_argument("--min-value", type=float, default=None)
    p.add_argument("--fast", action="store_true", help="mini-batch k-means for the choice of k")
    p.add_argument("--sample", type=float, default=None, help="share of the rows for the choice of k; all without it")
    p.add_argument("--horizon", type=int, default=168, help="steps of the future forecast")
    p.add_argument("--future-model", choices=["additive", "fourier", "sparse"], default="additive")
    p.add_argument("--metrics", choices=["v1", "v2"], default=None,
                   help="v2: MAPE over y > 0 + sMAPE (global default); v1: MAPE with the 1e-6 floor")
    p.add_argument("--models", default=None,
                   help="comma list of baseline_last, baseline_weekly, additive, additive_log1p, fourier, fourier_log1p, sparse, sparse_log1p")
    p.add_argument("--date-format", default=None, help="pattern of the booking times besides ISO; found in the data if not given")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession()
    if spark is None:
        from ridelens.session import local_session
        spark = local_session()
    if a.job == "clean":
        jobs.run_clean_job(spark, a.src, a.out, formats=[a.date_format] if a.date_format else None)
    elif a.job == "segment-trips":
        jobs.run_trip_segmentation_job(spark, a.src, a.out, k=a.k, completed_only=a.completed_only,
                                       min_value=a.min_value)
    elif a.job == "segment-customers":
        jobs.run_customer_segmentation_job(spark, a.src, a.out, k=a.k)
    elif a.job == "evaluate-k":
        jobs.run_k_evaluation_job(spark, a.src, a.out, max_k=a.max_k, completed_only=a.completed_only,
                                  min_value=a.min_value, fast=a.fast, sample_fraction=a.sample)
    elif a.job == "profile":
        jobs.run_profile_job(spark, a.src, a.out)
    elif a.job == "distribution":
        jobs.run_distribution_job(spark, a.src, a.out)
    elif a.job == "forecast-global":
        models = tuple(a.models.split(",")) if a.models else ("baseline_last", "baseline_weekly", "additive_log1p",
                                                              "fourier_log1p")
        jobs.run_forecast_job(spark, a.src, a.out, models=models, metrics_version=a.metrics or "v2", horizon=a.horizon,
                              future_model=a.future_model)
    else:
        models = tuple(a.models.split(",")) if a.models else ("baseline_last", "additive", "fourier")
        jobs.run_forecast_job(spark, a.src, a.out, series="vehicle_type", log_target=True, models=models,
                              metrics_version=a.metrics or "v1", horizon=a.horizon, future_model=a.future_model)


if __name__ == "__main__":
    main()
