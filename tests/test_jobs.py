import os
import tempfile

from pyspark.sql import functions as F

from ridelens.plans import jobs
from ridelens.sources.tables import dirty_bookings

from .conftest import SF


def test_jobs_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="ridelens-jobs-")
    raw = os.path.join(d, "raw")
    dirty_bookings(spark, SF).drop("seq").write.option("header", True).csv(raw)
    art = jobs.run_clean_job(spark, raw, os.path.join(d, "clean"))
    assert art.cast_profile["booking_value"] >= 0.4
    cleaned = spark.read.parquet(os.path.join(d, "clean", "cleaned"))
    assert cleaned.count() == cleaned.select("booking_id").distinct().count()
    jobs.run_trip_segmentation_job(spark, os.path.join(d, "clean"), os.path.join(d, "trips"), k=3)
    seg = spark.read.parquet(os.path.join(d, "trips", "segmented_trips"))
    assert seg.count() == cleaned.count()
    assert {r.trip_segment for r in seg.select("trip_segment").distinct().collect()} <= {0, 1, 2}
    jobs.run_customer_segmentation_job(spark, os.path.join(d, "clean"), os.path.join(d, "cust"), k=3)
    tws = spark.read.parquet(os.path.join(d, "cust", "trips_with_customer_segment"))
    assert tws.count() == cleaned.count() and tws.where(F.col("customer_id").isNull() &
                                                         F.col("customer_segment").isNotNull()).count() == 0
    jobs.run_k_evaluation_job(spark, os.path.join(d, "clean"), os.path.join(d, "k"), max_k=4)
    ev = spark.read.option("header", True).csv(os.path.join(d, "k", "k_evaluation"))
    assert sorted(int(r.k) for r in ev.collect()) == [2, 3, 4]
    jobs.run_forecast_job(spark, os.path.join(d, "clean"), os.path.join(d, "fc"))
    m = spark.read.option("header", True).csv(os.path.join(d, "fc", "metrics"))
    assert {r.model for r in m.collect()} == {"baseline_last", "baseline_weekly", "additive_log1p", "fourier_log1p"}
    jobs.run_profile_job(spark, os.path.join(d, "clean"), os.path.join(d, "prof"))
    assert {r.column_name for r in spark.read.option("header", True).csv(os.path.join(d, "prof", "profile")).collect()} == {"duration", "distance"}
    jobs.run_distribution_job(spark, os.path.join(d, "clean"), os.path.join(d, "dist"))
    normal = spark.read.option("header", True).csv(os.path.join(d, "dist", "normality"))
    for r in normal.collect():
        assert os.path.isdir(os.path.join(d, "dist", f"histogram_{r.feature}")) and os.path.isdir(os.path.join(d, "dist", f"density_{r.feature}"))
