"""Plan-level checks: the properties the design relies on at scale."""

import contextlib
import io
import os
import tempfile

from ridelens.operators import clean
from ridelens.operators import series as se
from ridelens.plans import jobs
from ridelens.sources.tables import dirty_bookings, table

from .conftest import SF


def _plan(df, mode=None) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode) if mode else df.explain()
    return buf.getvalue()


def test_cleaning_has_no_python(spark):
    df, _ = jobs.clean_bookings(dirty_bookings(spark, SF))
    plan = _plan(df, "formatted")
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan


def test_hourly_demand_scans_raw_table_once(spark):
    df = se.hourly_demand(table(spark, SF, "events"), ts="ts", series="event_type")
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final
    assert final.count("FileScan parquet") == 1


def test_rare_collapse_is_a_projection(spark):
    df = dirty_bookings(spark, SF)
    plan = _plan(clean.collapse_rare(df, {"payment_method": 0.01}), "formatted")
    assert "Join" not in plan and "Exchange" not in plan


def test_dedup_combines_before_shuffle(spark):
    plan = _plan(clean.dedup(table(spark, SF, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"]),
                 "formatted")
    assert "partial_min" in plan and plan.index("partial_min") > plan.index("Exchange") - 10_000


def test_filters_and_columns_reach_the_scan(spark):
    d = tempfile.mkdtemp(prefix="ridelens-plan-")
    df, _ = jobs.clean_bookings(dirty_bookings(spark, SF))
    df.write.mode("overwrite").parquet(os.path.join(d, "c"))
    back = spark.read.parquet(os.path.join(d, "c"))
    q = clean.segmentation_input(back, completed_only=True, min_value=50).select("booking_id")
    plan = _plan(q, "formatted")
    assert "PushedFilters: [IsNotNull(is_completed), IsNotNull(booking_value), EqualTo(is_completed,1)" in plan
    assert "ReadSchema: struct<booking_id:string,booking_value:double,is_completed:int>" in plan


def test_forecast_plan_reads_materialized_split(spark):
    split = jobs.demand_split(table(spark, SF, "events"), ts="ts", series="event_type")
    from ridelens.operators import forecast as fc
    plan = _plan(fc.run_forecasts(split), "formatted")
    assert "events.parquet" not in plan


def test_hot_key_results_and_partial_aggregation(spark):
    """One customer (and one null id) holding a third of the rows: results stay whole and the
    aggregates combine map-side before the shuffle."""
    from pyspark.sql import functions as F

    from ridelens.operators import customers
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("c"), (F.col("id") % 97).cast("string")))
        .alias("customer_id"),
        F.when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("booking_id"),
        (F.col("id") % 2).cast("int").alias("is_completed"), F.lit(0).alias("is_incomplete"),
        F.lit(0).alias("is_cancelled"), F.col("id").cast("double").alias("booking_value"), F.col("id").alias("seq"))
    feats = customers.customer_features(df)
    hot = feats.where("customer_id = 'HOT'").first()
    assert hot.total_trips == n // 3 and hot.completed_trips == n // 6
    assert "partial_count" in _plan(feats, "formatted")
    dd = clean.dedup(df, ["booking_id"], ["seq"])
    assert dd.count() == n - n // 3 + 1  # all null ids collapse to one row, the smallest seq
    assert dd.where("booking_id IS NULL").first().seq == 1
