import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.operators import distribution, encode, kpi
from ridelens.operators import series as se


def test_group_columns(spark):
    df = spark.createDataFrame([("b1", "c1", 1.0, 2.0, 3, "x")],
                               "booking_id string, customer_id string, booking_value double, other double, "
                               "is_peak int, vehicle_type string")
    g = encode.group_columns(df)
    assert g == {"scaled": ["booking_value"], "passthrough": ["other", "is_peak"], "categorical": ["vehicle_type"]}


def test_drop_null_target_and_log(spark):
    df = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), 3), ("s", dt.datetime(2024, 1, 1, 1), None)],
                               "series string, ds timestamp_ntz, y long")
    assert se.drop_null_target(df).count() == 1
    assert se.log_demand(df).first().y == pytest.approx(math.log1p(3))


def test_duration_distance_profile(spark):
    df = spark.createDataFrame([(None, 5.0, 2.0), (3.0, None, None)], "avg_vtat double, avg_ctat double, ride_distance double")
    out = encode.add_distance(encode.add_duration(df)).collect()
    assert [r.duration for r in out] == [0.0, 3.0] and [r.distance for r in out] == [2.0, 0.0]
    only_ctat = encode.add_duration(df.drop("avg_vtat")).collect()
    assert [r.duration for r in only_ctat] == [5.0, 0.0]
    p = encode.profile(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double"), "x").first()
    assert (p["min"], p["max"], p["mean"], p["median"], p["missing"]) == (1.0, 10.0, 4.0, 2.5, 1)


def test_normality_histogram_kde(spark):
    rng = np.random.default_rng(7)
    normal = rng.normal(size=4000)
    skewed = rng.exponential(size=4000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(normal, skewed)], "n double, e double")
    res = {r.feature: r for r in distribution.normality(df, ["n", "e"]).collect()}
    assert res["n"].is_normal and not res["e"].is_normal
    h = distribution.histogram(df, "e", 10).collect()
    assert sum(r.n for r in h) == 4000 and max(r.bin for r in h) == 10
    k = distribution.kde(df, "n", 50).collect()
    xs = [r.x for r in k]
    area = sum(r.density for r in k) * (xs[1] - xs[0])
    assert area == pytest.approx(1.0, abs=0.05)


def test_kpis_small(spark):
    cust = spark.createDataFrame(
        [("a", 0, 2, 2, 0, 0, 10.0, 1.0), ("b", 0, 1, 0, 1, 0, 20.0, None), ("c", 1, 4, 3, 0, 1, 30.0, 3.0)],
        "customer_id string, customer_segment int, total_trips long, completed_trips long, cancelled_trips long, "
        "incomplete_trips long, avg_booking_value double, avg_ride_distance double")
    ov = kpi.segment_overview(cust).first()
    assert (ov.n_rows, ov.n_segments, ov.mean_distance, ov.mean_value) == (3, 2, 2.0, 20.0)
    share = {r.customer_segment: r.share_pct for r in kpi.segment_share(cust).collect()}
    assert share == {0: 66.67, 1: 33.33}
    tot = kpi.overall_kpis(cust).first()
    assert tot.total_trips == 7.0 and tot.completion_rate == pytest.approx(5 / 7)
    renamed = kpi.rename_existing(cust, {"total_trips": "Total Trips", "nope": "x"})
    assert "Total Trips" in renamed.columns and "nope" not in renamed.columns
    top = kpi.preview(cust, ["customer_id", "total_trips", "absent"], 2, [F.desc("total_trips")]).collect()
    assert [r.customer_id for r in top] == ["c", "a"] and len(top[0]) == 2


def test_metric_kpis(spark):
    m = spark.createDataFrame([("x", "base", 2.0, 10.0, 1.0), ("x", "m", 1.0, 5.0, 1.0), ("y", "base", 1.0, 4.0, 1.0),
                               ("y", "m", 2.0, 8.0, 1.0)], "series string, model string, mae double, mape double, rmse double")
    imp = {r.series: (r.improvement_pct, r.verdict) for r in kpi.improvement(m, "base", "m").collect()}
    assert imp == {"x": (50.0, "better"), "y": (-100.0, "worse")}
    ov = kpi.metric_overview(m, "m").first()
    assert (ov.mean_mae, ov.mean_mape, ov.n_series) == (1.5, 6.5, 2)
    assert [r.series for r in kpi.rank_series(m, "m").collect()] == ["X", "Y"]


def test_daily_series_and_tail(spark):
    days = [dt.datetime(2024, 1, d, 13) for d in (1, 1, 4)]
    df = spark.createDataFrame([(x, "a") for x in days], "datetime timestamp_ntz, k string")
    s = se.hourly_demand(df, series="k", freq="day").orderBy("ds").collect()
    assert [r.y for r in s] == [2, 0, 0, 1]
    t = kpi.tail(se.hourly_demand(df, series="k", freq="day"), 2, freq="day").orderBy("ds").collect()
    assert [r.ds.day for r in t] == [3, 4]
