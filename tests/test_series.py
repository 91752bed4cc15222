import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ridelens.operators import forecast as fc
from ridelens.operators import metrics as me
from ridelens.operators import series as se


def _hours(spark, start, ys, series="s"):
    rows = [(series, start + dt.timedelta(hours=i), y) for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "series string, ds timestamp_ntz, y long")


def test_hourly_grid_zero_fill(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(day.replace(minute=30),), (day.replace(hour=3, minute=10),), (None,)],
                               "datetime timestamp_ntz")
    out = se.hourly_demand(df).orderBy("ds").collect()
    assert [r.y for r in out] == [1, 0, 0, 1] and out[0].series == "all"


def test_usable_series_and_split(spark):
    a = _hours(spark, dt.datetime(2024, 1, 1), [1] * 49, "short")
    b = _hours(spark, dt.datetime(2024, 1, 1), [1] * 50, "long")
    z = _hours(spark, dt.datetime(2024, 1, 1), [0] * 60, "zero")
    kept = se.usable_series(a.unionByName(b).unionByName(z), 50)
    assert {r.series for r in kept.select("series").distinct().collect()} == {"long"}
    split = se.time_split(a)
    assert split.where(~F.col("is_train")).count() == 9  # int(49 * 0.2)


def test_weekly_falls_back_when_train_is_short(spark):
    ys = [i % 7 for i in range(120)]  # 5 days: 96 train, 24 test
    split = se.time_split(_hours(spark, dt.datetime(2024, 1, 1), ys))
    last = fc.forecast_last(split).select("y_pred").distinct().collect()
    weekly = fc.forecast_weekly(split).select("y_pred").distinct().collect()
    assert last == weekly and len(last) == 1


def test_mape_conventions(spark):
    df = spark.createDataFrame([("s", "m", 0.0, 1.0), ("s", "m", 2.0, 1.0), ("s", "m", 0.0, 0.0)],
                               "series string, model string, y double, y_pred double")
    v2 = me.forecast_metrics(df).first()
    v1 = me.forecast_metrics(df, version="v1").first()
    assert v2.mape == pytest.approx(50.0)
    assert v2.smape == pytest.approx((2.0 + 2 / 3) / 3 * 100)
    assert v1.mape == pytest.approx((1e6 + 0.5 + 0.0) / 3 * 100)


def _seasonal(spark, days=60):
    ys = []
    for t in range(days * 24):
        h, d = t % 24, (t // 24) % 7
        ys.append(round(20 + 0.01 * t + 8 * math.sin(2 * math.pi * h / 24) + (5 if d >= 5 else 0) + 10))
    return _hours(spark, dt.datetime(2024, 1, 1), ys)


def test_additive_beats_naive_on_seasonal_series(spark):
    split = se.time_split(_seasonal(spark))
    m = {r.model: r.mae for r in me.forecast_metrics(fc.run_forecasts(
        split, ["baseline_last", "baseline_weekly", "additive", "additive_log1p"])).collect()}
    assert m["additive"] < m["baseline_weekly"] and m["additive"] < m["baseline_last"]
    assert m["additive_log1p"] < m["baseline_last"]


def test_bounds_and_future(spark):
    split = se.time_split(_seasonal(spark))
    add = fc.forecast_additive(split, log=True).collect()
    assert all(r.y_lower <= r.y_pred <= r.y_upper for r in add)
    fut = fc.forecast_future(split, horizon=168).orderBy("ds").collect()
    assert len(fut) == 168 and fut[0].ds == dt.datetime(2024, 1, 1) + dt.timedelta(hours=60 * 24)
    assert all(r.yhat >= 0 for r in fut)


def test_recursive_weekly_repeats_last_week(spark):
    split = se.time_split(_seasonal(spark, 30))
    out = fc.forecast_weekly(split, recursive=True).orderBy("ds").collect()
    train = {r.pos: r.y for r in split.where("is_train").collect()}
    n_train = len(train)
    assert len(out) == 144 and out[100].y_pred == train[n_train - 168 + (100 % 168)]


def test_fourier_beats_naive_and_status(spark):
    from ridelens.operators import fourier
    split = se.time_split(_seasonal(spark))
    out = fourier.forecast_fourier(split, log=False)
    assert {r.status for r in out.select("status").distinct().collect()} == {"ok"}
    m = {r.model: r.mae for r in me.forecast_metrics(
        fc.run_forecasts(split, ["baseline_last", "baseline_weekly", "fourier"])).collect()}
    assert m["fourier"] < m["baseline_weekly"] < m["baseline_last"]
    lo_hi = out.where("y_lower > y_pred OR y_upper < y_pred").count()
    assert lo_hi == 0
