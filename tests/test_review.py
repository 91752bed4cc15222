"""Cases of the review: raw values after encoding, columns without values, file order, date spellings, KPI formulas."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ridelens.functions import dates
from ridelens.operators import customers, distribution, encode, kpi, segment
from ridelens.plans import jobs
from ridelens.sources import files
from ridelens.sources.tables import dirty_bookings

from .conftest import SF


def test_encoder_leaves_inputs_alone(spark):
    rows = [("a", 1.0, "x", None, 1), ("b", None, None, None, 2), ("c", 5.0, "y", None, 2)]
    df = spark.createDataFrame(rows, "booking_id string, booking_value double, kind string, day_name string, n int")
    enc = encode.fit_encoder(df)
    assert enc.feature_names() == ["booking_value", "kind_x", "kind_y", "n"]  # no column without values
    out = enc.transform(df).orderBy("booking_id")
    assert out.columns == [*df.columns, "features"]
    assert [tuple(r) for r in out.drop("features").collect()] == rows
    assert [list(r.features.toArray()) for r in out.collect()] == [[-1.0, 1.0, 0.0, 1.0], [0.0, 1.0, 0.0, 2.0], [1.0, 0.0, 1.0, 2.0]]


def test_clean_and_encode_without_dates(spark):
    raw = dirty_bookings(spark, SF).drop("date", "time")
    df, _ = jobs.clean_bookings(raw)
    enc = encode.fit_encoder(df)
    assert not [n for n in enc.feature_names() if n.startswith(("day_name", "time_of_day", "hour"))]
    assert enc.transform(df).count() == df.count()


def test_clean_job_keeps_first_row_of_the_files(spark):
    d = tempfile.mkdtemp(prefix="ridelens-order-")
    os.makedirs(f"{d}/raw")
    for name, lines in (("a.csv", ["1,Z,2024-01-02,10:00:00,Completed", "2,Y,2024-01-02,10:00:00,Completed"]),
                        ("b.csv", ["1,A,2024-01-01,10:00:00,Incomplete", "3,B,23/03/2024,12:29:38,Completed", "3,A,2024-01-01,10:00:00,x"])):
        with open(f"{d}/raw/{name}", "w") as f:
            f.write("\n".join(["Booking ID,Customer ID,Date,Time,Booking Status", *lines]) + "\n")
    raw = files.read_raw(spark, f"{d}/raw", position=jobs.FILE_ORDER)
    out = {r.booking_id: (r.customer_id, r.datetime) for r in jobs.prepare_bookings(raw, jobs.FILE_ORDER).collect()}
    assert out == {"1": ("Z", dt.datetime(2024, 1, 2, 10)), "2": ("Y", dt.datetime(2024, 1, 2, 10)),
                   "3": ("B", dt.datetime(2024, 3, 23, 12, 29, 38))}


def test_date_spellings(spark):
    text = ["2024-03-23 12:29:38", "23/03/2024 12:29:38", "2024-03-23 12:29:38 PM", "03/23/2024 01:02:03", "2024-03-23", "bad", None]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 2024-03-10 02:30 does not exist there
    try:
        got = spark.createDataFrame([(i, t) for i, t in enumerate([*text, "10/03/2024 02:30:00"])], "i int, t string").select(
            "i", dates.parse_text(F.col("t")).cast("string").alias("t")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r.t for r in got] == ["2024-03-23 12:29:38"] * 3 + ["2024-03-23 01:02:03", "2024-03-23 00:00:00", None, None,
                                                              "2024-03-10 02:30:00"]


def test_kpi_formulas(spark):
    cust = spark.createDataFrame([("a", 9, 9, 10.0), ("b", 1, 0, 110.0), ("c", 5, 1, None)],
                                 "customer_id string, total_trips long, completed_trips long, avg_booking_value double")
    row = kpi.overall_kpis(cust).first()
    assert (row.total_trips, row.mean_value) == (15.0, 20.0) and row.completion_rate == pytest.approx(10 / 15)
    summary = spark.createDataFrame([(0, 1.02, 1.0, 0.0, 0.0, 1.0, 10.0), (1, 1.01, 0.01, 0.5, 0.5, 0.0, 30.0)],
                                    "customer_segment int, total_trips double, completed_trips double, cancelled_trips double, "
                                    "incomplete_trips double, completion_rate double, avg_booking_value double")
    assert [r.completion_pct for r in kpi.segment_status(summary).orderBy("customer_segment").collect()] == [98.04, 0.99]
    row = kpi.overall_kpis(None, summary, weighted=False).first()
    assert row.completion_rate == pytest.approx(1.01 / 2.03) and row.mean_value == 20.0


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    assert [(r.bin, r.n) for r in distribution.histogram(df, "v", 10).orderBy("bin").collect()] == [
        (1, 1), *[(i, 0) for i in range(2, 10)], (10, 1)]


def test_wide_crosstab_keeps_unlisted_categories(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c")], "seg int, v string")
    wide = customers.crosstab_wide(customers.crosstab_pct(df, "seg", "v"), "seg", ["c", "d"])
    assert wide.columns == ["seg", "c", "d", "a", "b"] and wide.first().asDict() == {
        "seg": 0, "a": 33.33, "b": 33.33, "c": 33.33, "d": 0.0}


def test_profile_text_starts_with_the_size(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 2.0), (1, 3.0)], "seg int, v double")
    d = tempfile.mkdtemp(prefix="ridelens-profile-")
    files.write_profile(customers.profile_lines(customers.segment_profile(df, "seg", ["v"]), "seg"), d, ("seg", "line_no"))
    assert [r.value for r in spark.read.text(d).collect()] == ["Segment 0 size : 2", "  avg_v : 2.0", "Segment 1 size : 1", "  avg_v : 3.0"]


def test_trips_without_customer_do_not_meet(spark):
    trips = spark.range(1000).select(F.col("id").alias("booking_id"), F.when(F.col("id") % 2 == 0, F.lit("c")).alias("customer_id"))
    cust = spark.createDataFrame([("c", 1), (None, 9)], "customer_id string, customer_segment int")
    out = customers.trips_with_segment(trips, cust)
    assert out.columns == ["customer_id", "booking_id", "customer_segment"]
    assert {(r.customer_id, r.customer_segment): r["count"] for r in out.groupBy("customer_id", "customer_segment").count().collect()} \
        == {("c", 1): 500, (None, None): 500}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = customers.trips_with_segment(trips, cust).where("customer_id is null").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1


def test_customer_vector_is_standardised(spark):
    rows = [(f"c{i % 20}", f"b{i}", float(i), int(i % 3 == 0)) for i in range(60)]
    trips = spark.createDataFrame(rows, "customer_id string, booking_id string, booking_value double, is_completed int")
    out, _, present = segment.segment_customers(trips, k=2, n_init=2)
    at = present.index("avg_booking_value")
    values = [r.features[at] for r in out.collect()]
    assert sum(values) == pytest.approx(0, abs=1e-9) and sum(v * v for v in values) / len(values) == pytest.approx(1)


def test_silhouette_equals_all_pairs_on_a_small_table(spark):
    import numpy as np
    from ridelens.operators import segment
    rng = np.random.default_rng(3)
    x, lab = rng.normal(size=(30, 3)), np.arange(30) % 3
    df = spark.createDataFrame([(row.tolist(), int(k)) for row, k in zip(x, lab)] + [(None, 1), ([0.0] * 3, None)], "v array<double>, k int")
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    scores = []
    for i in range(30):
        own = d[i][(lab == lab[i]) & (np.arange(30) != i)].mean()
        other = min(d[i][lab == k].mean() for k in set(lab.tolist()) - {lab[i]})
        scores.append((other - own) / max(own, other))
    assert abs(segment.silhouette(df, "v", "k").first()[0] - np.mean(scores)) < 1e-9
    assert segment.silhouette(df.where("k = 1"), "v", "k").first()[0] is None


def test_all_models_carry_bounds_and_status_and_a_failed_series_leaves_the_others(spark):
    from ridelens.operators import forecast as fc
    from ridelens.operators import series as se
    rows = [("a", f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", float(5 + h % 24)) for h in range(240)]
    rows += [("one", "2024-01-01 00:00:00", 3.0), ("one", "2024-01-01 01:00:00", 4.0)]
    hourly = spark.createDataFrame(rows, "series string, ds string, y double").withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    split = se.time_split(hourly, ratio=0.5)
    out = fc.run_forecasts(split, ["baseline_last", "additive"], bounds=True).collect()
    by = {}
    for r in out:
        by.setdefault((r.series, r.model), set()).add(r.status)
    assert by[("a", "additive")] == {"ok"} and by[("a", "baseline_last")] == {"ok"}
    assert by[("one", "additive")] == {"failed"}
    assert all(r.y_lower <= r.y_pred <= r.y_upper for r in out if (r.series, r.model) == ("a", "additive"))
    assert all(r.y_lower is None for r in out if r.model == "baseline_last")


def test_future_by_the_fourier_model_continues_the_daily_shape(spark):
    from ridelens.operators import forecast as fc
    from ridelens.operators import series as se
    rows = [("a", f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", 20.0 + (10 if 8 <= h % 24 < 20 else 0)) for h in range(24 * 21)]
    hourly = spark.createDataFrame(rows, "series string, ds string, y double").withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    fut = fc.forecast_future(se.time_split(hourly), horizon=24, model="fourier").orderBy("ds").collect()
    assert len(fut) == 24 and all(0 <= r.yhat_lower <= r.yhat <= r.yhat_upper for r in fut)
    assert fut[14].yhat > fut[2].yhat + 5
