"""DT1: one format per column, found in all its rows; IO2: types of text columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridelens.functions import dates
from ridelens.plans import jobs
from ridelens.sources import files


def read(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, date string")
    return [r.datetime for r in dates.parse_datetime(df, **kw).orderBy("i").collect()]


D = dt.datetime


def test_month_first_and_day_first_columns(spark):
    assert read(spark, ["03/05/2024", "03/14/2024", "bad", None]) == [D(2024, 3, 5), D(2024, 3, 14), None, None]
    assert read(spark, ["03/05/2024", "14/03/2024"]) == [D(2024, 5, 3), D(2024, 3, 14)]
    assert read(spark, ["03/05/2024", "04/05/2024"]) == [D(2024, 3, 5), D(2024, 4, 5)]  # no evidence: month first
    # both orders occur: the one that reads more rows stands, the others are null
    assert read(spark, ["13/01/2024", "01/02/2024", "14/02/2024", "02/28/2024"]) == [D(2024, 1, 13), D(2024, 2, 1), D(2024, 2, 14), None]
    assert read(spark, ["03/05/2024", "04/25/2024"], formats=["d/M/yyyy"]) == [D(2024, 5, 3), None]


@pytest.mark.parametrize("texts, want", [
    (["2024/03/05", "2024/3/15"], [D(2024, 3, 5), D(2024, 3, 15)]),
    (["05 Mar 2024", "15 may 2024 10:20"], [D(2024, 3, 5), D(2024, 5, 15, 10, 20)]),
    (["5 March 2024", "15 May 2024"], [D(2024, 3, 5), D(2024, 5, 15)]),
    (["March 5, 2024", "Apr 7, 2024 1:02:03"], [D(2024, 3, 5), D(2024, 4, 7, 1, 2, 3)]),
    (["5.3.2024 07:08:09.25", "31.12.2024"], [D(2024, 3, 5, 7, 8, 9, 250000), D(2024, 12, 31)]),
    (["3/5/2024 1:02 PM", "3/15/2024 12:00:01 am"], [D(2024, 3, 5, 13, 2), D(2024, 3, 15, 0, 0, 1)]),
    (["2024-03-05 01:02:03 PM", "2024-03-06 04:05:06"], [D(2024, 3, 5, 13, 2, 3), D(2024, 3, 6, 4, 5, 6)]),
    (["2024-03-05T10:00:00", "2024-03-05"], [D(2024, 3, 5, 10), D(2024, 3, 5)]),
    (["31/02/2024", "30/04/2024"], [None, D(2024, 4, 30)]),
])
def test_spellings(spark, texts, want):
    assert read(spark, texts) == want


def test_profile_has_a_bounded_number_of_rows(spark):
    df = spark.range(5000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("t"))
    assert dates.format_profile(df, F.col("t")).count() == 1
    assert dates.infer_format(df, F.col("t")) is None
    assert dates.infer_format(df.limit(0), F.col("t")) is None


def test_clean_job_returns_and_pins_the_format(spark):
    raw = spark.createDataFrame([(i, f'"b{i}"', f'0{i % 9 + 1}/{14 + i % 10}/2024', "10:00:00", "Completed") for i in range(30)],
                                "seq int, `Booking ID` string, Date string, Time string, `Booking Status` string")
    cleaned, art = jobs.clean_bookings(raw)
    assert art.date_formats == ["M/d/yyyy[ H:mm[:ss[.SSSSSS]]]"]
    assert cleaned.where("datetime is null").count() == 0 and {r.day for r in cleaned.collect()} == set(range(14, 24))
    pinned, art = jobs.clean_bookings(raw, formats=["d/M/yyyy H:mm:ss"])
    assert art.date_formats == ["d/M/yyyy H:mm:ss"] and pinned.where("datetime is not null").count() == 0


def test_column_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d,e,f.g\n1,1.5,true,2024-03-05 10:00:00,x,\n2,,False,2024-03-05,1,\n-3,1e3,true,,,\n")
    df = files.read_clean(spark, str(tmp_path), fmt="csv")
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "timestamp_ntz", "string", "string"]
    assert df.orderBy("a").first().a == -3
    pinned = files.read_clean(spark, str(tmp_path), fmt="csv", types={"a": "string", "e": "int"})
    assert dict(pinned.dtypes)["a"] == "string" and [r.e for r in pinned.orderBy("a").collect()] == [None, None, 1]


def test_format_profile_makes_the_text_once(spark):
    """The text is an expression of some size; its layouts and numbers are tested on the finished text."""
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("13/02/2024 10:00",), (None,), ("x",)], "t string")
    text = F.regexp_replace(F.col("t"), "never there", "")
    got = {(r.layout, r.clock): (r.n, r.first_over, r.second_over) for r in dates.format_profile(df, text).collect()}
    assert got == {(-1, 0): (1, 0, 0), (3, 0): (1, 1, 0), (None, None): (2, 0, 0)}
    plan = dates.format_profile(df, text)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("never there") == 1
