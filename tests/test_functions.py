import datetime as dt

from pyspark.sql import functions as F

from ridelens.functions import dates, strings


def test_snake_name():
    assert strings.snake_name(" Booking ID ") == "booking_id"
    assert strings.snake_name("Booking-Status") == "bookingstatus"
    assert strings.snake_name("Value (INR)") == "value_inr"
    assert strings.snake_name("a -") == "a_"


def test_null_tokens_keep_case(spark):
    df = spark.createDataFrame([(" NULL ",), ("n/a",), ("NaN",), ("",), (" Keep Me ",), (None,), ("none",)], "s string")
    out = [r.s for r in strings.normalize_nulls(df).collect()]
    assert out == [None, None, None, None, "Keep Me", None, None]


def test_strip_quotes(spark):
    df = spark.createDataFrame([('"a"',), ('""a""',), ("b",)], "booking_id string")
    assert [r.booking_id for r in strings.strip_quotes(df).collect()] == ["a", '"a"', "b"]


def test_slug_and_norm(spark):
    df = spark.createDataFrame([("Go Sedan",), ("Premier-Sedan",), (None,)], "s string")
    out = df.select(strings.slug(F.col("s")).alias("a"), strings.norm_str(F.col("s")).alias("b")).collect()
    assert [r.a for r in out] == ["go_sedan", "premier_sedan", None]
    assert [r.b for r in out] == ["go sedan", "premier-sedan", ""]


def test_parse_datetime_and_calendar(spark):
    df = spark.createDataFrame([("2024-01-06", "08:30:00"), ("bad", "08:30:00"), ("2024-01-07", None)],
                               "date string, time string")
    out = dates.calendar_features(dates.parse_datetime(df)).collect()
    assert out[0].datetime == dt.datetime(2024, 1, 6, 8, 30)
    assert (out[0].dow, out[0].day_name, out[0].is_weekend, out[0].is_peak, out[0].time_of_day) == \
        (5, "Saturday", 1, 1, "morning")
    for r in out[1:]:
        assert r.datetime is None and r.is_weekend == 0 and r.is_peak == 0 and r.time_of_day is None
        assert r.year is None


def test_time_of_day_bounds(spark):
    df = spark.createDataFrame([(h,) for h in (4, 5, 11, 12, 16, 17, 20, 21, None)], "h int")
    got = [r.t for r in df.select(dates.time_of_day(F.col("h")).alias("t")).collect()]
    assert got == ["night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "night", None]
