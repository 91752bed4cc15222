"""DT1-DT8: datetime parsing and calendar features as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Peak hours and weekend days (0 = Monday).
PEAK_HOURS = (7, 8, 9, 17, 18, 19, 20)
WEEKEND_DAYS = (5, 6)

#: Spellings that ``parse_text`` tries row by row, in this order, where the ISO form does not fit and no format is given.
FORMATS = ("yyyy-MM-dd hh:mm:ss a", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy hh:mm:ss a", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm",
           "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "dd/MM/yyyy", "MM/dd/yyyy")

#: Layouts of a date and the patterns that read each; of two, the first counts the month first.
DATE_LAYOUTS = (
    (r"\d{4}-\d{1,2}-\d{1,2}", ("yyyy-M-d",)),
    (r"\d{4}/\d{1,2}/\d{1,2}", ("yyyy/M/d",)),
    (r"\d{4}\.\d{1,2}\.\d{1,2}", ("yyyy.M.d",)),
    (r"\d{1,2}/\d{1,2}/\d{4}", ("M/d/yyyy", "d/M/yyyy")),
    (r"\d{1,2}-\d{1,2}-\d{4}", ("M-d-yyyy", "d-M-yyyy")),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", ("M.d.yyyy", "d.M.yyyy")),
    (r"\d{1,2} [A-Za-z]{3,9} \d{4}", ("d [MMMM][MMM] yyyy",)),
    (r"\d{1,2}-[A-Za-z]{3,9}-\d{4}", ("d-[MMMM][MMM]-yyyy",)),
    (r"[A-Za-z]{3,9} \d{1,2}, \d{4}", ("[MMMM][MMM] d, yyyy",)),
    (r"[A-Za-z]{3,9} \d{1,2} \d{4}", ("[MMMM][MMM] d yyyy",)),
)
#: Layouts of a time of day after a date.
CLOCKS = (
    (r"( \d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?", "[ H:mm[:ss[.SSSSSS]]]"),
    (r" \d{1,2}:\d{2}(:\d{2})? ?[AaPp][Mm]", " h:mm[:ss][ ]a"),
)


def parse_text(text: Column, formats: Sequence[str] = FORMATS) -> Column:
    """Text as timestamp_ntz: ISO, else the first of ``formats`` that fits, else null.  Read as UTC and
    taken apart as UTC, so the session time zone plays no part."""
    origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    others = [F.timestamp_add("MICROSECOND", F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(f + "X"))), origin)
              for f in formats]
    return F.coalesce(text.try_cast("timestamp_ntz"), *others)


def format_profile(df: DataFrame, text: Column) -> DataFrame:
    """``layout, clock, n, first_over, second_over``: how many rows have each layout, and in how many the first
    or second number exceeds 12.  One aggregate of at most 22 rows: ISO text has layout -1, text that fits
    none and null have a null layout.  The explodes keep the text and the ISO test from being computed again for each layout;
    ISO text starts with its year, so no other test applies to it."""
    rows = df.select(F.explode(F.array(text)).alias("text"))
    rows = rows.select("text", F.explode(F.array(F.col("text").try_cast("timestamp_ntz").isNotNull())).alias("iso"))
    text, iso = F.col("text"), F.col("iso")
    layout = F.when(iso, F.struct(F.lit(-1).alias("layout"), F.lit(0).alias("clock")))
    for i, (date, _) in enumerate(DATE_LAYOUTS):
        for j, (clock, _) in enumerate(CLOCKS):
            layout = layout.when(text.rlike(f"^{date}{clock}$"), F.struct(F.lit(i).alias("layout"), F.lit(j).alias("clock")))
    number = lambda regex: F.when(~iso, F.regexp_extract(text, regex, 1).try_cast("int") > 12)
    return rows.groupBy(layout.alias("at")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(number(r"^(\d{1,2})\D")).alias("first_over"),
        F.count_if(number(r"^\d{1,2}\D(\d{1,2})\D")).alias("second_over")).select("at.layout", "at.clock", "n", "first_over", "second_over")


def infer_format(df: DataFrame, text: Column) -> str | None:
    """The one pattern that reads most rows of a column that are not ISO text; None where none reads any.

    All rows count.  A number over 12 rules out its row as a month; where day-first and month-first read as many rows,
    the month comes first."""
    best, most = None, 0
    for r in sorted((r for r in format_profile(df, text).collect() if r["layout"] is not None and r["layout"] >= 0),
                    key=lambda r: (r["layout"], r["clock"])):
        patterns = DATE_LAYOUTS[r["layout"]][1]
        fits = [r["n"]] if len(patterns) == 1 else [r["n"] - r["first_over"], r["n"] - r["second_over"]]
        for pattern, rows in zip(patterns, fits):
            if rows > most:
                best, most = pattern + CLOCKS[r["clock"]][1], rows
    return best


def booking_text(df: DataFrame, date: str = "date", time: str = "time") -> Column | None:
    """The text that holds a booking's time: ``date + ' ' + time``, or ``date`` alone; None without a date column."""
    if date not in df.columns:
        return None
    if time not in df.columns:
        return F.col(date)
    return F.when(F.col(date).isNotNull() & F.col(time).isNotNull(), F.concat(F.col(date), F.lit(" "), F.col(time)))


def parse_datetime(df: DataFrame, date: str = "date", time: str = "time", out: str = "datetime",
                   formats: Sequence[str] | None = None) -> DataFrame:
    """DT1: ``date + ' ' + time`` (or ``date`` alone) as timestamp_ntz; bad or partial -> null.

    ISO text is always read; other text by one format for the whole column, the one that ``infer_format`` finds in
    all its rows (one job), or by the given ``formats`` where they are pinned.  What neither reads is null.
    The source columns are dropped.  Without a date column the result is all null.
    """
    text = booking_text(df, date, time)
    if text is None:
        return df.withColumn(out, F.lit(None).cast("timestamp_ntz"))
    if formats is None:
        found = infer_format(df, text)
        formats = [] if found is None else [found]
    return df.withColumn(out, parse_text(text, formats)).drop(date, time)


def time_of_day(hour: Column) -> Column:
    """DT7: [5,12) morning, [12,17) afternoon, [17,21) evening, else night; null stays null."""
    return (F.when(hour.isNull(), F.lit(None).cast("string"))
            .when((hour >= 5) & (hour < 12), "morning")
            .when((hour >= 12) & (hour < 17), "afternoon")
            .when((hour >= 17) & (hour < 21), "evening")
            .otherwise("night"))


def flag(c: Column) -> Column:
    """Boolean -> 0/1 with null -> 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


def calendar_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """DT2-DT8: year, month, day, hour, dow (0 = Monday), day_name, is_weekend, is_peak, time_of_day.

    Rows without a datetime get nulls and 0 flags; the columns always exist (stable schema).
    """
    t = F.col(ts)
    return df.withColumns({
        "year": F.year(t),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "hour": F.hour(t),
        "dow": F.weekday(t),
        "day_name": F.date_format(t, "EEEE"),
        "is_weekend": flag(F.weekday(t).isin(*WEEKEND_DAYS)),
        "is_peak": flag(F.hour(t).isin(*PEAK_HOURS)),
        "time_of_day": time_of_day(F.hour(t)),
    })
