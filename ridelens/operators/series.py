"""Demand series: zero-filled counts per hour (or day) and category, split into train/test.

Scale notes
-----------
* The raw rows are touched once: ``groupBy(series, bucket).count()`` with map-side partial
  aggregation, so a category holding a third of all rows is combined per map task before the
  shuffle.  Everything after that is series x hours (a year of hours is 8,760 rows per series).
* The grid is filled in one pass over the counts: ``lead(ds)`` per series, gaps cut into chunks that are
  dealt out before they become points (no join back, one raw scan).
* Positions come from arithmetic on the regular grid, never from an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = "series"
GLOBAL_SERIES = "all"

_UNIT = {"hour": "HOUR", "day": "DAY"}


def bucket(ts: Column, freq: str = "hour") -> Column:
    """Truncate a timestamp_ntz to the hour/day, independent of the session time zone."""
    if freq == "hour":
        return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))
    if freq == "day":
        return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.lit(0), F.lit(0), F.lit(0))
    raise ValueError(f"freq must be 'hour' or 'day', not {freq!r}")


def steps_between(start: str, end: str, freq: str = "hour") -> Column:
    """Whole steps from column ``start`` to column ``end`` (both timestamp_ntz)."""
    return F.expr(f"timestampdiff({_UNIT[freq]}, {start}, {end})")


def add_steps(start: str, steps: str, freq: str = "hour") -> Column:
    return F.expr(f"timestampadd({_UNIT[freq]}, {steps}, {start})")


def _series_key(series: str | None) -> Column:
    if series is None:
        return F.lit(GLOBAL_SERIES).alias(SERIES)
    return F.col(series).cast("string").alias(SERIES)


def demand_counts(df: DataFrame, ts: str = "datetime", series: str | None = None, freq: str = "hour") -> DataFrame:
    """Non-empty buckets only: (series, ds, y).  Null times and null categories drop out."""
    rows = df.where(F.col(ts).isNotNull())
    if series is not None:
        rows = rows.where(F.col(series).isNotNull())  # FL7: no filter loop, one grouped pass
    return rows.groupBy(_series_key(series), bucket(F.col(ts), freq).alias("ds")).agg(F.count(F.lit(1)).alias("y"))


def hourly_demand(df: DataFrame, ts: str = "datetime", series: str | None = None, freq: str = "hour") -> DataFrame:
    """AG6/AG7: count per bucket and series, empty buckets 0, each series over its own min..max."""
    return zero_fill(demand_counts(df, ts, series, freq), freq)


#: Least number of points of a chunk of a gap.
CHUNK = 1000


def zero_fill(counts: DataFrame, freq: str = "hour") -> DataFrame:
    """Complete ``series, ds, y`` counts to a regular grid per series (missing buckets -> 0).

    One pass over the (small) counts: ``lead(ds)`` per series finds the next non-empty bucket.  A bucket
    and the empty steps after it are cut into chunks of about the square root of their number (at least
    ``CHUNK``); the chunks are dealt out and each becomes its points in the task it falls to.  So a stray
    timestamp thousands of years off is spread over the tasks, and no array exceeds 10,000 elements.  There is no
    join back to the counts, so the raw table under them is scanned once; the window holds one series'
    non-empty buckets (bounded by its time span, not by the raw rows)."""
    size = F.coalesce(steps_between("ds", "_next", freq), F.lit(1))
    cut = counts.withColumn("_next", F.lead("ds").over(Window.partitionBy(SERIES).orderBy("ds"))).select(
        SERIES, "ds", "y", size.alias("_size"), F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(size))).cast("long").alias("_chunk"))
    chunks = cut.select("*", F.explode(F.expr("sequence(0L, (_size - 1) div _chunk)")).alias("_c")).repartition(SERIES, "ds", "_c")
    points = chunks.select(SERIES, "ds", "y", F.explode(F.expr(
        "sequence(_c * _chunk, least((_c + 1) * _chunk, _size) - 1)")).alias("_i"))
    return points.select(SERIES, add_steps("ds", "_i", freq).alias("ds"),
                         F.when(F.col("_i") == 0, F.col("y")).otherwise(F.lit(0)).cast("long").alias("y"))


def log_demand(series_df: DataFrame, col: str = "y") -> DataFrame:
    """AG8: target on log scale; invert with ``expm1``."""
    return series_df.withColumn(col, F.log1p(F.col(col).cast("double")))


def drop_null_target(series_df: DataFrame, col: str = "y") -> DataFrame:
    """FL9."""
    return series_df.na.drop(subset=[col])


def series_keys(df: DataFrame, col: str) -> DataFrame:
    """FL7: sorted distinct non-null categories (one grouped pass; ordering only on output)."""
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias(SERIES)).distinct().orderBy(SERIES)


def usable_series(series_df: DataFrame, min_points: int = 50, col: str = "y") -> DataFrame:
    """FL8: keep series that have at least ``min_points`` points and a non-zero sum.
    Per-series window (one pass; a series is its time grid, bounded by its span)."""
    w = Window.partitionBy(SERIES)
    return (series_df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_t", F.sum(col).over(w))
            .where((F.col("_n") >= min_points) & (F.col("_t") != 0)).drop("_n", "_t"))


def time_split(series_df: DataFrame, ratio: float = 0.2, freq: str = "hour") -> DataFrame:
    """FC1: the last ``int(n * ratio)`` points of each series are test.

    Adds ``t0`` (first point), ``pos`` (steps since ``t0``), ``n``, ``n_train`` and ``is_train``.
    The grid is regular, so the position is arithmetic; per-series window aggregates (no join
    back to the input, which would re-read the raw table under it), no global sort.
    """
    w = Window.partitionBy(SERIES)
    return (
        series_df.withColumn("t0", F.min("ds").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
        .withColumn("n_train", F.col("n") - F.floor(F.col("n").cast("double") * F.lit(float(ratio))).cast("long"))
        .withColumn("pos", steps_between("t0", "ds", freq).cast("long"))
        .withColumn("is_train", F.col("pos") < F.col("n_train"))
    )
