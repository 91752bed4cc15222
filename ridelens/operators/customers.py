"""Customer features (AG1, AG2), trips joined with segments (JN1), segment summaries (AG3-AG5).

All of these are one ``groupBy`` each: partial aggregation runs map-side, so one customer or
segment holding a third of all rows is combined per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.operators import skew
from ridelens.operators.clean import is_numeric, parse_number

# Fixed values: (output column, source column) of the customer feature table.
MEAN_FEATURES = (
    ("avg_booking_value", "booking_value"),
    ("avg_ride_distance", "ride_distance"),
    ("avg_driver_rating", "driver_ratings"),
    ("avg_customer_rating", "customer_rating"),
    ("avg_vtat", "avg_vtat"),
    ("avg_ctat", "avg_ctat"),
)
CUSTOMER_FEATURES = (
    "total_trips", "completed_trips", "incomplete_trips", "cancelled_trips",
    "avg_booking_value", "avg_ride_distance", "avg_driver_rating", "avg_customer_rating",
    "avg_vtat", "avg_ctat", "weekend_ratio", "peak_ratio", "completion_rate", "cancel_rate",
)


def round_half_even(c: Column, digits: int = 2) -> Column:
    """numpy-style rounding: scale in floating point, round half to even, scale back
    (0.125 -> 0.12, 2.675 -> 2.68)."""
    scale = float(10 ** digits)
    return F.bround(c * F.lit(scale), 0) / F.lit(scale)


def _number(df: DataFrame, c: str) -> Column:
    if c not in df.columns:
        return F.lit(None).cast("double")
    return F.col(c).cast("double") if is_numeric(df, c) else parse_number(F.col(c))


def customer_features(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """AG1 + AG2: one row per non-null customer.  Missing source columns give null means;
    rates use ``try_divide`` (a customer without counted trips gets null, not an error)."""
    flags = {"completed_trips": "is_completed", "incomplete_trips": "is_incomplete", "cancelled_trips": "is_cancelled"}
    aggs = [F.count(F.col("booking_id")).alias("total_trips")]
    for out, src in flags.items():
        v = F.col(src) if src in df.columns else F.lit(0)
        aggs.append(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(out))
    aggs += [F.avg(_number(df, src)).alias(out) for out, src in MEAN_FEATURES]
    aggs += [F.avg(_number(df, "is_weekend")).alias("weekend_ratio"), F.avg(_number(df, "is_peak")).alias("peak_ratio")]
    feats = df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    return feats.withColumns({
        "completion_rate": F.try_divide(F.col("completed_trips").cast("double"), F.col("total_trips")),
        "cancel_rate": F.try_divide(F.col("cancelled_trips").cast("double"), F.col("total_trips")),
    })


def trips_with_segment(trips: DataFrame, customers: DataFrame, key: str = "customer_id",
                       segment: str = "customer_segment") -> DataFrame:
    """JN1: left equi-join; trips without a customer keep a null segment and are not shuffled.  Customers with very many trips
    are found by one scan of the key and joined with a salt (``skew``); AQE picks broadcast or sort-merge for the
    others from runtime sizes (the customer side grows with the data, so no fixed hint)."""
    ids = customers.select(F.col(key).cast(trips.schema[key].dataType).cast("string").alias("_customer"), segment)
    found = skew.left_join(trips, ids, F.col(key), "_customer")
    return found.select(key, *[c for c in trips.columns if c != key], segment)


def segment_summary(df: DataFrame, segment: str, cols: Sequence[str], prefix: str = "", digits: int = 2) -> DataFrame:
    """AG3: mean of each numeric column per segment, rounded half-even to ``digits``."""
    present = [c for c in cols if c in df.columns]
    return df.groupBy(segment).agg(*[round_half_even(F.avg(_number(df, c)), digits).alias(f"{prefix}{c}")
                                     for c in present])


def segment_sizes(df: DataFrame, segment: str) -> DataFrame:
    """AG4."""
    return df.groupBy(segment).agg(F.count(F.lit(1)).alias("n")).orderBy(segment)


def crosstab_pct(df: DataFrame, segment: str, col: str, digits: int = 2) -> DataFrame:
    """AG5 in long form: ``segment, value, pct`` = row percent, nulls left out of both parts.

    Long form keeps the width independent of the number of categories; ``crosstab_wide``
    pivots it for display with an explicit value list (no extra job, absent cells 0).
    """
    rows = df.where(F.col(segment).isNotNull() & F.col(col).isNotNull())
    cells = rows.groupBy(segment, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    row_total = F.sum("cnt").over(Window.partitionBy(segment))  # one segment's categories per group
    return cells.select(segment, "value", round_half_even(F.col("cnt") * 100.0 / row_total, digits).alias("pct"))


def crosstab_wide(long: DataFrame, segment: str, values: Sequence[str] | None = None,
                  max_values: int = 1000) -> DataFrame:
    """AG5 wide: one column per category, absent cells 0.  ``values`` come first, also where absent, all
    others follow in order.  Beyond ``max_values`` columns the long form is the answer (an error, nothing is cut)."""
    found = [r[0] for r in long.select("value").distinct().limit(max_values + 1).collect()]
    if len(found) > max_values:
        raise ValueError(f"more than {max_values} categories: use the long form of crosstab_pct")
    values = [*(values or []), *sorted(set(found) - set(values or []))]
    return long.groupBy(segment).pivot("value", list(values)).agg(F.first("pct")).na.fill(0.0)


def segment_profile(df: DataFrame, segment: str, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """SG9: size and rounded means per segment in one aggregate, unpivoted to
    ``segment, line_no, metric, value`` (the lines of the profile text, the size first)."""
    present = [c for c in cols if c in df.columns]
    wide = df.groupBy(segment).agg(F.count(F.lit(1)).cast("double").alias("n"),
                                   *[round_half_even(F.avg(_number(df, c)), digits).alias(c) for c in present])
    pairs = F.array(F.struct(F.lit("n").alias("metric"), F.col("n").alias("value")),
                    *[F.struct(F.lit(f"avg_{c}").alias("metric"), F.col(c).alias("value")) for c in present])
    return wide.select(segment, F.posexplode(pairs).alias("line_no", "p")).select(segment, "line_no", "p.metric", "p.value")


def profile_lines(profile: DataFrame, segment: str, title: str = "Segment") -> DataFrame:
    """IO9 helper: profile rows as text lines ``segment, line_no, metric, line`` (written with ``write.text``)."""
    line = F.when(F.col("metric") == "n", F.format_string(f"{title} %s size : %d", F.col(segment),
                                                           F.col("value").cast("long"))) \
        .otherwise(F.format_string("  %s : %s", F.col("metric"),
                                   F.coalesce(F.col("value").cast("string"), F.lit("nan"))))
    return profile.select(segment, "line_no", "metric", line.alias("line"))
