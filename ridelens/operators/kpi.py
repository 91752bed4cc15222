"""KP1-KP10: the figures the dashboard computes, as DataFrame queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.operators.customers import round_half_even
from ridelens.operators.series import SERIES, add_steps


def segment_overview(customers: DataFrame, segment: str = "customer_segment") -> DataFrame:
    """KP1: rows, distinct segments, mean distance, mean value (one aggregate)."""
    return customers.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(segment).alias("n_segments"),
        F.avg("avg_ride_distance").alias("mean_distance"),
        F.avg("avg_booking_value").alias("mean_value"),
    )


def segment_share(customers: DataFrame, segment: str = "customer_segment", digits: int = 2) -> DataFrame:
    """KP2: share of each segment in percent.  The total is a window over the k-row size table."""
    sizes = customers.groupBy(segment).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return sizes.select(segment, "n", round_half_even(F.col("n") * 100.0 / total, digits).alias("share_pct"))


def overall_kpis(customers: DataFrame, summary: DataFrame | None = None, weighted: bool = True) -> DataFrame:
    """KP3: total trips, completed share of them, mean value.  ``weighted=True``: from the customer
    rows, the mean value weighted by trips (customers without a value left out).
    ``weighted=False``: the dashboard's way, from the rows of the segment summary."""
    if not weighted and summary is None:
        raise ValueError("weighted=False needs the segment summary")
    value = F.col("avg_booking_value")
    mean = (F.try_divide(F.sum(value * F.col("total_trips")), F.sum(F.when(value.isNotNull(), F.col("total_trips"))))
            if weighted else F.avg(value))
    return (customers if weighted else summary).agg(
        F.sum("total_trips").cast("double").alias("total_trips"),
        F.try_divide(F.sum("completed_trips").cast("double"), F.sum("total_trips")).alias("completion_rate"),
        mean.alias("mean_value"),
    )


def segment_status(summary: DataFrame, segment: str = "customer_segment", digits: int = 2) -> DataFrame:
    """KP4: completed trips in percent of all and status counts per segment (projection of AG3)."""
    return summary.select(
        segment,
        round_half_even(F.try_divide(F.col("completed_trips"), F.col("total_trips")) * 100.0, digits).alias("completion_pct"),
        "completed_trips", "cancelled_trips", "incomplete_trips",
    )


def rename_existing(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """KP5: rename only the columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def improvement(metrics: DataFrame, base: str = "baseline_last", model: str = "additive_log1p",
                by: Sequence[str] = (SERIES,)) -> DataFrame:
    """KP6: MAE improvement of ``model`` over ``base`` in percent, per series."""
    b = metrics.where(F.col("model") == base).select(*by, F.col("mae").alias("base_mae"))
    m = metrics.where(F.col("model") == model).select(*by, F.col("mae").alias("model_mae"))
    return (b.join(m, list(by))
            .withColumn("improvement_pct", F.try_divide(F.col("base_mae") - F.col("model_mae"), F.col("base_mae")) * 100)
            .withColumn("verdict", F.when(F.col("model_mae") < F.col("base_mae"), "better").otherwise("worse")))


def metric_overview(metrics: DataFrame, model: str) -> DataFrame:
    """KP7: mean MAE / MAPE over series for one model, and the number of series."""
    return metrics.where(F.col("model") == model).agg(
        F.avg("mae").alias("mean_mae"), F.avg("mape").alias("mean_mape"), F.countDistinct(SERIES).alias("n_series"))


def rank_series(metrics: DataFrame, model: str) -> DataFrame:
    """KP8: series by MAE (upper-case names)."""
    return (metrics.where(F.col("model") == model)
            .select(F.upper(SERIES).alias(SERIES), "mae", "rmse", "mape").orderBy("mae", SERIES))


def tail(series_df: DataFrame, n: int = 20, freq: str = "hour", by: Sequence[str] = (SERIES,)) -> DataFrame:
    """KP9: last ``n`` points of each series.  Series frames are regular grids, so this is a
    filter against the per-series end, not a window over each series."""
    end = F.max("ds").over(Window.partitionBy(*by))
    return (series_df.withColumn("_end", end)
            .where(F.col("ds") > add_steps("_end", str(-n), freq)).drop("_end"))


def preview(df: DataFrame, cols: Sequence[str], n: int = 5, order_by: Sequence | None = None) -> DataFrame:
    """KP10: first ``n`` rows of the chosen columns that exist, in a given order (a top-n)."""
    present = [c for c in cols if c in df.columns]
    order = [c for c in (order_by or present[:1]) if not isinstance(c, str) or c in df.columns]
    return df.orderBy(*order).select(*present).limit(n)
