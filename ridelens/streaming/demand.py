"""Incremental hourly demand (AG6/AG7) with Structured Streaming.

Bookings that arrive as files are counted per (hour, category) as they come: a watermark on
the booking time bounds the state, and each hour is emitted once it can no longer change
(append mode).  ``series.zero_fill`` turns the written counts into the regular grid the
forecasts use, exactly as the batch ``hourly_demand`` does.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ridelens.operators.series import SERIES, zero_fill
from ridelens.session import checkpoint_dir

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_to_instant(col: str) -> F.Column:
    """Wall-clock ``timestamp_ntz`` -> the instant with that wall-clock in UTC (watermarks need
    ``timestamp``); epoch arithmetic, so independent of the session time zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, {col}))")


def instant_to_ntz(col: str) -> F.Column:
    """Inverse of ``ntz_to_instant``."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({col}), {_EPOCH})")


def hourly_counts_stream(spark: SparkSession, source: str, schema: T.StructType, ts: str = "datetime",
                         series: str | None = "vehicle_type", watermark: str = "2 hours",
                         fmt: str = "parquet") -> DataFrame:
    """Streaming ``series, ds, y``: non-empty hourly buckets, finalised after ``watermark``."""
    rows = spark.readStream.schema(schema).format(fmt).load(source).where(F.col(ts).isNotNull())
    key = F.lit("all") if series is None else F.col(series).cast("string")
    if series is not None:
        rows = rows.where(F.col(series).isNotNull())
    rows = rows.select(key.alias(SERIES), ntz_to_instant(ts).alias("_t"))
    return (rows.withWatermark("_t", watermark)
            .groupBy(SERIES, F.window("_t", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("y"))
            .select(SERIES, instant_to_ntz("w.start").alias("ds"), "y"))


def start_hourly_counts(counts: DataFrame, path: str, name: str = "hourly_counts",
                        available_now: bool = True) -> StreamingQuery:
    """Append finalised hours to a Parquet table; the checkpoint lives under the session's
    shared ``spark.checkpoint.dir`` so a restarted driver resumes where it stopped."""
    ckpt = os.path.join(checkpoint_dir(counts.sparkSession), "streams", name)
    writer = (counts.writeStream.outputMode("append").format("parquet")
              .option("path", path).option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def demand_from_counts(spark: SparkSession, path: str, freq: str = "hour") -> DataFrame:
    """Zero-filled series from the counts written so far (batch read of the sink)."""
    return zero_fill(spark.read.parquet(path), freq)
