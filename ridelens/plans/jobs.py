"""The reference's jobs as Spark plans: cleaning, segmentation, forecasting.

Each job is a function over DataFrames; nothing runs at import.  Frames that several actions
read are persisted (``MEMORY_AND_DISK``) so the fits do not rescan the source.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import dates, strings
from ridelens.operators import clean
from ridelens.operators import series as se
from ridelens.session import cut_lineage


@dataclass
class CleanArtifacts:
    cast_profile: dict = field(default_factory=dict)
    caps: dict = field(default_factory=dict)
    rare: dict = field(default_factory=dict)
    date_formats: list = field(default_factory=list)


def date_formats(raw: DataFrame) -> list[str]:
    """The format of the booking times besides ISO, found in all rows of the raw table's date and time; at most one."""
    df = strings.snake_columns(raw)
    df = df.select([c for c in ("date", "time") if c in df.columns])
    if "date" not in df.columns:
        return []
    df = strings.strip_quotes(strings.normalize_nulls(df))
    found = dates.infer_format(df, dates.booking_text(df))
    return [] if found is None else [found]


def prepare_bookings(raw: DataFrame, order_col: str = "seq", formats: list[str] | None = None) -> DataFrame:
    """Cleaning up to the first data-dependent step: names, null tokens, quotes, datetime,
    calendar features, dedup on booking_id (first in ``order_col`` order) and status flags.

    Every step but the dedup is a function of the row's own values, so the dedup runs first,
    keyed on the *normalised* booking id: the result is the same as in the reference's order,
    the aggregate carries the raw text, and the string and date work runs after the shuffle on
    the surviving rows, spread over the shuffle partitions instead of the scan's.  ``formats`` pins the
    formats of the booking times; without, one job over the raw date and time columns finds them."""
    formats = date_formats(raw) if formats is None else formats
    df = strings.snake_columns(raw)
    if "booking_id" in df.columns:
        key = F.regexp_replace(strings.null_token(F.col("booking_id")), '^"|"$', "")
        order = [order_col] if order_col in df.columns else [c for c in df.columns if c != "booking_id"]
        df = clean.dedup(df.withColumn("_bid", key), ["_bid"], order).drop("_bid")
    df = strings.normalize_nulls(df)
    df = strings.strip_quotes(df)
    df = dates.parse_datetime(df, formats=formats)
    df = dates.calendar_features(df)
    if order_col in df.columns:
        df = df.drop(order_col)
    return clean.status_flags(df)


def impute_bookings(df: DataFrame, cast_decision: dict | None = None) -> tuple[DataFrame, dict]:
    """IM1 smart cast (+ ST4) and the domain imputations IM2-IM5."""
    df, profile = clean.smart_cast(df, decision=cast_decision)
    df = clean.fill_counts(df)
    df = clean.fill_cancelled(df)
    df = clean.fill_constants(df)
    return df, profile


def category_columns(df: DataFrame) -> list[str]:
    return [c for c in strings.string_columns(df) if c not in clean.PROTECTED]


def scaled_columns(df: DataFrame) -> list[str]:
    return [c for c in clean.SCALED_NUMERIC if c in df.columns and clean.is_numeric(df, c)]


def clean_bookings(raw: DataFrame, cast_decision: dict | None = None, quantile_method: str = "exact",
                   persist: bool = True, order_col: str = "seq", formats: list[str] | None = None) -> tuple[DataFrame, CleanArtifacts]:
    """Whole cleaning job in the reference's order: null tokens before parsing,
    dedup before flags, cast before imputation, cap before the rare collapse."""
    formats = date_formats(raw) if formats is None else formats
    df = prepare_bookings(raw, order_col, formats)
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df, profile = impute_bookings(df, cast_decision)
    numbers = df.select(*scaled_columns(df))  # read several times: parsed once
    if persist:
        numbers = numbers.persist(StorageLevel.MEMORY_AND_DISK)
    caps = clean.fit_caps(numbers, numbers.columns, method=quantile_method)
    numbers.unpersist()
    df = clean.apply_caps(df, caps)
    rare = clean.fit_rare(df, clean.rare_fracs(category_columns(df)))
    df = clean.apply_rare(df, rare)
    return df, CleanArtifacts(profile, caps, rare, formats)


def demand_split(df: DataFrame, ts: str = "datetime", series: str | None = "vehicle_type", freq: str = "hour",
                 ratio: float = 0.2, materialize: bool = True) -> DataFrame:
    """Forecast job input: zero-filled series split into train/test.

    The raw rows are read once; the series table (series x hours, small at any input size) is
    written as a reliable checkpoint so every model, metric and KPI branch reads it instead of
    re-aggregating the raw table, and a lost executor does not send them back to the raw scan."""
    split = se.time_split(se.hourly_demand(df, ts=ts, series=series, freq=freq), ratio=ratio, freq=freq)
    return cut_lineage(split) if materialize else split




# ------------------------------------------------------------------------------------------
# End-to-end jobs: each reads its input, runs the plan and writes its outputs.
# ------------------------------------------------------------------------------------------

#: Column that holds the place of a row in the raw files; of rows with one booking id the first stays.
FILE_ORDER = "file_order"

# Numeric columns of the trip profile and categories of the trip crosstabs.
TRIP_MEANS = ("booking_value", "ride_distance", "driver_ratings", "customer_rating", "avg_vtat", "avg_ctat", "fare_per_km")
TRIP_CROSSTABS = ("vehicle_type", "payment_method", "time_of_day")


def _out(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def run_clean_job(spark, raw_path: str, out_dir: str, fmt: str = "parquet", formats: list[str] | None = None) -> CleanArtifacts:
    """§3.1: raw CSV (all text) -> cleaned table + fitted encoder + feature names.  ``formats`` pins the formats of the
    booking times (none: found in the data and written to ``date_formats``)."""
    import json

    from ridelens.operators import encode
    from ridelens.sources import files

    raw = files.read_raw(spark, raw_path, position=FILE_ORDER)
    cleaned, art = clean_bookings(raw, order_col=FILE_ORDER, formats=formats)
    files.write_table(cleaned, _out(out_dir, "cleaned"), fmt)
    enc = encode.fit_encoder(cleaned)
    enc.save(_out(out_dir, "encoder"))
    files.write_json(enc.feature_table(), _out(out_dir, "feature_names"))
    spark.createDataFrame([(json.dumps(art.cast_profile),)], "profile string").coalesce(1).write.mode(
        "overwrite").text(_out(out_dir, "cast_profile"))
    spark.createDataFrame([(f,) for f in art.date_formats], "format string").coalesce(1).write.mode("overwrite").text(
        _out(out_dir, "date_formats"))
    return art


def run_trip_segmentation_job(spark, clean_dir: str, out_dir: str, k: int = 3, completed_only: bool = False,
                              min_value: float | None = None, seed: int = 42) -> None:
    """§3.2 trips: encoder -> k-means -> labels, means, crosstabs, centre ranges, PCA, profile."""
    from ridelens.operators import customers, encode, segment
    from ridelens.sources import files

    files.require(spark, [_out(clean_dir, "cleaned"), _out(clean_dir, "encoder")], "the clean job")
    cleaned = files.read_clean(spark, _out(clean_dir, "cleaned"))
    enc = encode.Encoder.load(_out(clean_dir, "encoder"))
    labelled, model, enc = segment.segment_trips(cleaned, k, completed_only, min_value, seed, encoder=enc)
    labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK)
    model.save(_out(out_dir, "kmeans_model"))
    files.write_table(labelled.drop("features"), _out(out_dir, "segmented_trips"))
    num = list(TRIP_MEANS)
    files.write_table(customers.segment_summary(labelled, "trip_segment", num, prefix="avg_"),
                      _out(out_dir, "cluster_summary_numeric"), "csv")
    for col in TRIP_CROSSTABS:
        if col in labelled.columns:
            files.write_table(customers.crosstab_pct(labelled, "trip_segment", col), _out(out_dir, f"cluster_{col}"),
                              "csv")
    cen = spark.createDataFrame([(int(c), int(d), float(v)) for c, centre in enumerate(model.centres)
                                 for d, v in enumerate(centre)], "label int, dim int, value double")
    files.write_table(segment.centroid_range(cen, "label", 30, enc.feature_table()),
                      _out(out_dir, "cluster_feature_importance"), "csv")
    files.write_table(segment.pca_2d(labelled, "features", "trip_segment"), _out(out_dir, "pca_2d"))
    prof = customers.segment_profile(labelled, "trip_segment", [c for c in num if c in labelled.columns])
    files.write_profile(customers.profile_lines(prof, "trip_segment", "Cluster"), _out(out_dir, "cluster_profile"),
                        order=("trip_segment", "line_no"))
    labelled.unpersist()


def run_customer_segmentation_job(spark, clean_dir: str, out_dir: str, k: int = 3, seed: int = 42) -> None:
    """§3.2 customers: features -> impute + scale -> k-means -> join back -> summaries, profile, PCA."""
    from ridelens.operators import customers, segment
    from ridelens.sources import files

    files.require(spark, [_out(clean_dir, "cleaned")], "the clean job")
    trips = files.read_clean(spark, _out(clean_dir, "cleaned"))
    cust, model, _ = segment.segment_customers(trips, k=k, seed=seed)
    cust = cust.persist(StorageLevel.MEMORY_AND_DISK)
    model.save(_out(out_dir, "kmeans_model"))
    files.write_table(cust.drop("features"), _out(out_dir, "segmented_customers"))
    files.write_table(customers.trips_with_segment(trips, cust), _out(out_dir, "trips_with_customer_segment"))
    feats = list(customers.CUSTOMER_FEATURES)
    files.write_table(customers.segment_summary(cust, "customer_segment", feats),
                      _out(out_dir, "customer_cluster_summary_numeric"), "csv")
    prof = customers.segment_profile(cust, "customer_segment", feats)
    files.write_profile(customers.profile_lines(prof, "customer_segment"), _out(out_dir, "customer_cluster_profile"),
                        order=("customer_segment", "line_no"))
    files.write_table(segment.pca_2d(cust, "features", "customer_segment"), _out(out_dir, "customer_pca_2d"))
    cust.unpersist()


def run_k_evaluation_job(spark, clean_dir: str, out_dir: str, max_k: int = 8, sample_fraction: float | None = None,
                         fast: bool = False, completed_only: bool = False, min_value: float | None = None) -> None:
    """§3.2 choice of k: row filters (FL5/FL6), encoder, inertia + silhouette for k = 2..max_k."""
    from ridelens.operators import encode, segment
    from ridelens.sources import files

    files.require(spark, [_out(clean_dir, "cleaned"), _out(clean_dir, "encoder")], "the clean job")
    cleaned = files.read_clean(spark, _out(clean_dir, "cleaned"))
    rows = clean.segmentation_input(cleaned, completed_only, min_value)
    x = encode.Encoder.load(_out(clean_dir, "encoder")).transform(rows).select("features")
    ev = segment.evaluate_k(x, range(2, max_k + 1), fast=fast, sample_fraction=sample_fraction)
    files.write_table(ev, _out(out_dir, "k_evaluation"), "csv")


def run_forecast_job(spark, clean_dir: str, out_dir: str, series: str | None = None, log_target: bool = False,
                     models=("baseline_last", "baseline_weekly", "additive_log1p", "fourier_log1p"),
                     metrics_version: str = "v2", horizon: int = 168, freq: str = "hour",
                     ts: str = "datetime", future_model: str = "additive") -> None:
    """§3.3: hourly series (global or per ``series``), split, all models, metrics, future.

    ``series=None`` is the global job; ``series="vehicle_type", log_target=True,
    metrics_version="v1"`` reproduces the per-vehicle job (log scale, 1e-6 MAPE floor).  The forecasts
    carry bounds and each series' fit status; ``future_model`` is the model of the future (FC6)."""
    from ridelens.operators import forecast as fc
    from ridelens.operators import metrics as me
    from ridelens.sources import files

    files.require(spark, [_out(clean_dir, "cleaned")], "the clean job")
    trips = files.read_clean(spark, _out(clean_dir, "cleaned"))
    hourly = se.hourly_demand(trips, ts=ts, series=series, freq=freq)
    if series is not None:
        hourly = se.usable_series(hourly, 50)
    if log_target:
        hourly = se.log_demand(hourly)
    split = cut_lineage(se.time_split(se.drop_null_target(hourly), freq=freq))
    files.write_by_series(split.select(se.SERIES, "ds", "y"), _out(out_dir, "hourly"))
    forecasts = fc.run_forecasts(split, models, freq=freq, bounds=True)
    files.write_by_series(forecasts, _out(out_dir, "forecasts"))
    metrics = me.forecast_metrics(forecasts, version=metrics_version)
    files.write_table(metrics, _out(out_dir, "metrics"), "csv")
    files.write_json(metrics, _out(out_dir, "metrics_json"))
    # the future is in orders: a log series goes back to orders, and the model takes its logarithm itself
    orders = split.withColumn("y", F.expm1("y")) if log_target else split
    files.write_by_series(fc.forecast_future(orders, horizon=horizon, log=True, freq=freq, model=future_model),
                          _out(out_dir, "future"))


def run_profile_job(spark, clean_dir: str, out_dir: str) -> None:
    """IM8-IM10: the cleaned trips with ``duration`` and ``distance``, and a profile of both."""
    from ridelens.operators import encode
    from ridelens.sources import files

    files.require(spark, [_out(clean_dir, "cleaned")], "the clean job")
    trips = encode.add_distance(encode.add_duration(files.read_clean(spark, _out(clean_dir, "cleaned"))))
    files.write_table(trips, _out(out_dir, "trips"))
    profile = encode.profile(trips, "duration").unionByName(encode.profile(trips, "distance"))
    files.write_table(profile, _out(out_dir, "profile"), "csv")


def run_distribution_job(spark, clean_dir: str, out_dir: str, bins: int = 10, points: int = 50) -> None:
    """DI1-DI3 for the numeric columns of the cleaned trips: one normality table, histograms and densities."""
    from ridelens.operators import distribution
    from ridelens.sources import files

    files.require(spark, [_out(clean_dir, "cleaned")], "the clean job")
    trips = files.read_clean(spark, _out(clean_dir, "cleaned"))
    cols = scaled_columns(trips)
    files.write_table(distribution.normality(trips, cols), _out(out_dir, "normality"), "csv")
    files.write_table(distribution.shapiro_francia(trips, cols), _out(out_dir, "normality_ranks"), "csv")
    for c in cols:
        files.write_table(distribution.histogram(trips, c, bins), _out(out_dir, f"histogram_{c}"), "csv")
        files.write_table(distribution.kde(trips, c, points, exact=False), _out(out_dir, f"density_{c}"), "csv")


__all__ = ["run_profile_job", "run_distribution_job", "date_formats", "CleanArtifacts", "prepare_bookings", "impute_bookings", "clean_bookings", "category_columns",
           "scaled_columns", "demand_split", "run_clean_job", "run_trip_segmentation_job",
           "run_customer_segmentation_job", "run_k_evaluation_job", "run_forecast_job"]
