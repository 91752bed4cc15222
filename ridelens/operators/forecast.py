"""Forecasts on a split series frame (see ``series.time_split``).

All models work per series with aggregates and equi-joins on the series x hours table; the raw
booking rows never pass through here.  Every model returns
``series, model, ds, y, y_pred`` (additive models also ``y_lower, y_upper``).

* FC2 ``forecast_last``      last train value (``max_by(y, ds)`` per series)
* FC3 ``forecast_weekly``    value one week earlier if that is a train point, else last value
* FC4 ``forecast_additive``  linear trend + mean residual per (weekday, hour) slot
* FC5 ``forecast_additive(log=True)``  FC4 on log1p(y), back with expm1, clipped at 0
* FC4 / FC5 Fourier variant (``fourier`` / ``fourier_log1p``) lives in ``fourier.py``: trend with
  changepoints + Fourier seasonality, ridge fit from per-series Gram matrices
* FC4 / FC5 with sparse trend changes and widening bounds (``sparse`` / ``sparse_log1p``): ``sparse_trend.py``
* FC6 ``forecast_future``    next ``horizon`` steps with bounds
* FC7 status column: a series whose trend cannot be fitted gets null forecasts, the others go on
* FC8 ``run_forecasts``      union of all models
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.operators.series import SERIES, add_steps

# Fixed value: width of the 80 % interval of a normal distribution.
Z80 = 1.2815515655446004

OUT_COLS = [SERIES, "model", "ds", "y", "y_pred"]
BOUND_COLS = ["y_lower", "y_upper", "status"]
_WEEK_STEPS = {"hour": 168, "day": 7}


def _train(split: DataFrame) -> DataFrame:
    return split.where(F.col("is_train"))


def _test(split: DataFrame) -> DataFrame:
    return split.where(~F.col("is_train"))


def last_train_value(split: DataFrame, value: str = "y") -> DataFrame:
    """One row per series: the y of the latest train point."""
    return _train(split).groupBy(SERIES).agg(F.max_by(F.col(value), F.col("ds")).cast("double").alias("last_y"))


def forecast_last(split: DataFrame, value: str = "y", model: str = "baseline_last") -> DataFrame:
    """FC2."""
    return (
        _test(split)
        .join(last_train_value(split, value), SERIES, "left")
        .select(SERIES, F.lit(model).alias("model"), "ds", F.col(value).cast("double").alias("y"),
                F.col("last_y").alias("y_pred"))
    )


def forecast_weekly(split: DataFrame, value: str = "y", model: str = "baseline_weekly",
                    freq: str = "hour", recursive: bool = False) -> DataFrame:
    """FC3 / JN2: y one week earlier among the train rows, else the last train value.

    ``recursive=False`` follows the reference: beyond the first test week there is no train
    point a week earlier, so it falls back to the last value.  ``recursive=True`` repeats the
    last train week instead.
    """
    test = _test(split)
    train = _train(split)
    if recursive:
        period = _WEEK_STEPS[freq]
        test = test.withColumn(
            "ref_pos", F.col("n_train") - period + F.pmod(F.col("pos") - F.col("n_train"), F.lit(period))
        )
        ref = train.select(SERIES, F.col("pos").alias("ref_pos"), F.col(value).alias("y_week"))
        joined = test.join(ref, [SERIES, "ref_pos"], "left")
    else:
        test = test.withColumn("ds_week", F.col("ds") - F.expr("INTERVAL 7 DAYS"))
        ref = train.select(SERIES, F.col("ds").alias("ds_week"), F.col(value).alias("y_week"))
        joined = test.join(ref, [SERIES, "ds_week"], "left")
    return (
        joined.join(last_train_value(split, value), SERIES, "left")
        .select(SERIES, F.lit(model).alias("model"), "ds", F.col(value).cast("double").alias("y"),
                F.coalesce(F.col("y_week").cast("double"), F.col("last_y")).alias("y_pred"))
    )


def _slots(freq: str) -> list[Column]:
    if freq == "hour":
        return [F.weekday("ds").alias("dow"), F.hour("ds").alias("hod")]
    return [F.weekday("ds").alias("dow")]


def _slot_names(freq: str) -> list[str]:
    return ["dow", "hod"] if freq == "hour" else ["dow"]


def fit_additive(rows: DataFrame, target: Column, freq: str = "hour") -> tuple[DataFrame, DataFrame]:
    """Classic decomposition per series: least-squares line on the step index, then the mean
    residual per seasonal slot, then the residual spread.

    Returns (line, season): ``line`` has ``series, a, b, sigma, status`` (one row per series),
    ``season`` has ``series, <slots>, s`` (at most 168 rows per series).
    """
    pts = rows.select(SERIES, "ds", F.col("pos").cast("double").alias("t"), target.alias("v"), *_slots(freq))
    line = pts.groupBy(SERIES).agg(
        F.regr_intercept("v", "t").alias("a"), F.regr_slope("v", "t").alias("b"))
    resid = pts.join(line, SERIES).withColumn("r", F.col("v") - (F.col("a") + F.col("b") * F.col("t")))
    season = resid.groupBy(SERIES, *_slot_names(freq)).agg(F.avg("r").alias("s"))
    spread = (
        resid.join(season, [SERIES, *_slot_names(freq)])
        .groupBy(SERIES).agg(F.stddev_pop(F.col("r") - F.col("s")).alias("sigma"))
    )
    line = line.join(spread, SERIES).withColumn(
        "status", F.when(F.col("b").isNull(), F.lit("failed")).otherwise(F.lit("ok")))
    return line, season


def predict_additive(rows: DataFrame, line: DataFrame, season: DataFrame, freq: str = "hour") -> DataFrame:
    """Adds ``fit`` (trend + season), ``lo`` and ``hi`` on the scale of the fit."""
    slots = _slot_names(freq)
    return (
        rows.select("*", *_slots(freq))
        .join(line, SERIES, "left")
        .join(season, [SERIES, *slots], "left")
        .withColumn("fit", F.col("a") + F.col("b") * F.col("pos") + F.coalesce(F.col("s"), F.lit(0.0)))
        .withColumn("lo", F.col("fit") - F.lit(Z80) * F.col("sigma"))
        .withColumn("hi", F.col("fit") + F.lit(Z80) * F.col("sigma"))
        .drop(*slots)
    )


def _back(c: Column, log: bool, clip: bool) -> Column:
    if log:
        c = F.expm1(c)
    if clip:
        c = F.greatest(c, F.lit(0.0))
    return c


def forecast_additive(split: DataFrame, value: str = "y", log: bool = False, clip: bool | None = None,
                      freq: str = "hour", model: str | None = None) -> DataFrame:
    """FC4 (``log=False``) and FC5 (``log=True``: fit on log1p(y), back by expm1, clip at 0)."""
    clip = log if clip is None else clip
    model = model or ("additive_log1p" if log else "additive")
    target = F.log1p(F.col(value).cast("double")) if log else F.col(value).cast("double")
    line, season = fit_additive(_train(split), target, freq)
    pred = predict_additive(_test(split), line, season, freq)
    return pred.select(
        SERIES, F.lit(model).alias("model"), "ds", F.col(value).cast("double").alias("y"),
        _back(F.col("fit"), log, clip).alias("y_pred"),
        _back(F.col("lo"), log, clip).alias("y_lower"),
        _back(F.col("hi"), log, clip).alias("y_upper"),
        "status",
    )


def forecast_future(split: DataFrame, horizon: int = 168, value: str = "y", log: bool = True,
                    clip: bool | None = None, freq: str = "hour", origin: str = "end",
                    model: str = "additive") -> DataFrame:
    """FC6: ``horizon`` steps after the end with ``yhat, yhat_lower, yhat_upper`` (in orders).

    ``origin="end"`` fits on every point of the series and starts after its last point;
    ``origin="train"`` fits on the train part and, like the reference, covers the train span
    plus ``horizon`` steps after it.  ``model`` is ``"additive"`` (trend + slot means), ``"fourier"`` or
    ``"sparse"`` (sparse trend changes; bounds that widen with the horizon).
    """
    clip = log if clip is None else clip
    target = F.log1p(F.col(value).cast("double")) if log else F.col(value).cast("double")
    if origin == "end":
        fit_rows = split
        span = split.groupBy(SERIES).agg(F.first("t0").alias("t0"), F.first("n").alias("n")).select(
            SERIES, "t0", F.col("n").alias("start"), (F.col("n") + horizon - 1).alias("stop"))
    elif origin == "train":
        fit_rows = _train(split)
        span = split.groupBy(SERIES).agg(F.first("t0").alias("t0"), F.first("n_train").alias("nt")).select(
            SERIES, "t0", F.lit(0).cast("long").alias("start"), (F.col("nt") + horizon - 1).alias("stop"))
    else:
        raise ValueError("origin must be 'end' or 'train'")
    grid = span.select(SERIES, "t0", F.explode(F.sequence("start", "stop")).alias("pos")).select(
        SERIES, "pos", add_steps("t0", "pos", freq).alias("ds"))
    if model == "additive":
        pred = predict_additive(grid, *fit_additive(fit_rows, target, freq), freq)
    elif model == "fourier":
        from ridelens.operators import fourier
        fitted = fourier.fit_fourier(fit_rows, target, freq, fourier.default_cp_scale(log))
        pred = fourier.predict_fourier(grid, fitted, freq)
    elif model == "sparse":
        from ridelens.operators import fourier, sparse_trend
        fitted = sparse_trend.fit_sparse_trend(fit_rows, target, freq, fourier.default_cp_scale(log))
        pred = sparse_trend.predict_sparse_trend(grid, fitted, freq)
    else:
        raise ValueError("model must be 'additive', 'fourier' or 'sparse'")
    return pred.select(
        SERIES, "ds",
        _back(F.col("fit"), log, clip).alias("yhat"),
        _back(F.col("lo"), log, clip).alias("yhat_lower"),
        _back(F.col("hi"), log, clip).alias("yhat_upper"),
    )


def _sparse(log: bool):
    def run(s, v, f):
        from ridelens.operators.sparse_trend import forecast_sparse_trend
        return forecast_sparse_trend(s, v, log=log, freq=f)
    return run


def _fourier(log: bool):
    def run(s, v, f):
        from ridelens.operators.fourier import forecast_fourier
        return forecast_fourier(s, v, log=log, freq=f)
    return run


MODELS = {
    "baseline_last": lambda s, v, f: forecast_last(s, v),
    "baseline_weekly": lambda s, v, f: forecast_weekly(s, v, freq=f),
    "additive": lambda s, v, f: forecast_additive(s, v, log=False, freq=f),
    "additive_log1p": lambda s, v, f: forecast_additive(s, v, log=True, freq=f),
    "fourier": _fourier(False),
    "fourier_log1p": _fourier(True),
    "sparse": _sparse(False),
    "sparse_log1p": _sparse(True),
}


def run_forecasts(split: DataFrame, models: Iterable[str] = ("baseline_last", "baseline_weekly", "additive_log1p"),
                  value: str = "y", freq: str = "hour", bounds: bool = False) -> DataFrame:
    """FC8: all models over all series in one table ``series, model, ds, y, y_pred``.

    ``bounds=True`` adds ``y_lower, y_upper`` (null for models without an interval) and ``status`` (FC7);
    a model without one of its own is ``failed`` where it has no forecast."""
    out = None
    for name in models:
        part = MODELS[name](split, value, freq)
        if bounds and "status" not in part.columns:
            none = F.lit(None).cast("double")
            part = part.withColumns({"y_lower": none, "y_upper": none, "status": F.when(
                F.col("y_pred").isNull(), F.lit("failed")).otherwise(F.lit("ok"))})
        part = part.select(*OUT_COLS, *(BOUND_COLS if bounds else []))
        out = part if out is None else out.unionByName(part)
    return out
