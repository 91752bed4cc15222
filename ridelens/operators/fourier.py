"""FC4 / FC5, second variant: trend with changepoints + Fourier seasonality, ridge fit.

The reference fits Prophet (additive trend, daily and weekly seasonality).  Its solver is not
rebuilt; the same *model form* is fitted as a penalised least-squares problem per series:

* features (Spark array expressions, one array per row): intercept, scaled time, hinges
  ``max(0, t - c_j)`` at ``n_changepoints`` points spread over the first 80 % of the train
  span, daily Fourier terms (order 4) and weekly ones (order 3) -- Prophet's public defaults;
* target scaled by the series' train max |y| (as Prophet does);
* ridge penalties ``(sigma0 / scale)^2`` per block: changepoint scale 0.05 (FC4) or 0.5
  (FC5), seasonality 10, trend 5.

Distribution: each task turns its Arrow batches into partial Gram matrices XᵀX and Xᵀy per
series (numpy inside ``mapInPandas``), Spark sums the partials by ``(series, i)``, and one
grouped pandas call per series solves a p x p system (its input is p rows, whatever the series
length).  Scoring is a Spark dot product of the feature array with the coefficient array.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.operators.forecast import Z80, _back, _test, _train
from ridelens.operators.series import SERIES

# Prophet's public defaults used as the model form.
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
DAILY_ORDER = 4
WEEKLY_ORDER = 3
SEASONALITY_SCALE = 10.0
TREND_SCALE = 5.0
SIGMA0 = 0.1  # nominal noise of the scaled target that turns prior scales into ridge weights


def _n_features(freq: str, n_cp: int) -> int:
    return 2 + n_cp + (2 * DAILY_ORDER if freq == "hour" else 0) + 2 * WEEKLY_ORDER


def features(freq: str = "hour", n_cp: int = N_CHANGEPOINTS) -> Column:
    """Feature array from ``pos`` (steps since t0), ``span`` (train length) and ``ds``."""
    t = F.col("pos").cast("double") / F.greatest(F.col("span").cast("double"), F.lit(1.0))
    cols = [F.lit(1.0), t]
    cols += [F.greatest(t - F.lit(CHANGEPOINT_RANGE * (j + 1) / (n_cp + 1)), F.lit(0.0)) for j in range(n_cp)]
    if freq == "hour":
        hod = F.hour("ds").cast("double")
        for k in range(1, DAILY_ORDER + 1):
            a = F.lit(2 * math.pi * k / 24.0) * hod
            cols += [F.sin(a), F.cos(a)]
        week = F.weekday("ds").cast("double") * 24.0 + hod
        period = 168.0
    else:
        week = F.weekday("ds").cast("double")
        period = 7.0
    for k in range(1, WEEKLY_ORDER + 1):
        a = F.lit(2 * math.pi * k / period) * week
        cols += [F.sin(a), F.cos(a)]
    return F.array(*cols)


def default_cp_scale(log: bool) -> float:
    """Changepoint prior scale of FC5 (``log``) and FC4."""
    return 0.5 if log else 0.05


def _penalties(freq: str, n_cp: int, cp_scale: float) -> np.ndarray:
    pen = [(SIGMA0 / TREND_SCALE) ** 2] * 2 + [(SIGMA0 / cp_scale) ** 2] * n_cp
    pen += [(SIGMA0 / SEASONALITY_SCALE) ** 2] * (_n_features(freq, n_cp) - 2 - n_cp)
    return np.array(pen)


def _partial_gram(batches):
    """Per Arrow batch: XᵀX and Xᵀy per series, emitted in long form (series, i, row of p+1)."""
    for pdf in batches:
        for key, g in pdf.groupby("series", sort=False):
            x = np.stack(g["x"].to_numpy())
            y = g["v"].to_numpy(dtype=float)
            xtx = x.T @ x
            xty = x.T @ y
            rows = np.hstack([xtx, xty[:, None]])
            yield pd.DataFrame({"series": key, "i": np.arange(rows.shape[0]), "row": list(rows),
                                "n": len(g)})


def _solver(penalty: np.ndarray):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        m = np.stack(pdf["row"].to_numpy())
        a, b = m[:, :-1] + np.diag(penalty), m[:, -1]
        try:
            beta = np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            beta = np.full(len(b), np.nan)
        status = "ok" if np.isfinite(beta).all() else "failed"
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "beta": [beta.tolist()], "status": [status]})
    return solve


def _ship_by_value() -> None:
    """Pickle this module's worker functions by value, so executors need not have the package
    installed (shipping it with ``--py-files`` works as well)."""
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _dot(x: Column, beta: Column) -> Column:
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def fit_fourier(train: DataFrame, target: Column, freq: str = "hour", cp_scale: float = 0.05,
                n_cp: int = N_CHANGEPOINTS) -> DataFrame:
    """One row per series: ``series, span, scale, beta (array), sigma, status``."""
    _ship_by_value()
    stats = train.groupBy(SERIES).agg(F.max("pos").alias("span"), F.max(F.abs(target)).alias("scale"))
    rows = (train.join(stats, SERIES)
            .select(SERIES, "ds", "pos", "span", "scale",
                    (target / F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))).alias("v")))
    rows = rows.withColumn("x", features(freq, n_cp))
    partial = rows.select(SERIES, "x", "v").mapInPandas(
        _partial_gram, "series string, i int, row array<double>, n long")
    p1 = _n_features(freq, n_cp) + 1
    summed = partial.groupBy(SERIES, "i").agg(
        *[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(p1)])
    summed = summed.select(SERIES, "i", F.array(*[F.col(f"c{j}") for j in range(p1)]).alias("row"))
    coef = summed.groupBy(SERIES).applyInPandas(_solver(_penalties(freq, n_cp, cp_scale)),
                                                "series string, beta array<double>, status string")
    fitted = rows.join(coef, SERIES).withColumn("fit", _dot(F.col("x"), F.col("beta")))
    sigma = fitted.groupBy(SERIES).agg(F.stddev_pop(F.col("v") - F.col("fit")).alias("sigma"))
    return stats.join(coef, SERIES).join(sigma, SERIES)


def predict_fourier(rows: DataFrame, model: DataFrame, freq: str = "hour", n_cp: int = N_CHANGEPOINTS) -> DataFrame:
    """Adds ``fit, lo, hi`` on the target's scale."""
    scored = (rows.join(model, SERIES, "left").withColumn("x", features(freq, n_cp))
              .withColumn("_f", _dot(F.col("x"), F.col("beta"))))
    s = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))
    return (scored.withColumn("fit", F.col("_f") * s)
            .withColumn("lo", (F.col("_f") - F.lit(Z80) * F.col("sigma")) * s)
            .withColumn("hi", (F.col("_f") + F.lit(Z80) * F.col("sigma")) * s)
            .drop("x", "_f", "beta"))


def forecast_fourier(split: DataFrame, value: str = "y", log: bool = False, clip: bool | None = None,
                     freq: str = "hour", cp_scale: float | None = None, model: str | None = None) -> DataFrame:
    """FC4 (``log=False``, changepoint scale 0.05) / FC5 (``log=True``, scale 0.5) with Fourier terms."""
    clip = log if clip is None else clip
    scale = cp_scale if cp_scale is not None else default_cp_scale(log)
    model = model or ("fourier_log1p" if log else "fourier")
    target = F.log1p(F.col(value).cast("double")) if log else F.col(value).cast("double")
    fitted = fit_fourier(_train(split), target, freq, scale)
    pred = predict_fourier(_test(split).drop("span"), fitted, freq)
    return pred.select(
        SERIES, F.lit(model).alias("model"), "ds", F.col(value).cast("double").alias("y"),
        _back(F.col("fit"), log, clip).alias("y_pred"),
        _back(F.col("lo"), log, clip).alias("y_lower"),
        _back(F.col("hi"), log, clip).alias("y_upper"),
        "status",
    )
