"""FC4 / FC5, third variant: trend with sparse changes, bounds that widen with the horizon.

Same features as ``fourier.py``, other priors: trend changes have a Laplace prior (most of them become exactly
zero), all other weights a normal one, and the noise a half-normal one.  The mode of the posterior is found per
series from one Gram matrix of the features and the target:

* for given noise the weights are a convex problem.  Weights without an absolute value are eliminated (a Schur
  complement), the changes are found by coordinate descent; once the signs of the nonzero ones are known they are
  solved for directly, and the optimality conditions are checked;
* for given weights the noise has a closed form, and the two steps alternate until it stands still.

Bounds: changes go on after the end of the train span at the rate and with the mean size of the fitted ones.  With
``S`` changes per span, mean size ``m`` and ``h`` spans after the end they add ``2 S m^2 h^3 / 3`` to the variance
of the noise (the integral of ``S * 2 m^2 (h - c)^2`` over the places ``c``); nothing is drawn at random.

Distribution: as in ``fourier.py``, but noise and change rate come from the Gram matrix too, so the train rows are
read once and never joined with the weights.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.operators.forecast import Z80, _back, _test, _train
from ridelens.operators.fourier import (N_CHANGEPOINTS, SEASONALITY_SCALE, SIGMA0, TREND_SCALE, _dot, _n_features, _ship_by_value,
                                        default_cp_scale, features)
from ridelens.operators.series import SERIES

# Fixed value: scale of the half-normal prior of the noise (of a target scaled to at most 1).
NOISE_SCALE = 0.5
#: Least variance of the noise; a series that the features fit exactly would have none.
LEAST_VARIANCE = 1e-8
ROUNDS, SWEEPS = 100, 5000


def _signed_solution(s: np.ndarray, r: np.ndarray, lam: float, d: np.ndarray) -> np.ndarray | None:
    """The minimum of ``d's d / 2 - r'd + lam |d|`` if its nonzero entries and their signs are those of ``d``."""
    on = np.flatnonzero(d)
    out = np.zeros_like(d)
    if len(on):
        try:
            out[on] = np.linalg.solve(s[np.ix_(on, on)], r[on] - lam * np.sign(d[on]))
        except np.linalg.LinAlgError:
            return None
        if (np.sign(out[on]) != np.sign(d[on])).any():
            return None
    off = d == 0
    return out if (np.abs(r - s @ out)[off] <= lam * (1 + 1e-9) + 1e-13).all() else None


def sparse_weights(s: np.ndarray, r: np.ndarray, lam: float, start: np.ndarray) -> np.ndarray:
    """Minimum of ``d's d / 2 - r'd + lam |d|`` by coordinate descent from ``start``."""
    d = start.copy()
    live = np.flatnonzero(np.diag(s) > 1e-14 * max(1.0, float(np.abs(s).max())))
    d[np.setdiff1d(np.arange(len(d)), live)] = 0.0
    for sweep in range(SWEEPS):
        moved = 0.0
        for j in live:
            gap = r[j] - s[j] @ d + s[j, j] * d[j]
            new = np.sign(gap) * max(abs(gap) - lam, 0.0) / s[j, j]
            moved = max(moved, abs(new - d[j]))
            d[j] = new
        if sweep % 10 == 9 or moved < 1e-14:
            exact = _signed_solution(s, r, lam, d)
            if exact is not None:
                return exact
            if moved < 1e-14:
                break
    return d


def posterior_mode(z: np.ndarray, n: int, precision: np.ndarray, cp: slice, cp_scale: float) -> tuple[np.ndarray, float]:
    """Weights and variance of the noise from the Gram matrix ``z`` of the features and, last, the target.

    ``precision`` has the inverse prior variances of the weights outside ``cp``.
    """
    g, c, yy = z[:-1, :-1], z[:-1, -1], z[-1, -1]
    d = np.zeros(g.shape[0], bool)
    d[cp] = True
    o = ~d
    variance, changes = SIGMA0 ** 2, np.zeros(int(d.sum()))
    beta = np.zeros(g.shape[0])
    for _ in range(ROUNDS):
        inner = g[np.ix_(o, o)] + np.diag(variance * precision[o])
        both = np.linalg.solve(inner, np.column_stack([g[np.ix_(o, d)], c[o]]))
        s = g[np.ix_(d, d)] - g[np.ix_(d, o)] @ both[:, :-1]
        changes = sparse_weights((s + s.T) / 2, c[d] - g[np.ix_(d, o)] @ both[:, -1], variance / cp_scale, changes)
        beta[d], beta[o] = changes, both[:, -1] - both[:, :-1] @ changes
        rss = max(float(yy - 2 * c @ beta + beta @ g @ beta), 0.0)
        b = n * NOISE_SCALE ** 2  # root of variance^2 / NOISE_SCALE^2 + n variance - rss
        new = max(2 * rss * NOISE_SCALE ** 2 / (b + np.sqrt(b * b + 4 * rss * NOISE_SCALE ** 2)), LEAST_VARIANCE)
        done, variance = abs(new - variance) <= 1e-9 * variance, new
        if done:
            break
    return beta, variance


def _precision(freq: str, n_cp: int) -> np.ndarray:
    p = np.full(_n_features(freq, n_cp), SEASONALITY_SCALE ** -2)
    p[:2] = TREND_SCALE ** -2
    p[2:2 + n_cp] = 0.0
    return p


def _partial_gram(batches):
    """Per Arrow batch and series: the Gram matrix of features and target, a row at a time."""
    for pdf in batches:
        for key, g in pdf.groupby("series", sort=False):
            x = np.column_stack([np.stack(g["x"].to_numpy()), g["v"].to_numpy(dtype=float)])
            rows = x.T @ x
            yield pd.DataFrame({"series": key, "i": np.arange(len(rows)), "row": list(rows), "n": len(g)})


def _solver(precision: np.ndarray, n_cp: int, cp_scale: float):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        cp = slice(2, 2 + n_cp)
        try:
            beta, variance = posterior_mode(np.stack(pdf["row"].to_numpy()), int(pdf["n"].iloc[0]), precision, cp, cp_scale)
        except np.linalg.LinAlgError:
            beta, variance = np.full(len(pdf) - 1, np.nan), np.nan
        ok = bool(np.isfinite(beta).all())
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "beta": [beta.tolist() if ok else None], "sigma": [np.sqrt(variance) if ok else None],
                             "rate": [float(np.abs(beta[cp]).mean()) if ok else None], "status": ["ok" if ok else "failed"]})
    return solve


def fit_sparse_trend(train: DataFrame, target: Column, freq: str = "hour", cp_scale: float = 0.05,
                     n_cp: int = N_CHANGEPOINTS) -> DataFrame:
    """One row per series: ``series, span, scale, beta (array), sigma, rate, status``; ``rate`` is the mean size of a
    trend change.  Null targets are left out; a series without any other is ``failed``."""
    from pyspark import cloudpickle
    _ship_by_value()
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    stats = train.groupBy(SERIES).agg(F.max("pos").alias("span"), F.max(F.abs(target)).alias("scale"))
    rows = train.join(stats, SERIES).select(SERIES, "ds", "pos", "span", (target / _unit()).alias("v")).where("v is not null")
    partial = rows.select(SERIES, features(freq, n_cp).alias("x"), "v").mapInPandas(
        _partial_gram, "series string, i int, row array<double>, n long")
    p = _n_features(freq, n_cp) + 1
    summed = partial.groupBy(SERIES, "i").agg(F.sum("n").alias("n"), *[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(p)])
    summed = summed.select(SERIES, "i", "n", F.array(*[f"c{j}" for j in range(p)]).alias("row"))
    coef = summed.groupBy(SERIES).applyInPandas(_solver(_precision(freq, n_cp), n_cp, cp_scale),
                                                "series string, beta array<double>, sigma double, rate double, status string")
    return stats.join(coef, SERIES, "left").withColumn("status", F.coalesce("status", F.lit("failed")))


def _unit() -> Column:
    return F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))


def predict_sparse_trend(rows: DataFrame, model: DataFrame, freq: str = "hour", n_cp: int = N_CHANGEPOINTS) -> DataFrame:
    """Adds ``fit, lo, hi`` on the target's scale; beyond the train span the bounds widen."""
    after = F.greatest(F.col("pos") / F.greatest(F.col("span").cast("double"), F.lit(1.0)) - 1, F.lit(0.0))
    scored = rows.join(model, SERIES, "left").withColumns({
        "fit": _dot(features(freq, n_cp), F.col("beta")) * _unit(),
        "_w": F.lit(Z80) * F.sqrt(F.pow("sigma", F.lit(2)) + F.lit(2 * n_cp / 3) * F.pow("rate", F.lit(2)) * F.pow(after, F.lit(3))) * _unit()})
    return scored.withColumns({"lo": F.col("fit") - F.col("_w"), "hi": F.col("fit") + F.col("_w")}).drop("_w", "beta")


def forecast_sparse_trend(split: DataFrame, value: str = "y", log: bool = False, clip: bool | None = None,
                          freq: str = "hour", cp_scale: float | None = None, model: str | None = None) -> DataFrame:
    """FC4 (``log=False``, change scale 0.05) / FC5 (``log=True``, 0.5) with sparse trend changes; columns as ``forecast_fourier``."""
    clip = log if clip is None else clip
    target = F.log1p(F.col(value).cast("double")) if log else F.col(value).cast("double")
    fitted = fit_sparse_trend(_train(split), target, freq, default_cp_scale(log) if cp_scale is None else cp_scale)
    pred = predict_sparse_trend(_test(split).drop("span"), fitted, freq)
    return pred.select(
        SERIES, F.lit(model or ("sparse_log1p" if log else "sparse")).alias("model"), "ds", F.col(value).cast("double").alias("y"),
        _back(F.col("fit"), log, clip).alias("y_pred"), _back(F.col("lo"), log, clip).alias("y_lower"),
        _back(F.col("hi"), log, clip).alias("y_upper"), "status")
