"""Sparse trend changes and widening bounds against numpy: another solver, optimality conditions, drawn futures."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.operators import forecast as fc
from ridelens.operators import fourier
from ridelens.operators import series as se
from ridelens.operators import sparse_trend as st

from .test_bruteforce import _features_np

START = dt.datetime(2024, 1, 1)
CP = slice(2, 2 + fourier.N_CHANGEPOINTS)


def _demand(n=28 * 24, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 40 + 6 * np.sin(2 * math.pi * t / 24) + 0.02 * t - 0.07 * np.maximum(t - n * 0.4, 0) + rng.normal(0, 2, n)


def _split(spark, ys, name="s"):
    rows = [(name, START + dt.timedelta(hours=i), float(y)) for i, y in enumerate(ys)]
    return se.time_split(spark.createDataFrame(rows, "series string, ds timestamp_ntz, y double"))


def _x(n, span):
    pos = np.arange(n, dtype=float)
    return _features_np(pos, span, pos % 24, (pos // 24) % 7)


def _proximal(x, y, variance, cp_scale, steps=200_000):
    """The same optimum by accelerated proximal gradient steps (with restarts), another method altogether."""
    w = variance * st._precision("hour", fourier.N_CHANGEPOINTS)
    g, c = x.T @ x + np.diag(w), x.T @ y
    lam, step = variance / cp_scale, 1 / np.linalg.eigvalsh(g)[-1]
    b = z = np.linalg.solve(g + 1e-9 * np.eye(len(g)), c)
    k = 1.0
    for _ in range(steps):
        new = z - step * (g @ z - c)
        new[CP] = np.sign(new[CP]) * np.maximum(np.abs(new[CP]) - step * lam, 0)
        k2 = (1 + math.sqrt(1 + 4 * k * k)) / 2
        if (z - new) @ (new - b) > 0:  # restart
            k2 = 1.0
        z, b, k = new + (k - 1) / k2 * (new - b), new, k2
    return b, 0.5 * b @ g @ b - c @ b + lam * np.abs(b[CP]).sum()


@pytest.mark.parametrize("cp_scale", [0.05, 0.5])
def test_mode_is_optimal_and_sparse(cp_scale):
    ys = _demand()
    n, scale = len(ys), np.abs(ys).max()
    x, y = _x(n, n - 1.0), ys / scale
    z = np.column_stack([x, y])
    precision = st._precision("hour", fourier.N_CHANGEPOINTS)
    beta, variance = st.posterior_mode(z.T @ z, n, precision, CP, cp_scale)
    pull = x.T @ (y - x @ beta) - variance * precision * beta  # the slope that the Laplace prior has to meet
    lam = variance / cp_scale
    off = np.ones(len(beta), bool)
    off[CP] = False
    assert np.abs(pull[off]).max() < 1e-7
    on = beta[CP] != 0
    assert pull[CP][on] == pytest.approx(lam * np.sign(beta[CP][on]), rel=1e-4, abs=1e-8) and (np.abs(pull[CP][~on]) <= lam * 1.0001).all()
    assert 0 < on.sum() < fourier.N_CHANGEPOINTS
    rss = ((y - x @ beta) ** 2).sum()  # d/ds of n log s + rss / 2 s^2 + s^2 / 2 / 0.25 is zero
    assert n - rss / variance + variance / st.NOISE_SCALE ** 2 == pytest.approx(0, abs=1e-4 * n)
    other, value = _proximal(x, y, variance, cp_scale)
    g = x.T @ x + np.diag(variance * precision)
    ours = 0.5 * beta @ g @ beta - x.T @ y @ beta + lam * np.abs(beta[CP]).sum()
    assert ours <= value + 1e-9 and x @ beta == pytest.approx(x @ other, abs=2e-4)


def test_spark_fit_equals_numpy_and_bounds_widen(spark):
    ys = _demand()
    split = _split(spark, ys)
    got = st.forecast_sparse_trend(split).orderBy("ds").toPandas()
    n, n_test = len(ys), len(got)
    span = n - n_test - 1.0
    x, scale = _x(n, span), np.abs(ys[:n - n_test]).max()
    z = np.column_stack([x, ys / scale])[:n - n_test]
    beta, variance = st.posterior_mode(z.T @ z, n - n_test, st._precision("hour", fourier.N_CHANGEPOINTS), CP, 0.05)
    assert got["y_pred"].to_numpy() == pytest.approx(x[n - n_test:] @ beta * scale, rel=1e-6)
    width = (got["y_upper"] - got["y_lower"]).to_numpy()
    assert (np.diff(width) > 0).all() and set(got["status"]) == {"ok"}

    rng = np.random.default_rng(5)  # futures drawn as the bounds assume: places at random, sizes of a Laplace law
    h, rate = n_test / span, np.abs(beta[CP]).mean()
    drawn = []
    for _ in range(40_000):
        c = rng.uniform(0, h, rng.poisson(fourier.N_CHANGEPOINTS * h))
        drawn.append((rng.laplace(0, rate, len(c)) * (h - c)).sum())
    want = 2 * fc.Z80 * math.sqrt(variance + np.var(drawn)) * scale
    assert width[-1] == pytest.approx(want, rel=0.03)


def test_future_widens_and_odd_series_end(spark):
    wide = fc.forecast_future(_split(spark, _demand()), horizon=168, log=False, model="sparse").orderBy("ds").toPandas()
    gap = (wide["yhat_upper"] - wide["yhat_lower"]).to_numpy()
    assert len(wide) == 168 and (np.diff(gap) > 0).all()
    odd = _split(spark, [0.0] * 60, "zero").unionByName(_split(spark, [5.0] * 60, "flat")).unionByName(
        _split(spark, [1.0] * 60, "none").withColumn("y", F.lit(None).cast("double"))).unionByName(_split(spark, [3.0, 4.0], "two"))
    out = {(r.series, r.status) for r in st.forecast_sparse_trend(odd).collect()}
    assert ("zero", "ok") in out and ("flat", "ok") in out and ("none", "failed") in out
    flat = [r.y_pred for r in st.forecast_sparse_trend(odd).where("series = 'flat'").collect()]
    assert flat == pytest.approx([5.0] * len(flat), abs=0.05)
    bounds = fc.run_forecasts(odd, ["baseline_last", "sparse", "sparse_log1p"], bounds=True)
    assert bounds.where("model = 'sparse'").count() == bounds.where("model = 'baseline_last'").count()
