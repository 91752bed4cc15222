"""Rows-only queries against brute force on small fixtures (numpy)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.operators import fourier, segment
from ridelens.operators import series as se
from ridelens.sources.tables import table

from .conftest import SF


def _features_np(pos, span, hod, dow, n_cp=fourier.N_CHANGEPOINTS):
    t = pos / max(span, 1.0)
    cols = [np.ones_like(t), t]
    cols += [np.maximum(t - fourier.CHANGEPOINT_RANGE * (j + 1) / (n_cp + 1), 0.0) for j in range(n_cp)]
    for k in range(1, fourier.DAILY_ORDER + 1):
        a = 2 * math.pi * k / 24.0 * hod
        cols += [np.sin(a), np.cos(a)]
    week = dow * 24.0 + hod
    for k in range(1, fourier.WEEKLY_ORDER + 1):
        a = 2 * math.pi * k / 168.0 * week
        cols += [np.sin(a), np.cos(a)]
    return np.column_stack(cols)


def test_fourier_matches_direct_ridge_solve(spark):
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    n = 21 * 24
    ys = [max(0, int(20 + 6 * math.sin(2 * math.pi * (t % 24) / 24) + 0.02 * t + rng.normal(0, 2))) for t in range(n)]
    df = spark.createDataFrame([("s", start + dt.timedelta(hours=i), y) for i, y in enumerate(ys)],
                               "series string, ds timestamp_ntz, y long")
    split = se.time_split(df)
    got = fourier.forecast_fourier(split, log=False).orderBy("ds").select("y_pred").toPandas()["y_pred"].to_numpy()

    n_test = int(n * 0.2)
    n_train = n - n_test
    pos = np.arange(n, dtype=float)
    ds = [start + dt.timedelta(hours=i) for i in range(n)]
    hod = np.array([d.hour for d in ds], dtype=float)
    dow = np.array([d.weekday() for d in ds], dtype=float)
    y = np.array(ys, dtype=float)
    span = float(n_train - 1)
    scale = np.abs(y[:n_train]).max()
    x = _features_np(pos, span, hod, dow)
    pen = fourier._penalties("hour", fourier.N_CHANGEPOINTS, 0.05)
    beta = np.linalg.solve(x[:n_train].T @ x[:n_train] + np.diag(pen), x[:n_train].T @ (y[:n_train] / scale))
    want = x[n_train:] @ beta * scale
    assert got == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_pca_matches_svd(spark):
    emb = table(spark, SF, "embeddings")
    got = segment.pca_2d(emb, "embedding", None).toPandas()
    mat = np.array([np.array(r, dtype=float) for r in emb.select("embedding").toPandas()["embedding"]])
    centred = mat - mat.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    proj = centred @ vt[:2].T
    for j, name in enumerate(["pc1", "pc2"]):
        sign = 1.0 if vt[j][np.abs(vt[j]).argmax()] >= 0 else -1.0
        assert got[name].to_numpy() == pytest.approx(proj[:, j] * sign, abs=1e-6)
