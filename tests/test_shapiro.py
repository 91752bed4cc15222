"""The rank statistic of normality against numpy."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from ridelens.operators import distribution


def numpy_w(x):
    x = np.sort(x)
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    w = (x @ m) ** 2 / ((m @ m) * ((x - x.mean()) ** 2).sum())
    u = math.log(n)
    z = (math.log(1 - w) - (1.0521 * (math.log(u) - u) - 1.2725)) / (1.0308 - 0.26758 * (math.log(u) + 2 / u))
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def test_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(distribution, "RANKS", 300)
    rng = np.random.default_rng(2)
    n = 5000
    cols = {"normal": rng.normal(3, 2, n), "skewed": rng.exponential(size=n), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 9, n)).astype(float)}
    rows = [tuple(float(v[i]) for v in cols.values()) + (1.0, None) for i in range(n)] + [(None, float("nan"), None, None, None)]
    df = spark.createDataFrame(rows, "normal double, skewed double, hot double, flat double, none double").repartition(3)
    got = {r.feature: r for r in distribution.shapiro_francia(df, df.columns).collect()}
    for c, x in cols.items():
        w, p = numpy_w(x)
        assert got[c].n == n and got[c].w == pytest.approx(w, rel=1e-9) and got[c].p_value == pytest.approx(p, rel=1e-6, abs=1e-12)
    assert got["normal"].is_normal and not got["skewed"].is_normal and not got["hot"].is_normal
    assert got["flat"].w is None and got["flat"].p_value is None and "none" not in got
    assert distribution.shapiro_francia(df.limit(0), ["normal"]).collect() == []
