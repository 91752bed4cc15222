"""Principal components against numpy, dense and sparse, narrow and wide."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from ridelens.operators import pca, segment


def numpy_pca(x, k=2):
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    v = vt[:k] * np.where(vt[np.arange(k), np.abs(vt[:k]).argmax(1)] >= 0, 1, -1)[:, None]
    return c @ v.T, s[:k] ** 2 / len(x)


@pytest.mark.parametrize("kind", ["flat", "sparse"])
def test_equals_numpy_on_200_columns(spark, kind):
    """Also where the spectrum is flat, so plain power steps would hardly converge."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 200)) + 5 if kind == "flat" else (rng.random((600, 200)) < 0.03) * rng.integers(1, 5, (600, 200)).astype(float)
    vec = (lambda r: Vectors.dense(r)) if kind == "flat" else (lambda r: Vectors.sparse(200, {int(j): float(r[j]) for j in np.flatnonzero(r)}))
    df = spark.createDataFrame([(i, vec(r)) for i, r in enumerate(x)], ["i", "v"]).repartition(3)
    want, var = numpy_pca(x)
    got = segment.pca_2d(df, "v", "i").toPandas().sort_values("i")[["pc1", "pc2"]].to_numpy()
    assert np.abs(got - want).max() < 1e-6
    assert pca.principal_components(df, "v")[2] == pytest.approx(var, rel=1e-8)


def test_twenty_thousand_dummies(spark):
    rng = np.random.default_rng(5)
    n, d = 500, 20_000
    codes = np.stack([rng.zipf(1.5, n) % 100, 100 + rng.integers(0, d - 100, n)], 1)
    df = spark.createDataFrame([(i, Vectors.sparse(d, sorted((int(j), 1.0) for j in set(c)))) for i, c in enumerate(codes)], ["i", "v"])
    mean, vectors, values = pca.principal_components(df, "v")
    x = np.zeros((n, d))
    for i, c in enumerate(codes):
        x[i, c] = 1
    want, var = numpy_pca(x)
    assert values == pytest.approx(var, rel=1e-7) and np.allclose((x - mean) @ vectors.T, want, atol=1e-5)


def test_small_spans_and_nulls(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([3.0, 4.0, 5.0],), (None,)], "v array<double>")
    rows = segment.pca_2d(df, "v").collect()
    assert sorted(abs(round(r.pc1, 9)) for r in rows if r.pc1 is not None) == [1.732050808] * 2
    assert [r.pc2 for r in rows if r.pc1 is not None] == [0.0, 0.0] and sum(r.pc1 is None for r in rows) == 1
    same = spark.createDataFrame([([1.0, 2.0],)] * 3, "v array<double>")
    assert [(r.pc1, r.pc2) for r in segment.pca_2d(same, "v").collect()] == [(0.0, 0.0)] * 3
    assert segment.pca_2d(df.limit(0), "v").collect() == []
