"""Order statistics by brackets against numpy, and the plans behind them."""

import numpy as np
import pytest

from ridelens.operators import encode, quantiles


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(4)
    n = 6000
    cols = {
        "smooth": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 12, n).astype(float)),  # ties on and around the ranks
        "wide": np.exp(rng.normal(scale=30, size=n)) * rng.choice([-1, 1], n),
        "flat": np.full(n, 3.0),
        "inf": np.where(rng.random(n) < 0.2, np.inf, rng.random(n)),
    }
    rows = [tuple(None if rng.random() < 0.1 else float("nan") if rng.random() < 0.02 else float(v[i]) for v in cols.values()) for i in range(n)]
    return rows, spark.createDataFrame([(*r, None) for r in rows], ", ".join(f"{c} double" for c in [*cols, "none"])).repartition(3).persist()


def column(rows, i):
    x = [r[i] for r in rows if r[i] is not None]
    return np.array([v for v in x if v == v])


PROBS = [0.0, 0.01, 0.25, 0.4, 0.5, 0.77, 0.99, 1.0]


@pytest.mark.parametrize("held", [quantiles.HELD, 60])
def test_order_statistics_equal_numpy(values, held):
    """Also where intervals must be narrowed again and again."""
    rows, df = values
    ranks = [0, 1, 17, 1500, 2700, 2701, 5000, 10 ** 9]
    found = quantiles.order_statistics(df, {c: lambda n, _: [*ranks, n - 1] for c in df.columns}, held)
    for i, c in enumerate(df.columns[:-1]):
        x = np.sort(column(rows, i))
        n, missing, at = found[c]
        assert (n, missing) == (len(x), len(rows) - len(x))
        assert at == {r: x[r] for r in [*ranks, n - 1] if r < n}
    assert found["none"] == (0, len(rows), {})


def test_quantiles_equal_numpy(values):
    rows, df = values
    got = quantiles.quantiles(df, df.columns, PROBS)
    for i, c in enumerate(df.columns[:-1]):
        x = column(rows, i)
        if c == "inf":
            x = np.where(np.isinf(x), 1e300, x)
            got[c] = [1e300 if np.isinf(v) else v for v in got[c]]
        assert np.allclose(got[c], np.quantile(x, PROBS), rtol=1e-12, atol=0)
    assert got["none"] == [None] * len(PROBS)


def test_a_misleading_sketch_changes_nothing(values, monkeypatch):
    """The sketch only proposes; with wrong proposals the search takes longer and finds the same."""
    from pyspark.sql import functions as F
    rows, df = values
    monkeypatch.setattr(quantiles, "_sketch", lambda x: F.transform(F.sequence(F.lit(0), F.lit(quantiles.GRID)), lambda i: F.min(x) * 0 + F.max(x)))
    x = np.sort(column(rows, 1))
    assert quantiles.order_statistics(df, {"hot": lambda n, _: [10, 3000]}, 10)["hot"][2] == {10: x[10], 3000: x[3000]}


def test_filled_quartiles_and_encoder(values):
    rows, df = values
    got = quantiles.filled_quartiles(df, ["smooth", "hot", "flat", "none"])
    for c, i in (("smooth", 0), ("hot", 1), ("flat", 3)):
        x = column(rows, i)
        m = np.median(x)
        filled = np.append(x, np.full(len(rows) - len(x), m))
        assert np.allclose(got[c], [m, *np.quantile(filled, [0.25, 0.5, 0.75])], rtol=1e-12)
    assert got["none"] == [None] * 4
    enc = encode.fit_encoder(df, {"scaled": ["smooth", "flat", "none"], "categorical": [], "passthrough": []})
    assert enc.scaled == ["smooth", "flat"] and enc.robust["flat"] == (3.0, 1.0)
    assert np.allclose(enc.robust["smooth"], (got["smooth"][2], got["smooth"][3] - got["smooth"][1]))


def test_no_value_is_shuffled(values):
    """Fetching is a filter; sketches and counts exchange one partial row per task."""
    _, df = values
    plan = quantiles.brackets(df, [("smooth", 0.0, 0.1), ("hot", None, 3.0)])._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[-1].split("InMemoryRelation")[0]
    agg = df.agg(quantiles._sketch(quantiles._number("smooth")))._jdf.queryExecution().toString()
    physical = agg.split("Physical Plan")[-1].split("InMemoryRelation")[0]
    assert physical.count("Exchange") == 1 and "Exchange SinglePartition" in physical
