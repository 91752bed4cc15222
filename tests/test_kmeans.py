"""K-means passes for many runs against numpy; mini-batches, sparse vectors, silhouettes."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ridelens.operators import kmeans, segment


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(8)
    mid = rng.normal(scale=6, size=(5, 4))
    x = np.concatenate([mid[i] + rng.normal(size=(int(n), 4)) for i, n in enumerate((900, 300, 150, 100, 50))])
    rng.shuffle(x)
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, features array<double>").repartition(5).persist()


def lloyd(x, centres, tol, n_iter=300):
    limit = tol * x.var(axis=0).mean()
    for _ in range(n_iter):
        label = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[label == i].mean(0) if (label == i).any() else centres[i] for i in range(len(centres))])
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= limit:
            break
    return centres, ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_all_runs_equal_single_fits(blobs):
    """The passes for all starts and k give what Lloyd's steps of each run alone give, and the best of them."""
    x, df = blobs
    rows = df.select(kmeans.entries(df, "features").alias("v")).persist()
    starts = kmeans.starting_centres(rows, [2, 5], 4, 42)
    assert set(starts) == {(s, k) for s in range(4) for k in (2, 5)} and all(len(c) == k for (_, k), c in starts.items())
    fits = kmeans.fit_all(df, [2, 5], n_init=4)
    for k in (2, 5):
        alone = [lloyd(x, starts[s, k], 1e-4) for s in range(4)]
        costs = [c for _, c in alone]
        assert fits[k].cost == pytest.approx(min(costs)) and fits[k].start == int(np.argmin(np.round(costs, 9)))
        assert np.allclose(fits[k].centres, alone[fits[k].start][0])
        assert fits[k].stats["n"].sum() == len(x)


def test_best_cost_is_that_of_ten_library_fits(spark, blobs):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    _, df = blobs
    vec = df.select(array_to_vector("features").alias("features")).persist()
    theirs = min(KMeans(k=5, seed=s, maxIter=50).fit(vec).summary.trainingCost for s in range(10))
    assert kmeans.fit_all(df, [5])[5].cost <= theirs * 1.001


def test_minibatch_is_close_to_the_full_fit(blobs):
    _, df = blobs
    full, mini = kmeans.fit_all(df, [3, 5]), kmeans.fit_all(df, [3, 5], batches=kmeans.BATCHES)
    for k in (3, 5):
        assert full[k].cost <= mini[k].cost * 1.0001 and mini[k].cost <= full[k].cost * 1.02


def test_sparse_equals_dense(spark):
    rng = np.random.default_rng(1)
    x = np.zeros((400, 60))
    for r in x:
        r[rng.integers(0, 30, 3) + 30 * rng.integers(0, 2)] = rng.integers(1, 4, 3)
    x[5] = 0
    sparse = spark.createDataFrame([(i, Vectors.sparse(60, {int(j): float(r[j]) for j in np.flatnonzero(r)})) for i, r in enumerate(x)], ["i", "features"])
    dense = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["i", "features"])
    sets = [x[:3], x[7:12]]
    a, b = (kmeans.pass_sums(d.select(kmeans.entries(d, "features").alias("v")), sets) for d in (sparse, dense))
    for p, q, c in zip(a, b, sets):
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        assert p["n"].tolist() == q["n"].tolist() and np.allclose(p["s"], q["s"]) and p["cost"] == pytest.approx(q["cost"])
        assert p["cost"] == pytest.approx(((x - c[label]) ** 2).sum())
    fit = kmeans.fit_all(sparse, [2], n_init=3)[2]
    assert fit.transform(sparse).where("_pred is null").count() == 0


def test_silhouettes_equal_the_evaluator(blobs):
    from pyspark.ml.functions import array_to_vector
    _, df = blobs
    fits = kmeans.fit_all(df, [1, 2, 4], n_init=2)
    ours = kmeans.silhouettes(df, fits)
    assert ours[1] is None
    for k in (2, 4):
        lab = fits[k].transform(df).select(array_to_vector("features").alias("features"), F.col("_pred").cast("double").alias("prediction"))
        assert ours[k] == pytest.approx(ClusteringEvaluator().evaluate(lab), abs=1e-9)


def test_few_rows_nulls_and_saving(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 1.0],), ([1.0, 1.0],), ([5.0, 5.0],), (None,)], "features array<double>")
    fits = kmeans.fit_all(df, [2, 4], n_init=2)
    assert fits[2].cost == pytest.approx(0) and len(fits[4].centres) == 2
    assert sorted(r._pred is None for r in fits[2].transform(df).collect()) == [False, False, False, True]
    assert kmeans.fit_all(df.limit(0), [2]) == {}
    fits[2].save(str(tmp_path / "m"))
    again = kmeans.KMeansFit.load(str(tmp_path / "m"))
    assert np.array_equal(again.centres, fits[2].centres) and again.cost == fits[2].cost
    assert segment.evaluate_k(df, [2], n_init=2).first().silhouette == pytest.approx(2 / 3)


def test_saved_customer_model_places_the_same_customers(spark, tmp_path):
    from ridelens.operators import customers
    from ridelens.plans import jobs
    from ridelens.sources.tables import dirty_bookings

    from .conftest import SF
    trips = jobs.clean_bookings(dirty_bookings(spark, SF))[0]
    out, model, names = segment.segment_customers(trips, n_init=2)
    model.save(str(tmp_path / "m"))
    again = kmeans.KMeansFit.load(str(tmp_path / "m"))
    assert sorted(again.prepare["medians"]) == sorted(names)
    x = segment.customer_vectors(customers.customer_features(trips), again.prepare)
    placed = segment.renumber_by_size(again.transform(x), "_pred", "s")
    assert placed.join(out, "customer_id").where("s <> customer_segment").count() == 0


def test_sums_reach_the_driver_once_per_centre(blobs, monkeypatch):
    """However few tasks there are, their sums are added up before they are collected."""
    x, df = blobs
    rows = df.select(kmeans.entries(df, "features").alias("v"))
    want = kmeans.pass_sums(rows.coalesce(1), [x[:3], x[5:9]], 1)
    monkeypatch.setattr(type(df), "toArrow", lambda self: pytest.fail("the sums of each task are sent to the driver"))
    for p, q in zip(kmeans.pass_sums(rows, [x[:3], x[5:9]], 5), want):
        assert p["n"].tolist() == q["n"].tolist() and np.allclose(p["s"], q["s"]) and p["cost"] == pytest.approx(q["cost"])


def test_blocks_hold_the_vectors(spark):
    """A pass over blocks, also of several mini-batches, finds what one over the rows finds."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((300, 50)) < 0.05, rng.normal(size=(300, 50)), 0.0)
    df = spark.createDataFrame([(Vectors.sparse(50, {int(j): float(r[j]) for j in np.flatnonzero(r)}),) for r in x], ["features"]).coalesce(1)
    rows = df.select(kmeans.entries(df, "features").alias("v"), (F.monotonically_increasing_id() / 100).cast("int").alias("batch"))
    held = kmeans.blocks(rows).persist()
    assert held.count() == 3 and {r.batch for r in held.collect()} == {0, 1, 2}
    a, b = kmeans.pass_sums(held, [x[:4]], 1)[0], kmeans.pass_sums(rows, [x[:4]], 1)[0]
    assert a["n"].tolist() == b["n"].tolist() and np.allclose(a["s"], b["s"]) and a["cost"] == pytest.approx(b["cost"])
    assert kmeans.pass_sums(held.where("batch = 1"), [x[:4]], 1)[0]["n"].sum() == 100
    whole = next(kmeans._each(held.toArrow().combine_chunks().to_batches(), whole=True))
    assert whole.n == 300 and np.allclose(np.stack([whole.row(i) for i in range(300)]), x)


def test_sizes_of_the_fit_number_the_segments(blobs):
    _, df = blobs
    fit = kmeans.fit_all(df, [4], n_init=2)[4]
    placed = fit.transform(df)
    a = segment.renumber_by_size(placed, "_pred", "s").collect()
    assert a == segment.renumber_by_size(placed, "_pred", "s", fit.stats["n"]).collect()
