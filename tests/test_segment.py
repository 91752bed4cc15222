import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ridelens.operators import segment
from ridelens.sources.tables import table

from .conftest import SF


def test_silhouette_matches_clustering_evaluator(spark):
    emb = table(spark, SF, "embeddings")
    ours = segment.silhouette(emb, "embedding", "label").first()["silhouette"]
    vec = emb.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
                     F.col("label").cast("double").alias("prediction"))
    theirs = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(vec)
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_kmeans_properties(spark):
    emb = table(spark, SF, "embeddings").select(array_to_vector("embedding").alias("features"))
    m1 = segment.fit_kmeans(emb, 4, n_init=2, max_iter=20)
    m2 = segment.fit_kmeans(emb, 4, n_init=2, max_iter=20)
    assert m1.cost == pytest.approx(m2.cost)
    lab = segment.renumber_by_size(m1.transform(emb), "_pred", "seg")
    sizes = [r["n"] for r in lab.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).orderBy("seg").collect()]
    assert sum(sizes) == emb.count() and sizes == sorted(sizes, reverse=True)
    assert {r.seg for r in lab.select("seg").distinct().collect()} <= set(range(4))
    costs = [segment.fit_kmeans(emb, k, n_init=3, max_iter=30).cost for k in (2, 6)]
    assert costs[1] <= costs[0]


def test_best_k_tie_takes_smaller_k(spark):
    ev = spark.createDataFrame([(2, 10.0, 0.5), (3, 8.0, 0.7), (4, 6.0, 0.7), (5, 5.0, None)],
                               "k int, inertia double, silhouette double")
    assert segment.best_k(ev).first().k == 3


def test_assign_nearest(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([10.0, 10.0],), ([5.0, 5.0],)], "v array<double>")
    out = [r.segment for r in segment.assign(df, "v", {0: [0.0, 0.0], 1: [10.0, 10.0]}).collect()]
    assert out == [0, 1, 0]  # the tie goes to the smaller id


def test_pca_variance_ordered(spark):
    emb = table(spark, SF, "embeddings")
    pcs = segment.pca_2d(emb, "embedding", "label")
    var = pcs.agg(F.var_pop("pc1").alias("a"), F.var_pop("pc2").alias("b"), F.avg("pc1").alias("m")).first()
    assert var.a >= var.b and abs(var.m) < 1e-6


def test_customer_segmentation_end_to_end(spark):
    from ridelens.plans import jobs
    from ridelens.sources.tables import dirty_bookings
    trips = jobs.clean_bookings(dirty_bookings(spark, SF))[0]
    out, model, names = segment.segment_customers(trips, k=3, n_init=2)
    assert out.count() == trips.where("customer_id IS NOT NULL").select("customer_id").distinct().count()
    assert {r.customer_segment for r in out.select("customer_segment").distinct().collect()} <= {0, 1, 2}
