"""Segmentation: k-means fits and the measures around them (SG1-SG10).

* Fitting runs every start (and every k) in the same passes over a persisted vector frame (``kmeans``); the
  best start by cost stands.  Segments are renumbered by size (largest = 0) so runs
  compare; the reference keeps arbitrary labels.
* Centres are k x d numbers: they are the only thing collected (bounded by k and the feature
  count, never by the rows).
* Silhouette (SG4) is the linear squared-Euclidean form of ``ClusteringEvaluator``; the all-pairs
  Euclidean form is not built (it would emit every pair of rows).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.operators import clean, customers, encode, pca
from ridelens.operators.kmeans import BATCHES, KMeansFit, fit_all, nearest_centre, silhouettes
from ridelens.session import cut_lineage


# ---------------------------------------------------------------------------- centres & distances
def _as_vector(df: DataFrame, vec: str):
    return (array_to_vector(F.col(vec).cast("array<double>")) if dict(df.dtypes)[vec].startswith("array")
            else F.col(vec))


def cluster_stats(df: DataFrame, vec: str, label: str) -> list:
    """Per label: count, sum of squared norms and the vector sum -- one grouped aggregate
    (``Summarizer``), no expansion of rows into dimensions; k rows come back."""
    from pyspark.ml.stat import Summarizer

    v = _as_vector(df, vec)
    arr = vector_to_array(v)
    return (df.select(F.col(label).alias("_l"), v.alias("_v"),
                      F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x).alias("_q"))
            .groupBy("_l").agg(F.count(F.lit(1)).alias("n"), F.sum("_q").alias("q"),
                               Summarizer.sum(F.col("_v")).alias("s"))
            .collect())


def centres_from_labels(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Mean vector per label in long form ``label, dim, value`` (k x d rows).  The means come
    from one grouped ``Summarizer`` aggregate; only its k result rows are exploded."""
    from pyspark.ml.stat import Summarizer

    means = df.groupBy(label).agg(Summarizer.mean(_as_vector(df, vec)).alias("_m"))
    return means.select(label, F.posexplode(vector_to_array("_m")).alias("dim", "value"))


def collect_centres(long: DataFrame, label: str) -> dict[int, list[float]]:
    rows = long.collect()  # k x d values
    out: dict[int, dict[int, float]] = {}
    for r in rows:
        out.setdefault(r[label], {})[r["dim"]] = r["value"]
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def assign(df: DataFrame, vec: str, centres: dict[int, list[float]], out: str = "segment") -> DataFrame:
    """SG10: nearest centre per row (squared Euclidean; ties -> smaller centre id)."""
    ids = sorted(centres)
    place = nearest_centre(df, vec, [centres[i] for i in ids])
    return df.withColumn(out, F.element_at(F.array(*[F.lit(int(i)) for i in ids]), place + 1))


def centroid_range(centres_long: DataFrame, label: str = "label", n: int = 30,
                   features: DataFrame | None = None) -> DataFrame:
    """SG7: max - min of each centre coordinate across segments; top ``n`` (ties by name).  ``features`` names the coordinates
    (``position, feature``, as ``Encoder.feature_table``); without it they are ``f0, f1, ...``."""
    ranges = centres_long.groupBy("dim").agg((F.max("value") - F.min("value")).alias("range_across_clusters"))
    ranges = (ranges.withColumn("feature", F.concat(F.lit("f"), F.col("dim").cast("string"))) if features is None
              else ranges.join(features, F.col("dim") == F.col("position")))
    return (ranges.select("feature", "range_across_clusters")
            .orderBy(F.desc("range_across_clusters"), "feature").limit(n))


# ---------------------------------------------------------------------------- SG4
def silhouette(df: DataFrame, vec: str, label: str) -> DataFrame:
    """SG4: mean silhouette with squared Euclidean distance, by ``ClusteringEvaluator``; null with fewer than
    two labels.  Rows without a vector or label take no part."""
    rows = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(
        _as_vector(df, vec).alias("_v"), F.col(label).cast("double").alias("_l"))
    value = None
    if rows.select("_l").distinct().limit(2).count() == 2:
        value = ClusteringEvaluator(featuresCol="_v", predictionCol="_l").evaluate(rows)
    return df.sparkSession.createDataFrame([(value,)], "silhouette double")


def labelled_cost(df: DataFrame, vec: str, label: str) -> float:
    """Inertia of given labels: sum of squared distances to the label means
    = sum |x|^2 - sum_C |S_C|^2 / N_C (k rows of sums come back, never the rows)."""
    stats = cluster_stats(df, vec, label)
    total = sum(r["q"] for r in stats)
    return float(total - sum(float(r["s"].dot(r["s"])) / r["n"] for r in stats))


def best_k(evaluation: DataFrame) -> DataFrame:
    """SG6: the row with the greatest silhouette; ties -> the smaller k."""
    best = F.max(F.struct(F.col("silhouette"), (-F.col("k")).alias("nk"), F.col("inertia")))
    return evaluation.where(F.col("silhouette").isNotNull()).agg(best.alias("b")).select(
        (-F.col("b.nk")).cast("int").alias("k"), F.col("b.inertia").alias("inertia"),
        F.col("b.silhouette").alias("silhouette"))


# ---------------------------------------------------------------------------- SG1 / SG2 / SG3 / SG5
def fit_kmeans(x: DataFrame, k: int, features: str = "features", seed: int = 42, n_init: int = 10,
               max_iter: int = 300, tol: float = 1e-4) -> KMeansFit:
    """Best of ``n_init`` starts, all fitted in the same passes (``kmeans.fit_all``)."""
    return fit_all(x, [k], features, seed, n_init, max_iter, tol)[k]


def renumber_by_size(labelled: DataFrame, pred: str, out: str, sizes: Sequence[int] | None = None) -> DataFrame:
    """Largest segment -> 0, then by size (ties by old id).  Only k sizes come back; ``sizes`` of the old ids, where the fit of these
    very rows has counted them, spare the pass."""
    if sizes is None:
        found = {r[pred]: r["n"] for r in labelled.groupBy(pred).agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        found = {i: int(n) for i, n in enumerate(sizes)}
    order = sorted(found, key=lambda p: (-found[p], p))
    mapping = F.create_map(*[x for new, p in enumerate(order) for x in (F.lit(p), F.lit(new))])
    return labelled.withColumn(out, mapping[F.col(pred)].cast("int")).drop(pred)


def customer_vectors(feats: DataFrame, prepare: Mapping[str, Mapping], key: str = "customer_id") -> DataFrame:
    """``key, features``: AG1 features imputed and scaled with fitted parameters (``KMeansFit.prepare``, also of a loaded model)."""
    scale = {c: tuple(p) for c, p in prepare["scale"].items()}
    scaled = encode.apply_scale(encode.apply_fill(feats, prepare["medians"]), scale)
    return VectorAssembler(inputCols=list(scale), outputCol="features").transform(scaled.select(key, *scale)).select(key, "features")


def segment_customers(trips: DataFrame, k: int = 3, seed: int = 42, n_init: int = 10,
                      key: str = "customer_id") -> tuple[DataFrame, KMeansFit, list[str]]:
    """SG2: AG1 features -> median imputer (IM6) -> standard scaler (FE5) -> k-means.  The rows hold the
    features as they are, the imputed and scaled vector ``features`` and ``customer_segment``.  The model carries the imputer and the
    scaler (``prepare``) and saves them, so new customers can be placed with ``customer_vectors``."""
    feats = customers.customer_features(trips, key)
    names = list(customers.CUSTOMER_FEATURES)
    feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    medians = {c: m for c, m in encode.fit_median(feats, names).items() if m is not None}
    present = [c for c in names if c in medians]
    prepare = {"medians": medians, "scale": encode.fit_standard(encode.apply_fill(feats, medians), present)}
    x = customer_vectors(feats, prepare, key).persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_kmeans(x, k, seed=seed, n_init=n_init)
    labelled = renumber_by_size(model.transform(x).select(key, "features", "_pred"), "_pred", "customer_segment")
    model.prepare = prepare
    out = cut_lineage(feats.join(labelled, key))
    x.unpersist()
    feats.unpersist()
    return out, model, present


def segment_trips(df: DataFrame, k: int = 3, completed_only: bool = False, min_value: float | None = None,
                  seed: int = 42, n_init: int = 10, encoder: encode.Encoder | None = None,
                  key: str = "booking_id") -> tuple[DataFrame, KMeansFit, encode.Encoder]:
    """SG1: filters (FL5/FL6) -> encoder (FE7) -> k-means -> ``trip_segment`` on every row."""
    rows = clean.segmentation_input(df, completed_only, min_value)
    enc = encoder or encode.fit_encoder(df)
    x = enc.transform(rows)
    model = fit_kmeans(x, k, seed=seed, n_init=n_init)  # holds the vectors as long as it reads them
    labelled = renumber_by_size(model.transform(x), "_pred", "trip_segment", model.stats["n"])
    return labelled, model, enc


def sample_for_evaluation(x: DataFrame, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """SG3's sampling step, only where a ``fraction`` is asked for; all rows otherwise, however many."""
    return x if fraction is None or not 0 < fraction < 1 else x.sample(False, fraction, seed)


def evaluate_k(x: DataFrame, ks: Sequence[int] = range(2, 9), features: str = "features", seed: int = 42,
               n_init: int = 10, fast: bool = False, sample_fraction: float | None = None) -> DataFrame:
    """SG3 / SG5: inertia and silhouette per k, all starts and all k in the same passes over all rows.  ``fast=True`` fits by
    mini-batches (each row moves the centres once).  Result: ``k, inertia, silhouette``."""
    x = sample_for_evaluation(x, sample_fraction, seed=seed)
    fits = fit_all(x, ks, features, seed, n_init, batches=BATCHES if fast else None)
    measured = silhouettes(x, fits, features)
    rows = [(int(k), f.cost, measured[k]) for k, f in fits.items()]
    return x.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


# ---------------------------------------------------------------------------- SG8
def pca_2d(df: DataFrame, vec: str, label: str | None = None) -> DataFrame:
    """SG8: centred 2-D PCA coordinates (``pc1, pc2``), sign fixed so the largest loading is positive; see ``pca``."""
    mean, components, _ = pca.principal_components(df, vec)
    out = df.withColumn("_p", pca.project(df, vec, mean, components, 2))
    keep = [label] if label else []
    return out.select(*keep, F.col("_p")[0].alias("pc1"), F.col("_p")[1].alias("pc2"))
