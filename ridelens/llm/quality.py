"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

The features approximate a Gaussian kernel.  Ridge weights come from normal equations that are
summed over partitions by Spark, per fold; scores from the other folds' weights calibrate the
scores by isotonic regression.  Labels are used for training only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.stats import NAMES, document_stats
from ridelens.llm.words import pieces
from ridelens.session import cut_lineage

PART = 2 << 20
CLIP = 6.0
GRID = 1000


@dataclass
class QualityModel:
    """Standardisation, feature map, ridge weights and calibration curve.  Without training labels of
    both kinds ``weights`` is None and every score is ``prior``."""
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    curve: tuple[np.ndarray, np.ndarray]
    prior: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        z = np.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        return np.interp(self.features(stats) @ self.weights, *self.curve)


def held_out_fold(doc_id):
    """crc32 of the id as text modulo 5; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of every row of ``docs``, over whole texts."""
    def run(batches: Iterator[pa.RecordBatch]):
        for part in pieces(batches, size=PART):
            x = document_stats(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _rows(x)], names=["doc_id", "stats"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>")


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _normal_rows(model: QualityModel):
    """Per task and fold: the rows of Z'Z with Z'y as a last entry of each row."""
    m = len(model.phases) + 1

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold, y = b.column("fold").to_numpy(), b.column("y").to_numpy()
            for at in range(0, b.num_rows, 2048):
                cut = slice(at, at + 2048)
                z = model.features(_matrix(b.column("stats")[cut], len(NAMES)))
                for f in np.unique(fold[cut]).tolist():
                    pick = fold[cut] == f
                    zf = z[pick]
                    sums[f] = sums.get(f, 0) + zf.T @ np.hstack([zf, y[cut][pick, None]])
        for f, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, f, np.int64)), pa.array(np.arange(m, dtype=np.int32)), _rows(s)],
                                             names=["fold", "i", "row"])
    return run, "fold long, i int, row array<double>"


def fit_quality(stats: DataFrame, labels: DataFrame, n_features: int = 384, ridge: float = 1e-3, seed: int = 5,
                ) -> QualityModel:
    """Fits on the rows of ``stats`` that have a quality label and whose crc32 of the id modulo 5 is not 0.

    Several labels of one id are averaged, null labels and null ids are left out.
    """
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.avg("quality").alias("y"))
    train = stats.join(y, "doc_id").withColumn("fold", held_out_fold(F.col("doc_id"))).where("fold <> 0")
    train = cut_lineage(train)
    d = len(NAMES)
    size = train.agg(F.count("*").alias("n"), F.avg("y").alias("prior"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(d, n_features)) / np.sqrt(d / 2), rng.uniform(0, 2 * np.pi, n_features)
    prior = 0.5 if size.prior is None else float(size.prior)
    model = QualityModel(np.zeros(d), np.ones(d), directions, phases, None, (np.zeros(1), np.zeros(1)), prior)
    if not size.n or size.low == size.high:
        return model
    moments = train.select(Summarizer.metrics("mean", "std").summary(array_to_vector("stats")).alias("s")).select("s.mean", "s.std").first()
    std = moments["std"].toArray()
    model.mean, model.scale = moments["mean"].toArray(), np.where(std > 1e-9, std, 1.0)

    run, schema = _normal_rows(model)
    rows = train.select("fold", "y", "stats").mapInArrow(run, schema).groupBy("fold", "i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).toArrow().to_pylist()
    m = n_features + 1
    sums = {f: np.zeros((m, m + 1)) for f in {r["fold"] for r in rows}}
    for r in rows:
        sums[r["fold"]][r["i"]] = r["row"]
    total = sum(sums.values())

    def solve(s: np.ndarray) -> np.ndarray:
        penalty = np.eye(m) * ridge * max(s[-1, m - 1], 1.0)
        penalty[-1, -1] = 0
        return np.linalg.solve(s[:, :m] + penalty, s[:, m])

    model.weights = solve(total)
    others = {f: solve(total - s) if len(sums) > 1 else model.weights for f, s in sums.items()}

    def out_of_fold(batches):
        for b in batches:
            fold = b.column("fold").to_numpy()
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                z = model.features(_matrix(part.column("stats"), d))
                w = np.stack([others[f] for f in fold[at:at + 2048].tolist()])
                yield pa.RecordBatch.from_arrays([pa.array((z * w).sum(axis=1)), part.column("y")], names=["raw", "y"])

    grid = train.select("fold", "y", "stats").mapInArrow(out_of_fold, "raw double, y double").groupBy(
        (F.round(F.least(F.greatest("raw", F.lit(-2.0)), F.lit(3.0)) * GRID) / GRID).alias("features")).agg(
        F.avg("y").alias("label"), F.count("*").cast("double").alias("weight"))
    fitted = IsotonicRegression(featuresCol="features", weightCol="weight").fit(grid.coalesce(1))
    model.curve = _smooth(fitted.boundaries.toArray(), fitted.predictions.toArray())
    return model


def _smooth(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One knot per step of the isotonic fit, at its middle, so equal scores stay rare."""
    new = np.ones(len(x), bool)
    new[1:] = y[1:] != y[:-1]
    group = np.cumsum(new) - 1
    low = np.full(group[-1] + 1, np.inf)
    high = np.full(group[-1] + 1, -np.inf)
    np.minimum.at(low, group, x)
    np.maximum.at(high, group, x)
    y = np.clip(y[new], 0.0, 1.0)
    return np.concatenate([low[:1], (low + high) / 2, high[-1:]]), np.concatenate([y[:1], y, y[-1:]])


def score_statistics(stats: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for rows of ``statistics``."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column("stats"), len(NAMES))
            s = np.concatenate([model.score(x[i:i + 4096]) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])
    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores at least ``threshold``."""
    def run(batches):
        for part in pieces(batches, size=PART):
            good = model.score(document_stats(part.column(part.schema.get_field_index("text")))) >= threshold
            if good.any():
                yield part.filter(pa.array(good))
    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores every row of ``docs`` (``doc_id, text``): ``doc_id, held_out, score, predicted``.

    ``score`` estimates the share of label 1 among documents like it, from statistics of the whole
    text alone; ``predicted`` is 1 from ``threshold`` on.  Null and empty texts have all-zero
    statistics and get the score of these.  Ids without a label (null ids too) are scored as well.
    Repeated rows have equal scores; an empty table gives an empty result; without labels of both
    kinds all scores are their mean (0.5 without any).  Other columns are ignored.
    """
    stats = cut_lineage(statistics(docs))
    return score_statistics(stats, fit_quality(stats, labels), threshold)


