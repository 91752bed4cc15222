"""Principal components of wide and sparse rows (SG8): a block Krylov range finder.

Every pass multiplies the centred Gram matrix with a few directions: a task sums ``X'(X V)`` over its rows (over
their entries, where they are sparse), and the mean comes in as a rank-one correction, so no row is
centred, no dense row is written and no d x d matrix exists.  The directions so far span the search
space; the components in it stand when their residual is small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.operators.kmeans import PER_TASK, _each, entries

BLOCK = 12
PASSES = 40
TOL = 1e-10
#: Tasks whose sums the driver adds up without a shuffle.
FEW_TASKS = 32


def _products(x: DataFrame, v: np.ndarray | None, tasks: int) -> tuple[int, np.ndarray]:
    """One job: ``X'(X v)`` as rows, or the row count and the sum of all rows where ``v`` is None."""
    held = x.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        total, count = None, 0
        for rows in _each(batches):
            p = np.ones((rows.n, 1)) if held.value is None else rows.dot(held.value)
            part = np.stack([rows.weighted(p[:, j]) for j in range(p.shape[1])])
            total = part if total is None else total + part
            count += rows.n
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int32), "n": np.full(len(total), count, np.int64),
                                              "s": pa.array(total.tolist(), pa.list_(pa.float64()))})

    parts = x.mapInArrow(run, "at int, n long, s array<double>")
    if tasks > FEW_TASKS:
        parts = parts.groupBy("at").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    n, sums = 0, {}
    for r in parts.collect():  # a few rows of d numbers, per task of a few
        sums[r["at"]] = sums.get(r["at"], 0.0) + np.array(r["s"])
        n += r["n"] if r["at"] == 0 else 0
    held.unpersist()
    return n, np.stack([sums[i] for i in sorted(sums)]) if sums else np.zeros((0, 0))


def _fresh(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal rows for what ``new`` adds to the span of ``basis``; what is left of rounding is dropped."""
    least = 1e-9 * max(1e-300, np.linalg.norm(new, axis=1).max())
    for _ in range(2):  # the second time makes good what rounding left of the first
        new = new - (new @ basis.T) @ basis
        q, r = np.linalg.qr(new.T)
        new, least = q.T[np.abs(np.diag(r)) > least], 0.5
        if not len(new):
            break
    return new


def principal_components(df: DataFrame, vec: str, k: int = 2, block: int = BLOCK, passes: int = PASSES, tol: float = TOL,
                         seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(mean, components, variances)``: the ``k`` directions of greatest variance as rows, fewer where the rows span fewer, the
    largest loading of each positive.  Rows without a vector take no part; without rows all are empty."""
    x = df.select(entries(df, vec).alias("v")).where("v is not null").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tasks = max(1, min(x.rdd.getNumPartitions(), (x.agg(F.sum("v.size")).first()[0] or 0) // PER_TASK))
        rows = x.coalesce(tasks)
        n, total = _products(rows, None, tasks)
        if not n:
            return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
        mean = total[0] / n
        d = len(mean)
        basis, image = np.zeros((0, d)), np.zeros((0, d))
        new = np.random.Generator(np.random.PCG64(seed)).normal(size=(min(block, d), d))
        values = vectors = np.zeros(0)
        for _ in range(passes):
            new = _fresh(new, basis)[:d - len(basis)]
            if not len(new):
                break
            _, z = _products(rows, new, tasks)
            z = z - n * (new @ mean)[:, None] * mean
            basis, image = np.concatenate([basis, new]), np.concatenate([image, z])
            small = basis @ image.T
            values, mix = np.linalg.eigh((small + small.T) / 2)
            values, mix = values[::-1][:k], mix[:, ::-1][:, :k]
            vectors = mix.T @ basis
            miss = np.linalg.norm(mix.T @ image - values[:, None] * vectors, axis=1)
            if len(basis) == d or (miss <= tol * max(values[0], 1e-300)).all():
                break
            new = z
    finally:
        x.unpersist()
    some = values > 1e-12 * max(values[0], 1e-300) if len(values) else np.zeros(0, bool)
    vectors = vectors[some]
    largest = np.abs(vectors).argmax(1)
    vectors = vectors * np.where(vectors[np.arange(len(vectors)), largest] >= 0, 1.0, -1.0)[:, None]
    return mean, vectors, values[some] / n


def project(df: DataFrame, vec: str, mean: np.ndarray, components: np.ndarray, k: int) -> Column:
    """``array<double>`` of ``k`` coordinates (0 beyond the components), null for a null vector."""
    shift = components @ mean if len(components) else np.zeros(0)

    @F.arrow_udf("array<double>")
    def place(v: pa.Array) -> pa.Array:
        ok = np.array(v.is_valid())
        out = np.zeros((len(v), k))
        some = v.filter(pa.array(ok))
        if len(some) and len(components):
            got = [rows.dot(components) - shift for rows in _each([pa.RecordBatch.from_arrays([some], ["v"])])]
            out[ok, :len(components)] = np.concatenate(got)
        return pa.array([r if good else None for r, good in zip(out.tolist(), ok)], pa.list_(pa.float64()))

    return place(entries(df, vec))
