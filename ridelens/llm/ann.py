"""Approximate nearest neighbours by stable projections and a kd-tree.

Unit vectors are projected on a few Gaussian (2-stable) directions: the squared projected length of a
difference, divided by its squared true length, is chi-square distributed.  A kd-tree over the
projections of each index shard gives the neighbours of a query in order of projected distance; they are
verified on the original vectors until a chi-square test says that an unseen row closer than the
k-th best would, with the wanted probability, have been seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
BLOCK_QUERIES = 2_048
LEAF = 32


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """For an even number ``m`` of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(np.isfinite(half), 1 - np.exp(-half) * total, 1.0)


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Leaves of a kd-tree: each split halves a cell along its widest side."""
    cells, leaves = [np.arange(len(points))], []
    while cells:
        cell = cells.pop()
        if len(cell) <= leaf:
            leaves.append(cell)
            continue
        p = points[cell]
        axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
        half = len(cell) // 2
        order = np.argpartition(p[:, axis], half)
        cells += [cell[order[:half]], cell[order[half:]]]
    return leaves


class ProjectedTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors ** 2).sum(axis=1))
        self.directions = directions
        points = (vectors / self.norms[:, None]) @ directions
        self.leaves = kd_leaves(points)
        self.low = np.array([points[c].min(axis=0) for c in self.leaves])
        self.high = np.array([points[c].max(axis=0) for c in self.leaves])

    def search(self, query_id: int, q: np.ndarray, k: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best ``k`` rows (all, if fewer) besides rows of the query's id."""
        norm = np.sqrt((q ** 2).sum())
        p = (q / norm) @ self.directions
        gap = np.maximum(0, np.maximum(self.low - p, p - self.high))
        reach = (gap ** 2).sum(axis=1)  # squared projected distance from which each leaf's rows start
        order = np.argsort(reach, kind="stable")
        ids, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(order):
            if len(ids) == k:
                far = max(2 - 2 * scores[-1], 1e-12)  # equal vectors differ by rounding only
                if chi_square_cdf(reach[order[at]] / far, len(p)) >= sure:
                    break
            rows = np.concatenate([self.leaves[i] for i in order[at:at + step]])
            rows = rows[self.ids[rows] != query_id]
            cosine = (self.vectors[rows] * q).sum(axis=1) / (self.norms[rows] * norm)
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, cosine])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            at, step = at + step, min(step * 2, 64)
        return ids, scores


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, projections: int = 8, sure: float = 0.98,
                       seed: int = 3) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row whose ``vec_id`` is divisible
    by ``every``, by largest cosine (double precision, original vectors), ties to the smaller vec_id.

    ``vectors`` has ``vec_id, embedding``.  Rows with a null id, and vectors that are null, empty, zero or
    hold a null or non-finite component take no part.  Rows equal in id and vector count once; a
    query never meets a row of its own id, and vectors of different length never meet.  With fewer
    than ``k`` candidates all are returned; an empty table gives an empty result.  Other columns
    are ignored.

    Index rows are dealt to shards of about ``SHARD_ROWS`` by a hash of the whole row and queries to
    blocks of about ``BLOCK_QUERIES``; each task holds one shard and one block.
    """
    if projections % 2:
        raise ValueError("the number of projections must be even")
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
            .where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
            .where(F.exists("x", lambda v: v != 0)).dropDuplicates(["vec_id", "x"]))
    size = rows.agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).first()
    shards = max(1, -(-int(size.n or 0) // SHARD_ROWS))
    blocks = max(1, -(-int(size.q or 0) // BLOCK_QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.withColumn("shard", deal(shards)).withColumn("block", every_of(blocks)).withColumn("query", F.lit(False))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("shard", every_of(shards)).withColumn(
        "block", deal(blocks)).withColumn("query", F.lit(True))
    both = index.unionByName(asked).withColumn("width", F.size("x"))

    def search(group: pa.Table) -> pa.Table:
        width = group["width"][0].as_py()
        ids = group["vec_id"].to_numpy()
        x = group["x"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        is_query = group["query"].to_numpy(zero_copy_only=False).astype(bool)
        out: list = []
        if is_query.any() and not is_query.all():
            directions = np.random.default_rng(seed).normal(size=(width, projections))
            tree = ProjectedTree(ids[~is_query], x[~is_query], directions)
            for i in np.flatnonzero(is_query):
                out.append((ids[i], *tree.search(ids[i], x[i], k, sure)))
        return pa.table({"query_id": pa.array(np.concatenate([np.full(len(f), q) for q, f, _ in out]) if out else [], pa.int64()),
                         "vec_id": pa.array(np.concatenate([f for _, f, _ in out]) if out else [], pa.int64()),
                         "score": pa.array(np.concatenate([s for *_, s in out]) if out else [], pa.float64())})

    found = both.groupBy("shard", "block", "width").applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
