"""K-means for many starts and many k at once (SG1-SG3, SG5, SG10).

One pass over the rows serves every run, a run being a (start, k) pair.  A task turns its Arrow batches into sums
per run and centre; Spark adds them up; the k x d centres come back and go out again.  Runs that have converged take no
further part.  A pass is one job, however many runs there are.

Starting centres follow k-means||: in each round every start takes one row from each of its buckets, with
probability in proportion to the squared distance from the centres so far (the greatest log(u) / d2 wins, so
the total need not be known first).  The candidates of a start, weighted by the rows next to them, serve
all k: k-means++ and Lloyd's steps on these few points give the first centres.

Sparse vectors stay sparse: products and sums run over their entries alone.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 2
CELLS = 1 << 22
SPARSE_BELOW = 0.2
BATCHES = 20
#: Numbers that are worth a task of a pass.
PER_TASK = 1 << 19


# ---------------------------------------------------------------------------- rows
def entries(df: DataFrame, col: str) -> Column:
    """A vector or array column as ``struct(size, indices, values)``; ``indices`` is null for dense rows."""
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.when(F.col(col).isNotNull(), F.struct(F.size(col).alias("size"), F.lit(None).cast("array<int>").alias("indices"),
                                                       F.col(col).cast("array<double>").alias("values")))
    u = F.unwrap_udt(col)
    return F.when(F.col(col).isNotNull(), F.struct(F.coalesce(u["size"], F.size(u["values"])).alias("size"), u["indices"].alias("indices"),
                                                   u["values"].alias("values")))


def _compressed(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
    """Values, row bounds, places (None: all rows are dense) and size of the vectors of ``entries``."""
    values, indices = column.field("values"), column.field("indices")
    off = values.offsets.to_numpy()
    val = values.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
    ptr = (off - off[0]).astype(np.int64)
    size = np.diff(ptr)
    d = int(column.field("size")[0].as_py()) if len(size) else 0
    if indices.null_count == len(size):
        return val, ptr, None, d
    given = np.array(indices.is_valid())
    idx = np.arange(len(val), dtype=np.int64) - np.repeat(ptr[:-1], size)
    o = indices.offsets.to_numpy()
    idx[np.repeat(given, size)] = indices.values.to_numpy(zero_copy_only=False)[o[0]:o[-1]]
    return val, ptr, idx, d


class Rows:
    """A batch of vectors in compressed rows."""

    def __init__(self, val: np.ndarray, ptr: np.ndarray, idx: np.ndarray | None, d: int):
        self.val, self.ptr, self.n, self.d, self.dense = val, ptr, len(ptr) - 1, d, idx is None
        if not self.dense:
            self.idx = idx
            if len(self.val) >= SPARSE_BELOW * self.n * self.d:
                full = np.zeros((self.n, self.d))
                full[np.repeat(np.arange(self.n), np.diff(ptr)), idx] = self.val
                self.val, self.dense = full.ravel(), True
        if self.dense:
            self.full = self.val.reshape(self.n, self.d)

    def squares(self) -> np.ndarray:
        if self.dense:
            return np.einsum("ij,ij->i", self.full, self.full)
        return self._rows(self.val ** 2)

    def _rows(self, x: np.ndarray) -> np.ndarray:
        """Sums of entries (or rows of entries) per row."""
        some = np.flatnonzero(np.diff(self.ptr))
        out = np.zeros((self.n, *x.shape[1:]))
        if len(some):
            out[some] = np.add.reduceat(x, self.ptr[some], axis=0)
        return out

    def dot(self, centres: np.ndarray) -> np.ndarray:
        """Products of every row with every centre."""
        if self.dense:
            return self.full @ centres.T
        out = np.empty((self.n, len(centres)))
        step = max(1, CELLS // max(1, len(self.val)))
        for lo in range(0, len(centres), step):
            out[:, lo:lo + step] = self._rows(centres[lo:lo + step].T[self.idx] * self.val[:, None])
        return out

    def sums(self, labels: Sequence[np.ndarray], k: int) -> np.ndarray:
        """Vector sums per label, of ``k`` in all; every row has one label of each run, and no two runs share labels."""
        if self.dense:
            one = np.zeros((k, self.n))
            for label in labels:
                one[label, np.arange(self.n)] = 1.0
            return one @ self.full
        out = np.zeros(k * self.d)
        for label in labels:
            at = np.repeat(label, np.diff(self.ptr)) * self.d + self.idx
            lo = int(at.min(initial=0))
            part = np.bincount(at - lo, self.val)
            out[lo:lo + len(part)] += part
        return out.reshape(k, self.d)

    def weighted(self, weight: np.ndarray) -> np.ndarray:
        """Sum of all rows, each times its weight."""
        if self.dense:
            return weight @ self.full
        return np.bincount(self.idx, self.val * np.repeat(weight, np.diff(self.ptr)), self.d)

    def row(self, i: int) -> np.ndarray:
        if self.dense:
            return self.full[i]
        out = np.zeros(self.d)
        out[self.idx[self.ptr[i]:self.ptr[i + 1]]] = self.val[self.ptr[i]:self.ptr[i + 1]]
        return out


def _parts(column: pa.StructArray) -> Iterator[tuple]:
    """The vectors in parts of at most ``CELLS`` numbers if made dense."""
    if len(column):
        step = max(1, CELLS // max(1, int(column.field("size")[0].as_py())))
        for at in range(0, len(column), step):
            part = column.slice(at, step)
            yield _compressed(pa.StructArray.from_arrays(part.flatten(), fields=list(part.type)))


def _numbers(cell: pa.BinaryScalar, kind: type) -> np.ndarray:
    data = cell.as_buffer()
    return np.frombuffer(data, kind) if data.size else np.zeros(0, kind)


def _each(batches, whole: bool = False) -> Iterator[Rows]:
    """The vectors of batches of ``entries`` or of blocks; ``whole`` joins the blocks of different ``batch`` that came from one part."""
    def cells(b: pa.RecordBatch) -> Iterator[tuple]:
        for part, val, ptr, idx, d in zip(*(b.column(c) for c in ("part", "val", "ptr", "idx", "d"))):
            yield part.as_py(), (_numbers(val, np.float64), _numbers(ptr, np.int64), _numbers(idx, np.int32) if idx.is_valid else None, d.as_py())

    def found() -> Iterator[tuple]:
        for b in batches:
            yield from cells(b) if "v" not in b.schema.names else ((None, part) for part in _parts(b.column("v")))

    if not whole:
        yield from (Rows(*part) for _, part in found())
        return
    for key, same in itertools.groupby(found(), key=lambda f: f[0]):
        if key is None:
            yield from (Rows(*part) for _, part in same)
            continue
        val, ptr, idx, d = zip(*(part for _, part in same))
        ends = np.cumsum([0, *(p[-1] for p in ptr)])
        yield Rows(np.concatenate(val), np.concatenate([[0], *(p[1:] + e for p, e in zip(ptr, ends))]),
                   None if idx[0] is None else np.concatenate(idx), d[0])


_BLOCKS = "part long, batch int, val binary, ptr binary, idx binary, d int"


def blocks(x: DataFrame) -> DataFrame:
    """The vectors ``v`` in blocks: one row per Arrow batch (and per ``batch``, in whose order the rows of a task are, where ``x`` has
    that column), so a pass takes whole blocks from Spark and not row by row."""
    def run(batches):
        part = uuid.uuid4().int >> 66  # a task may run several partitions, whose parts must differ
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
        for b in batches:
            at = 0
            for val, ptr, idx, d in _parts(b.column("v")):
                n = len(ptr) - 1
                group = b.column("batch").to_numpy()[at:at + n] if "batch" in b.schema.names else np.zeros(n, np.int32)
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), n]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    own = slice(ptr[lo], ptr[hi])
                    row = [part, group[lo], val[own].tobytes(), (ptr[lo:hi + 1] - ptr[lo]).tobytes(),
                           None if idx is None else idx[own].astype(np.int32).tobytes(), d]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "batch", "val", "ptr", "idx", "d"])
                at, part = at + n, part + 1

    return x.mapInArrow(run, _BLOCKS)


def _in_tasks(held: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The blocks of ``size`` numbers in as many tasks as these are worth: a pass over a small input is then little more than its job."""
    tasks = max(1, min(held.rdd.getNumPartitions(), size // PER_TASK))
    return held.coalesce(tasks), tasks


def _size(x: DataFrame) -> int:
    return x.agg(F.sum("v.size")).first()[0] or 0


_SUMS = "at int, n long, q double, cost double, s array<double>"
_PICKS = "at int, key double, v array<double>"


def _totals(parts: DataFrame, tasks: int) -> dict[int, tuple[int, float, float, np.ndarray]]:
    """``{at: (n, q, cost, s)}`` summed over the tasks: one row per centre reaches the driver, however many tasks there are."""
    if tasks == 1:
        got = parts.toArrow()
        return {at: (n, q, cost, np.array(s)) for at, n, q, cost, s in zip(*(got[c].to_pylist() for c in ("at", "n", "q", "cost", "s")))}
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("cost").alias("cost"),
                                   vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).collect()
    return {r["at"]: (r["n"], r["q"], r["cost"], np.array(r["s"])) for r in rows}


def _sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    kind = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("q", pa.float64()), ("cost", pa.float64()), ("s", pa.list_(pa.float64()))])
    return pa.RecordBatch.from_pydict(dict(zip(kind.names, zip(*rows))), kind)


def _nearest(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = d2.argmin(axis=1)
    return label, np.maximum(d2[np.arange(len(d2)), label], 0.0)


def pass_sums(x: DataFrame, centres: Sequence[np.ndarray], tasks: int = 0) -> list[dict]:
    """One job: for each set of centres, per centre the number, vector sum and squared norms of its rows, and the cost."""
    sc = x.sparkSession.sparkContext
    held = sc.broadcast([np.asarray(c) for c in centres])  # runs x k x d numbers

    def run(batches):
        sets, got = held.value, None
        every = np.concatenate(sets)
        norm = np.einsum("ij,ij->i", every, every)
        bounds = np.append(0, np.cumsum([len(c) for c in sets]))
        for rows in _each(batches):
            got = got or [np.zeros(len(every), np.int64), np.zeros(len(every)), np.zeros(len(every)), np.zeros(every.shape)]
            n, sq, cost, s = got
            q, labels = rows.squares(), []
            d2 = q[:, None] - 2 * rows.dot(every) + norm
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                label, near = _nearest(d2[:, lo:hi])
                n[lo:hi] += np.bincount(label, minlength=hi - lo)
                sq[lo:hi] += np.bincount(label, q, hi - lo)
                cost[lo:hi] += np.bincount(label, near, hi - lo)
                labels.append(label + lo)
            s += rows.sums(labels, len(every))
        if got:
            n, sq, cost, s = got
            yield _sums_batch([(int(i), int(n[i]), float(sq[i]), float(cost[i]), s[i].tolist()) for i in np.flatnonzero(n)])

    found = _totals(x.mapInArrow(run, _SUMS), tasks)
    held.unpersist()
    out, lo = [], 0
    for c in centres:
        n, q, cost, s = np.zeros(len(c), np.int64), np.zeros(len(c)), 0.0, np.zeros(np.shape(c))
        for i in range(len(c)):
            if lo + i in found:
                n[i], q[i], more, s[i] = found[lo + i]
                cost += more
        out.append({"n": n, "q": q, "cost": cost, "s": s})
        lo += len(c)
    return out


# ---------------------------------------------------------------------------- starting centres
def _pick(x: DataFrame, sets: Sequence[np.ndarray | None], buckets: int, seed: Sequence[int]) -> list[np.ndarray]:
    """Per start and bucket one row, by its squared distance from the start's centres (evenly where it has none)."""
    held = x.sparkSession.sparkContext.broadcast(list(sets))

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        draws = [np.random.Generator(np.random.PCG64([*seed, s, part])) for s in range(len(held.value))]
        best: dict[int, tuple[float, list]] = {}
        for rows in _each(batches, whole=True):
            q = rows.squares()
            for s, have in enumerate(held.value):
                weight = np.ones(rows.n)
                if have is not None:
                    weight = _nearest(q[:, None] - 2 * rows.dot(have) + np.einsum("ij,ij->i", have, have))[1]
                    weight[weight <= 1e-12 * (q + 1)] = 0
                u, bucket = draws[s].random(rows.n), draws[s].integers(0, buckets, rows.n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    key = np.where(weight > 0, np.log(u) / weight, -np.inf)
                top = np.full(buckets, -np.inf)
                np.maximum.at(top, bucket, key)
                first = {int(bucket[i]): i for i in np.flatnonzero(key == top[bucket]) if key[i] > -np.inf}
                for i in first.values():
                    at = s * buckets + int(bucket[i])
                    if key[i] > -np.inf and (at not in best or key[i] > best[at][0]):
                        best[at] = (float(key[i]), rows.row(i).tolist())
        if best:
            kind = pa.schema([("at", pa.int32()), ("key", pa.float64()), ("v", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pydict({"at": list(best), "key": [b[0] for b in best.values()], "v": [b[1] for b in best.values()]}, kind)

    rows = x.mapInArrow(run, _PICKS).groupBy("at").agg(F.max_by("v", "key").alias("v")).orderBy("at").collect()
    held.unpersist()
    return [np.array([r["v"] for r in rows if r["at"] // buckets == s]) for s in range(len(sets))]


def _plus_plus(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ and Lloyd's steps on the few candidates of a start; at most ``k`` distinct centres."""
    at = [int(rng.choice(len(points), p=weight / weight.sum()))]
    d2 = ((points - points[at[0]]) ** 2).sum(1)
    while len(at) < k and (d2 * weight).sum() > 0:
        p = d2 * weight
        tries = rng.choice(len(points), size=2 + int(np.log(k)), p=p / p.sum())
        cost = [(np.minimum(d2, ((points - points[t]) ** 2).sum(1)) * weight).sum() for t in tries]
        at.append(int(tries[int(np.argmin(cost))]))
        d2 = np.minimum(d2, ((points - points[at[-1]]) ** 2).sum(1))
    centres = points[at]
    for _ in range(30):
        label = ((points[:, None, :] - centres) ** 2).sum(2).argmin(1)
        mass = np.bincount(label, weight, len(centres))
        moved = np.array([np.average(points[label == i], axis=0, weights=weight[label == i]) if mass[i] > 0 else centres[i]
                          for i in range(len(centres))])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def starting_centres(x: DataFrame, ks: Sequence[int], n_init: int, seed: int, tasks: int = 0) -> dict[tuple[int, int], np.ndarray]:
    """``{(start, k): centres}`` of vectors ``v``, or of their blocks in ``tasks`` tasks, in ``ROUNDS + 2`` jobs; empty without rows."""
    if "v" in x.columns:
        x, tasks = _in_tasks(blocks(x), _size(x))
    sets = _pick(x, [None] * n_init, 1, [seed, 0])
    if not all(len(s) for s in sets):
        return {}
    for r in range(ROUNDS):
        more = _pick(x, sets, 2 * max(ks), [seed, r + 1])
        sets = [np.concatenate([s, m]) if len(m) else s for s, m in zip(sets, more)]
    sets = [np.unique(s, axis=0) for s in sets]
    weights = [p["n"].astype(float) for p in pass_sums(x, sets, tasks)]
    return {(s, k): _plus_plus(sets[s], weights[s], k, np.random.Generator(np.random.PCG64([seed, s, k])))
            for s in range(n_init) for k in ks}


# ---------------------------------------------------------------------------- fits
@dataclass
class KMeansFit:
    """Centres of the best start for one k, its cost and, per centre, the sizes, sums and squared norms of its rows; ``prepare`` holds
    what made the vectors, where a caller sets it."""

    k: int
    centres: np.ndarray
    cost: float
    start: int
    iterations: int
    stats: dict = field(default_factory=dict, repr=False)
    prepare: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, features: str = "features", out: str = "_pred") -> DataFrame:
        return df.withColumn(out, nearest_centre(df, features, self.centres))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(i, c.tolist()) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "centre int, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        about = json.dumps({"k": self.k, "cost": self.cost, "start": self.start, "iterations": self.iterations,
                            "prepare": self.prepare})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> KMeansFit:
        spark = SparkSession.getActiveSession()
        rows = spark.read.parquet(f"{path}/centres").orderBy("centre").collect()
        return cls(centres=np.array([r["value"] for r in rows]), **json.loads(spark.read.text(f"{path}/about").first()[0]))


def nearest_centre(df: DataFrame, features: str, centres: np.ndarray) -> Column:
    """SG10: place of the nearest centre (squared Euclidean; ties -> the smaller place), null for a null vector.  An Arrow step
    over the vector column alone."""
    centres = np.asarray(centres, float)
    norm = np.einsum("ij,ij->i", centres, centres)

    @F.arrow_udf("int")
    def place(v: pa.Array) -> pa.Array:
        ok = np.array(v.is_valid())
        out = np.zeros(len(v), np.int32)
        some = v.filter(pa.array(ok))
        if len(some):
            batch = pa.RecordBatch.from_arrays([some], ["v"])
            out[ok] = np.concatenate([_exact(rows, centres, norm) for rows in _each([batch])])
        return pa.array(out, mask=~ok)

    return place(entries(df, features))


def _exact(rows: Rows, centres: np.ndarray, norm: np.ndarray) -> np.ndarray:
    if not rows.dense:
        return (norm - 2 * rows.dot(centres)).argmin(1)
    return np.stack([((rows.full - c) ** 2).sum(1) for c in centres], 1).argmin(1)


def fit_all(x: DataFrame, ks: Sequence[int], features: str = "features", seed: int = 42, n_init: int = 10, max_iter: int = 300,
            tol: float = 1e-4, batches: int | None = None) -> dict[int, KMeansFit]:
    """Best of ``n_init`` starts for every ``k``, by cost (ties: the smaller start).

    A run ends after ``max_iter`` passes or when its centres move by at most ``tol`` times the mean variance of
    the features (sum of squares).  With ``batches`` each run is a mini-batch k-means instead: every row
    belongs to one of so many random batches, each batch moves its centres by 1 / (rows that a centre has
    met so far) per row, and each row is used once.  Rows without a vector take no part; fewer distinct
    rows than k give fewer centres.  Without rows there is no fit.
    """
    ks = sorted(set(int(k) for k in ks))
    rows = x.select(entries(x, features).alias("v")).where("v is not null")
    if batches:
        # rows of a batch lie together, so a pass over one skips the cached blocks of the others
        rows = rows.withColumn("batch", F.floor(F.rand(seed) * batches).cast("int")).sortWithinPartitions("batch")
    held = blocks(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends = held.agg(F.sum(F.col("d") * (F.octet_length("ptr") / 8 - 1)).cast("long")).first()[0] or 0
        some, tasks = _in_tasks(held, ends)
        centres = starting_centres(some, ks, n_init, seed, tasks)
        if not centres:
            return {}
        runs = list(centres)
        if batches:
            used, seen = batches, {r: np.zeros(len(centres[r])) for r in runs}
            for b in range(batches):
                for r, p in zip(runs, pass_sums(some.where(F.col("batch") == b), [centres[r] for r in runs], tasks)):
                    seen[r] += p["n"]
                    got = p["n"] > 0
                    centres[r] = centres[r].copy()
                    centres[r][got] += (p["s"][got] - p["n"][got, None] * centres[r][got]) / seen[r][got, None]
            done = {r: used for r in runs}
        else:
            done, limit = {}, None
            for i in range(max_iter):
                active = [r for r in runs if r not in done]
                for r, p in zip(active, pass_sums(some, [centres[r] for r in active], tasks)):
                    if limit is None:
                        n, mean = p["n"].sum(), p["s"].sum(0) / p["n"].sum()
                        limit = tol * max(0.0, p["q"].sum() / n - float(mean @ mean)) / len(mean)
                    got, old = p["n"] > 0, centres[r]
                    centres[r] = old.copy()
                    centres[r][got] = p["s"][got] / p["n"][got, None]
                    if ((centres[r] - old) ** 2).sum() <= limit or i + 1 == max_iter:
                        done[r] = i + 1
                if len(done) == len(runs):
                    break
        final = dict(zip(runs, pass_sums(some, [centres[r] for r in runs], tasks)))
    finally:
        held.unpersist()
    best = {k: min((r for r in runs if r[1] == k), key=lambda r: (final[r]["cost"], r[0])) for k in ks}
    return {k: KMeansFit(k, centres[r], float(final[r]["cost"]), r[0], done[r], final[r]) for k, r in best.items()}


# ---------------------------------------------------------------------------- SG4 for several fits
def silhouettes(x: DataFrame, fits: dict[int, KMeansFit], features: str = "features") -> dict[int, float | None]:
    """Mean squared-Euclidean silhouette of each fit in one job; None with fewer than two segments that have rows.

    A row's mean distance to a segment follows from the segment's size, vector sum and squared norms."""
    able = {k: f for k, f in fits.items() if (f.stats["n"] > 0).sum() > 1}
    if not able:
        return {k: None for k in fits}
    held = x.sparkSession.sparkContext.broadcast([(f.centres, f.stats["n"], f.stats["q"], f.stats["s"]) for f in able.values()])

    def run(batches):
        total, count = np.zeros(len(held.value)), 0
        for rows in _each(batches):
            sq = rows.squares()
            count += rows.n
            for i, (c, n, q, s) in enumerate(held.value):
                label, _ = _nearest(sq[:, None] - 2 * rows.dot(c) + np.einsum("ij,ij->i", c, c))
                some = np.flatnonzero(n)
                far = np.full((rows.n, len(n)), np.inf)
                far[:, some] = np.maximum(sq[:, None] - 2 * rows.dot(s[some]) / n[some] + q[some] / n[some], 0.0)
                here = np.arange(rows.n)
                own = far[here, label] * n[label] / np.maximum(n[label] - 1, 1)
                far[here, label] = np.inf
                other = far.min(1)
                top = np.maximum(own, other)
                value = np.where((n[label] > 1) & (top > 0), (other - own) / np.where(top > 0, top, 1), 0.0)
                total[i] += value.sum()
        if count:
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int32), "total": total,
                                              "n": np.full(len(total), count, np.int64)})

    rows = x.select(entries(x, features).alias("v")).where("v is not null")
    found = {r["at"]: r["m"] for r in rows.mapInArrow(run, "at int, total double, n long").groupBy("at").agg(
        (F.sum("total") / F.sum("n")).alias("m")).collect()}
    held.unpersist()
    means = {k: float(found[i]) for i, k in enumerate(able)}
    return {k: means.get(k) for k in fits}
