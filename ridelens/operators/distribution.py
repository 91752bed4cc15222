"""DI1-DI3: distribution checks over all rows, each one aggregate pass.

DI1 is re-aimed: the reference runs Shapiro-Wilk on at most 5,000 sampled rows; here the
Jarque-Bera test uses skewness and kurtosis of **all** rows (population moments, one
aggregate), p = exp(-JB / 2) (chi-square with 2 degrees of freedom).  Same result schema.
``shapiro_francia`` is the statistic on ranks, of all rows too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.session import cut_lineage

# Fixed value: the significance level of the reference's normality check.
ALPHA = 0.05
#: Ranks of one value that a task scores at a time.
RANKS = 100_000
#: Bins of the density per bandwidth.
BINS_PER_H = 40


def normality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature, n, skewness, kurtosis, jb, p_value, is_normal`` per column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.skewness(x).alias(f"{c}__s"), F.kurtosis(x).alias(f"{c}__k")]
    wide = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__n").alias("n"),
                               F.col(f"{c}__s").alias("skewness"), F.col(f"{c}__k").alias("kurtosis")) for c in cols])
    long = wide.select(F.explode(pairs).alias("p")).select("p.*")
    jb = F.col("n") / 6.0 * (F.pow("skewness", 2) + F.pow("kurtosis", 2) / 4.0)
    return (long.withColumn("jb", jb)
            .withColumn("p_value", F.exp(-F.col("jb") / 2.0))
            .withColumn("is_normal", F.col("p_value") > F.lit(ALPHA)))


def _scores(batches):
    """Sum of the normal scores, and of their squares, of ``k`` ranks from ``first`` (of ``n``; Blom's places)."""
    score = NormalDist().inv_cdf
    for b in batches:
        sums, squares = [], []
        for first, k, n in zip(*(b.column(c).to_pylist() for c in ("first", "k", "n"))):
            m = [score((r - 0.375) / (n + 0.25)) for r in range(first, first + k)]
            sums.append(math.fsum(m))
            squares.append(math.fsum(x * x for x in m))
        yield pa.RecordBatch.from_arrays([b.column("feature"), b.column("v"), pa.array(sums, pa.float64()), pa.array(squares, pa.float64())],
                                         ["feature", "v", "m", "mm"])


def shapiro_francia(df: DataFrame, cols: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """DI1 on ranks: ``feature, n, w, p_value, is_normal`` over **all** rows.

    ``w`` is the squared correlation of the ordered values with normal scores; p by Royston's normal approximation (made for
    5 to 5,000 values, carried on beyond).  Distinct values are counted and dealt out by ranges; a value's ranks follow from
    the counts before it (one row per range and column goes through the driver).  The ranks of a frequent value are cut
    into chunks of ``RANKS`` that are dealt out again.  Nulls and NaNs take no part; fewer than 5 values or
    no spread give a null p.
    """
    spark = df.sparkSession
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    counts = df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null and not isnan(v)").groupBy("feature", "v").agg(F.count("*").alias("c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = cut_lineage(counts.repartitionByRange(parts, "feature", "v").withColumn("part", F.spark_partition_id()))
    before, base = {}, []
    for b in sorted(held.groupBy("part", "feature").agg(F.sum("c").alias("c")).collect(), key=lambda b: b["part"]):
        base.append((b["part"], b["feature"], before.get(b["feature"], 0)))
        before[b["feature"]] = before.get(b["feature"], 0) + b["c"]
    if not base:
        return spark.createDataFrame([], "feature string, n long, w double, p_value double, is_normal boolean")
    total = F.create_map(*[x for f, n in before.items() for x in (F.lit(f), F.lit(n))])
    upto = F.sum("c").over(Window.partitionBy("part", "feature").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = held.withColumn("upto", upto).join(F.broadcast(spark.createDataFrame(base, "part int, feature string, base long")), ["part", "feature"])
    ranked = ranked.select("feature", "v", "c", (F.col("base") + F.col("upto") - F.col("c") + 1).alias("rank"), total[F.col("feature")].alias("n"))
    chunks = ranked.select("feature", "v", "c", "rank", "n", F.explode(F.expr(f"sequence(0L, (c - 1) div {RANKS})")).alias("i"))
    chunks = chunks.select("feature", "v", (F.col("rank") + F.col("i") * RANKS).alias("first"),
                           F.least(F.lit(RANKS), F.col("c") - F.col("i") * RANKS).alias("k"), "n").repartition("feature", "v", "first")
    scored = chunks.mapInArrow(_scores, "feature string, v double, m double, mm double").groupBy("feature").agg(
        F.sum(F.col("v") * F.col("m")).alias("vm"), F.sum("mm").alias("mm"))
    mean = held.groupBy("feature").agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    spread = held.join(F.broadcast(mean), "feature").groupBy("feature").agg(F.sum(F.pow(F.col("v") - F.col("mean"), 2) * F.col("c")).alias("ss"))
    n = F.col("n").cast("double")
    both = scored.join(spread, "feature").withColumn("n", total[F.col("feature")])
    # Royston's (1993) approximation of the distribution of log(1 - w)
    u = F.log(n)
    mu, sigma = 1.0521 * (F.log(u) - u) - 1.2725, 1.0308 - 0.26758 * (F.log(u) + 2 / u)
    w = F.least(F.pow("vm", 2) / (F.col("mm") * F.col("ss")), F.lit(1.0))
    both = both.withColumn("w", F.when((F.col("n") >= 5) & (F.col("ss") > 0), w))
    z = F.when(F.col("w") < 1, (F.log(1 - F.col("w")) - mu) / sigma)

    @F.arrow_udf("double")
    def upper_tail(z: pa.Array) -> pa.Array:
        return pa.array([None if x is None else 0.5 * math.erfc(x / math.sqrt(2)) for x in z.to_pylist()], pa.float64())

    return both.withColumn("p_value", upper_tail(z)).select("feature", "n", "w", "p_value", (F.col("p_value") > alpha).alias("is_normal"))


def _range(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    r = df.agg(F.min(F.col(col).cast("double")).alias("lo"), F.max(F.col(col).cast("double")).alias("hi")).first()
    return r["lo"], r["hi"]


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """DI2: equal-width bins between min and max (two numbers come back first);
    ``bin`` 1..bins, empty ones with ``n`` 0; the maximum falls into the last bin."""
    lo, hi = _range(df, col)
    x = F.col(col).cast("double")
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("hi"), "n"))


def _scott(df: DataFrame, col: str) -> tuple[float, float, int, float] | None:
    """Smallest and largest value, their number and Scott's bandwidth std * n^(-1/5); None without a spread."""
    x = F.col(col).cast("double")
    st = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n")).first()
    if not st["n"] or not st["sd"]:
        return None
    return st["lo"], st["hi"], st["n"], st["sd"] * st["n"] ** (-1.0 / 5.0)


def kde(df: DataFrame, col: str, points: int = 50, exact: bool = True) -> DataFrame:
    """DI3: Gaussian density at ``points`` grid values over [min, max], Scott bandwidth, over **all** rows: one sum of the
    kernel per grid point.

    ``exact=False`` does with one kernel per bin: each row is shared between the two nearest of evenly spaced
    bins, by its distance from them, in one aggregate.  The bins are at most h / ``BINS_PER_H`` wide (h: the
    bandwidth), which keeps the error of a density below 0.4 / h / (8 BINS_PER_H^2), less than 8e-5 of its greatest
    possible value 0.4 / h."""
    found = _scott(df, col)
    if found is None:
        return df.sparkSession.createDataFrame([], "x double, density double")
    lo, hi, n, h = found
    x = F.col(col).cast("double")
    bins = max(1, math.ceil((hi - lo) / h * BINS_PER_H))
    width = (hi - lo) / bins
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    if exact:
        places = df.where(x.isNotNull()).select(x.alias("v"), F.lit(1.0).alias("w"))
    else:
        at = (x - F.lit(lo)) / F.lit(width)
        low = F.least(F.floor(at), F.lit(bins - 1))
        shares = F.array(F.struct(low.alias("bin"), (low + 1 - at).alias("w")), F.struct((low + 1).alias("bin"), (at - low).alias("w")))
        places = df.where(x.isNotNull()).select(F.explode(shares).alias("s")).groupBy("s.bin").agg(F.sum("s.w").alias("w"))
        places = places.select((F.lit(lo) + F.col("bin") * F.lit(width)).alias("v"), "w")
    sums = places.agg(*[F.sum(F.col("w") * F.exp(-F.pow((F.lit(g) - F.col("v")) / F.lit(h), 2) / 2.0)).alias(f"g{i}")
                        for i, g in enumerate(grid)])
    pairs = F.array(*[F.struct(F.lit(g).alias("x"), (F.col(f"g{i}") * F.lit(norm)).alias("density"))
                      for i, g in enumerate(grid)])
    return sums.select(F.explode(pairs).alias("p")).select("p.*")
