"""Heavy hitters of a join key, and a join that salts them (JN1)."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the summary: every key with more than 2 / COUNTERS of the rows is found.
COUNTERS = 256


def _shrunk(counts: Counter, k: int) -> Counter:
    """Misra-Gries: with more than ``k`` counters, all lose the value of the (k + 1)-th largest."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({key: n - cut for key, n in counts.items() if n > cut})


def heavy_keys(df: DataFrame, key: Column, k: int = COUNTERS) -> list[str]:
    """Keys (as text) with at least about ``1 / k`` of the non-null keys, at most ``k``; none with ``2 / k`` or more is left out.

    Each task keeps ``k`` counters, whatever it reads; their sums over the tasks fall short of the true counts by less
    than 1 / k of all, so one scan of the key column and at most k rows per task are enough."""
    def run(batches):
        counts: Counter = Counter()
        rows = 0
        for b in batches:
            got = pc.value_counts(b.column(0).drop_null())
            rows += b.num_rows - b.column(0).null_count
            for v, n in zip(got.field("values").to_pylist(), got.field("counts").to_pylist()):
                counts[v] += n
            counts = _shrunk(counts, k)
        yield pa.RecordBatch.from_pydict({"key": pa.array([None, *counts], pa.string()), "n": pa.array([rows, *counts.values()], pa.int64())})

    sums = df.select(key.cast("string").alias("key")).mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = sums.where("key is null").first()
    least = max(2, -(-(total["n"] if total else 0) // k))
    return [r["key"] for r in sums.where(F.col("key").isNotNull() & (F.col("n") >= least)).collect()]  # at most k


def left_join(left: DataFrame, right: DataFrame, key: Column, on: str, k: int = COUNTERS) -> DataFrame:
    """``left`` with the columns of ``right`` where ``key`` (of ``left``) equals the text column ``on``; unmatched rows keep nulls.

    Rows of a heavy key get a random salt and meet one of as many copies of its rows in ``right``; rows without a key
    join nothing and are not shuffled at all; all others join plainly."""
    heavy = heavy_keys(left, key, k)
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = right.where(F.col(on).isNotNull())
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != on]
    text = key.cast("string")
    none = left.where(key.isNull()).select("*", *extra)
    is_heavy = text.isin(heavy) if heavy else F.lit(False)
    plain = left.where(key.isNotNull() & ~is_heavy).withColumn("_key", text)
    out = none.unionByName(plain.join(right.where(~F.col(on).isin(heavy)) if heavy else right, F.col("_key") == F.col(on), "left").drop("_key", on))
    if not heavy:
        return out
    hot = left.where(is_heavy).withColumns({"_key": text, "_salt": F.floor(F.rand(29) * salts).cast("int")})
    copies = right.where(F.col(on).isin(heavy)).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = hot.join(copies, (F.col("_key") == F.col(on)) & (F.col("_salt") == F.col("_copy")), "left")
    return out.unionByName(met.drop("_key", "_salt", "_copy", on))
