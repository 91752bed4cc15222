"""Distributed dictionary encoding (FE6): each column's distinct values, numbered in sorted order.

The dictionary is a table, never a list on the driver or in a plan: distinct values are counted with map-side
aggregation, dealt out by ranges, and a value's number is its place within its range plus the
values in the ranges before it (one row per range and column goes through the driver).

A column is encoded by joins.  Values that hold more than a ``1 / BROADCAST_VALUES`` of all rows, of
which there are fewer than ``BROADCAST_VALUES``, go to the rows by broadcast (all values, if there are no more than
that); only rows with another value are shuffled, and none of those values is hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.session import cut_lineage

BROADCAST_VALUES = 50_000
BROADCAST_BYTES = 32 << 20


def _idx(c: str) -> str:
    return f"{c}__idx"


def ohe(c: str) -> str:
    """Name of the vector column of ``c``."""
    return f"{c}__ohe"


@dataclass
class Dictionary:
    """``table``: ``name, value, n, idx`` (``idx`` from 0 in the order of ``value``); ``widths``: values per column; ``sizes``: their
    bytes; ``rows``: rows that have a value."""

    table: DataFrame
    widths: dict[str, int]
    sizes: dict[str, int]
    rows: dict[str, int]

    def index(self, df: DataFrame, c: str, name: str, out: str) -> DataFrame:
        """``df`` with ``out``: the number of ``df[c]`` in column ``name`` of the dictionary, null for null and unseen values."""
        whole = self.table.where(F.col("name") == name).select(F.col("value").alias("_value"), F.col("idx").alias(out), "n")
        few = self.widths.get(name, 0) <= BROADCAST_VALUES
        frequent = whole if few else whole.where(F.col("n") > self.rows[name] // BROADCAST_VALUES)
        frequent = frequent.drop("n")
        if self.sizes.get(name, 0) <= BROADCAST_BYTES or not few:
            frequent = F.broadcast(frequent)
        found = df.join(frequent, F.col(c) == F.col("_value"), "left").drop("_value")
        if few:
            return found
        rest = whole.where(F.col("n") <= self.rows[name] // BROADCAST_VALUES).select("_value", F.col(out).alias("_rest"))
        # rows that are done, and nulls, get keys of their own that match nothing, so they spread over all tasks
        spread = F.concat(F.lit("\u0000"), (F.rand(17) * (1 << 30)).cast("int").cast("string"))
        keyed = found.withColumn("_key", F.when(F.col(out).isNull() & F.col(c).isNotNull(), F.col(c)).otherwise(spread))
        joined = keyed.join(rest, F.col("_key") == F.col("_value"), "left")
        return joined.withColumn(out, F.coalesce(out, "_rest")).drop("_key", "_value", "_rest")

    def transform(self, df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
        """FE6: a sparse one-hot vector ``<c>__ohe`` per column, as wide as the column has values; null and unseen values are all
        zeros.  ``names`` maps columns of ``df`` to columns of the dictionary."""
        names = dict(names or {c: c for c in self.widths})
        for c, name in names.items():
            df = self.index(df, c, name, _idx(c))
            width = self.widths.get(name, 0)
            # the slot after the last value stands for unseen ones and is the one that is dropped; the width is declared, so
            # the encoder reads no data
            meta = {"ml_attr": {"type": "nominal", "name": _idx(c), "num_vals": width + 1}}
            df = df.withColumn(_idx(c), F.coalesce(F.col(_idx(c)).cast("double"), F.lit(float(width))).alias(_idx(c), metadata=meta))
            df = OneHotEncoder(inputCol=_idx(c), outputCol=ohe(c), dropLast=True).fit(df).transform(df)
        return df.drop(*[_idx(c) for c in names])

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> Dictionary:
        return described(SparkSession.getActiveSession().read.parquet(path))


def described(table: DataFrame) -> Dictionary:
    """A dictionary with the sizes of its columns (one row per column comes back)."""
    rows = table.groupBy("name").agg(F.count("*").alias("k"), F.sum(F.octet_length("value") + 16).alias("b"), F.sum("n").alias("n")).collect()
    return Dictionary(table, *({r["name"]: r[x] for r in rows} for x in ("k", "b", "n")))


def fit_dictionary(df: DataFrame, cols: Sequence[str]) -> Dictionary:
    """Distinct non-null values of text columns, numbered per column in sorted order."""
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.explode(pairs).alias("kv")).select("kv.*").where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(counts.repartitionByRange(parts, "name", "value").sortWithinPartitions("name", "value").select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    base, before = [], {}
    blocks = ranged.groupBy("part", "name").agg(F.min("row").alias("first"), F.count("*").alias("k")).collect()
    for b in sorted(blocks, key=lambda b: b["part"]):
        base.append((b["part"], b["name"], before.get(b["name"], 0) - b["first"]))
        before[b["name"]] = before.get(b["name"], 0) + b["k"]
    # one row per range and column
    base = F.broadcast(spark.createDataFrame(base, "part int, name string, base long"))
    return described(cut_lineage(ranged.join(base, ["part", "name"]).select("name", "value", "n", (F.col("row") + F.col("base")).alias("idx"))))
