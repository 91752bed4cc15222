"""Connected components as DataFrame joins, and a bounded membership filter for map tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.session import cut_lineage, release

#: Bits of the membership filter: its size is fixed, whatever the number of keys.
FILTER_BITS = 26
EDGES_PER_TASK = 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of an edge table, by alternating
    large-star and small-star rounds.  Each round is two grouped minima joined back; a node with
    very many edges is pre-aggregated in the map tasks and its join rows can be split.  Lineage
    is cut by a checkpoint after each round, and the round's plans and shuffle files go.  Loops and null ends are ignored.  Up to ``EDGES_PER_TASK``
    edges, the rounds are one task without a shuffle (``_round_in_task``).
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    state = _state(e)
    if 0 < state[0] <= EDGES_PER_TASK:
        # the rows are counted, so the limit drops none: it is for the planner's estimate, which is a product of all joins behind
        # the edges, so that even a single partition counts as too large and is shuffled
        e = cut_lineage(e.coalesce(1).limit(state[0]))
        while True:
            e = cut_lineage(_round_in_task(_round_in_task(e)))
            now = _state(e.coalesce(1))
            release(e.sparkSession)
            if now == state:
                return _members(e)
            state = now
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < w").select(F.col("w").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        # a small edge table needs few tasks in the next round; there are never more edges than before
        e = cut_lineage(small.where("u <> v").distinct().coalesce(max(1, state[0] // EDGES_PER_TASK)))
        now = _state(e)
        release(e.sparkSession)
        if now == state:
            break
        state = now
    return _members(e)


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` as ``components`` gives them for the edges of ``parts`` (its result) and ``links`` (``a, b``) together:
    the links are searched between whole components, so edges that are joined already are not gone through again."""
    own = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"in_{x}"))
    between = links.select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left").select(
        F.coalesce("in_a", "a").alias("a"), F.coalesce("in_b", "b").alias("b"))
    top = cut_lineage(components(between).select(F.col("node").alias("low"), F.col("component").alias("lowest")))
    moved = parts.join(top, F.col("component") == F.col("low"), "left").select("node", F.coalesce("lowest", "component").alias("component"))
    new = top.join(parts, F.col("low") == F.col("node"), "left_anti").select(F.col("low").alias("node"), F.col("lowest").alias("component"))
    return moved.unionByName(new)


def _members(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _round_in_task(e: DataFrame) -> DataFrame:
    """A large-star and a small-star round on the edges of one task: minima by windows instead of joins, so the edges are read
    once and sorted in place."""
    node = Window.partitionBy("u")
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = e.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("edge")).select("edge.*").coalesce(1)
    low = both.select("u", "v", F.least(F.min("v").over(node), "u").alias("m"))
    large = low.select(F.explode(F.array(pair("u", "m"), F.when(F.col("v") > F.col("u"), pair("v", "m")))).alias("edge"))
    large = large.select("edge.*").where("u <> v").coalesce(1)
    low = large.select("u", "v", F.min("v").over(node).alias("m"))
    small = low.select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("edge"))
    return small.select("edge.*").where("u <> v").coalesce(1).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 32))).first())


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (h >> np.uint64(36)) & mask, h & mask


def membership(rows: DataFrame, key: Column):
    """Broadcast of a bit field that is set for every (non-null) long ``key`` of ``rows``.

    A key that is not set is certainly absent; one that is set may be absent, so it only spares
    work before a join and never decides.  Its 2**26 bits (8 MB) do not grow with the data.
    """
    def fill(batches):
        import pyarrow as pa
        bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        for b in batches:
            keys = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            for place in _places(keys):
                np.bitwise_or.at(bits, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_pydict({"word": at, "bits": bits[at].view(np.int64)})

    words = rows.select(key.cast("long").alias("key")).mapInArrow(fill, "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)


def may_contain(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for place in _places(keys):
        out &= ((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out
