"""Prefix trie of conversations by whole-sequence collapse.

1. Turns are dealt out by ranges of (conv_id, turn) and numbered by running sums, so one very long
   conversation is spread over many tasks like any other rows.
2. Conversations are rebuilt: shared first turns, then their own.
3. Each prefix has a 128-bit key, the exclusive or of the hashes of its (depth, turn) pairs, again by a
   running sum.  Identical conversations collapse into one weighted sequence with its list of ends.
4. Sequences that are proper prefixes of others drop out by an anti-join; the rest are the leaves.
5. The prefixes of the weighted sequences are aggregated into nodes.

Nothing is expanded per pair of node and ancestor.  What a subtree saves is a sum over the sequences
through its top: each adds its weighted words from there on, less the words of nodes that it owns
there (a node is owned by its smallest member, and the nodes that a sequence owns are its last ones).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.session import cut_lineage

SHARED_EVERY = 20
HEAD_TURNS = 4
WORDS = r"[^\x20\x09-\x0D]+"
IDS_PER_PIECE = 512
HEAVY_KEYS = 1024


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` in the total order ``order`` over consecutive partitions, with the partition's number ``part``; checkpointed."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def running(rows: DataFrame, key: str, sums: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """Replaces each (long, not null) column by its running sum, or exclusive or, up to and with the row within ``key``.

    ``rows`` come from ``ranged`` with ``key`` first.  Two passes: one row per partition about its last key goes
    to the driver and comes back as what the partition's first key carries on from.
    """
    names = [*sums, *xors]
    join = [np.add] * len(sums) + [np.bitwise_xor] * len(xors)

    def segments(b):
        keys = b.column(key).to_numpy(zero_copy_only=False)
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        return keys, np.flatnonzero(first)

    def tail(batches):
        low = last = None
        single, total, part = True, [0] * len(names), None
        for b in batches:
            if not b.num_rows:
                continue
            keys, at = segments(b)
            part = b.column("part")[0].as_py()
            if last is None:
                low = int(keys[0])
            goes_on = last is not None and int(keys[0]) == last
            if len(at) > 1 or (last is not None and not goes_on):
                single = False
            for i, name in enumerate(names):
                v = int(join[i].reduce(b.column(name).to_numpy()[at[-1]:]))
                total[i] = int(join[i](np.int64(total[i]), np.int64(v))) if goes_on and len(at) == 1 else v
            last = int(keys[-1])
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "low": low, "last": last, "single": single, "total": total}],
                                             pa.schema([("part", pa.int32()), ("low", pa.int64()), ("last", pa.int64()),
                                                        ("single", pa.bool_()), ("total", pa.list_(pa.int64()))]))

    # one row per partition
    ends = rows.select(key, "part", *names).mapInArrow(tail, "part int, low long, last long, single boolean, total array<long>").collect()
    carried, key_before, before = {}, None, None
    for e in sorted(ends, key=lambda e: e["part"]):
        total = list(e["total"])
        if key_before is not None and e["low"] == key_before:
            carried[e["part"]] = (key_before, before)
            if e["single"]:
                total = [int(f(np.int64(x), np.int64(y))) for f, x, y in zip(join, total, before)]
        key_before, before = e["last"], total

    def run(batches):
        last = have = None
        for b in batches:
            if not b.num_rows:
                continue
            keys, at = segments(b)
            if last is None:
                last, have = carried.get(b.column("part")[0].as_py(), (None, None))
            size = np.diff(np.append(at, len(keys)))
            columns = list(b.columns)
            now = []
            for i, name in enumerate(names):
                v = b.column(name).to_numpy()
                whole = join[i].accumulate(v)
                start = np.repeat(whole[at] ^ v[at] if join[i] is np.bitwise_xor else whole[at] - v[at], size)
                out = whole ^ start if join[i] is np.bitwise_xor else whole - start
                if last is not None and int(keys[0]) == last:
                    out[:size[0]] = join[i](out[:size[0]], np.int64(have[i]))
                columns[b.schema.get_field_index(name)] = pa.array(out)
                now.append(int(out[-1]))
            last, have = int(keys[-1]), now
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def rebuilt(conversations: DataFrame, every: int = SHARED_EVERY, heads: int = HEAD_TURNS) -> DataFrame:
    """``conv_id, sec, i, a1, a2, words``: the turns of each rebuilt conversation in the order (sec, i), after a row of sec -1.

    Conversation ``c`` has the first h turns of ``c - c % every`` and then its own after its first h; h is
    crc32(decimal c) % ``heads``.
    """
    mark = F.md5(F.concat(F.md5(F.coalesce("role", F.lit(""))), F.md5(F.coalesce("text", F.lit("")))))
    # the last key only spreads repeated rows over several ranges
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long").alias("words"), F.monotonically_increasing_id().alias("copy"))
    turns = ranged(turns, "conv_id", F.asc_nulls_first("turn"), "mark", "copy")
    half = lambda at: F.conv(F.substring("mark", at, 16), 16, -10).cast("long")
    own = running(turns.withColumn("i", F.lit(1).cast("long")), "conv_id", ["i"]).select(
        "conv_id", (F.col("i") - 1).alias("i"), half(1).alias("a1"), half(17).alias("a2"), "words")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = turns.select("conv_id").distinct()
    shared = own.where((F.col("conv_id") % every == 0) & (F.col("i") < heads - 1)).withColumnRenamed("conv_id", "base")
    # at most heads - 1 rows and 2 * every conversations meet per base
    shared = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(shared, "base").where(F.col("i") < h)
    cols = lambda sec: ["conv_id", F.lit(sec).alias("sec"), "i", "a1", "a2", "words"]
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", F.lit(-1).alias("sec"), zero.alias("i"), zero.alias("a1"), zero.alias("a2"), zero.alias("words"))
    return roots.unionByName(shared.select(*cols(0))).unionByName(own.where(F.col("i") >= h).select(*cols(1)))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, part, depth, k1, k2, p1, p2, words, before`` per conversation and depth from the rows of ``rebuilt``: the prefix's
    key, its parent's, the words of its last turn and of those before it; checkpointed."""
    rows = running(ranged(turns, "conv_id", "sec", "i").withColumn("depth", F.lit(1).cast("long")), "conv_id", ["depth"])
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("depth", F.col("depth") - 1)
    rows = rows.select("conv_id", "part", "depth", "words", F.col("words").alias("before"),
                       F.when(F.col("depth") > 0, F.xxhash64("depth", "a1", "a2")).otherwise(zero).alias("h1"),
                       F.when(F.col("depth") > 0, F.xxhash64("a2", "depth", "a1")).otherwise(zero).alias("h2"))
    rows = running(rows.withColumns({"k1": F.col("h1"), "k2": F.col("h2")}), "conv_id", ["before"], ["k1", "k2"])
    return cut_lineage(rows.select(
        "conv_id", "part", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "words", (F.col("before") - F.col("words")).alias("before")))


def id_list_hashes(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``keys, out``: SHA-256 (hex) of each key's decimal ``value``s, ascending and comma-joined.

    The lists are joined into pieces where the range order left them; the last step only passes a key's pieces
    through the hash one after another, in bounded memory however long the list.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = ", ".join(f"{k} long" for k in keys)

    def spans(b):
        cols = [b.column(k).to_numpy() for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[:1] = True
        at = np.flatnonzero(change)
        return cols, at, np.append(at[1:], b.num_rows)

    def pieces(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cols, at, end = spans(b)
            ids = b.column(value).to_numpy()
            cuts = [(lo, min(lo + IDS_PER_PIECE, hi)) for a, hi in zip(at, end) for lo in range(a, hi, IDS_PER_PIECE)]
            low = np.array([lo for lo, _ in cuts])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[low]) for c in cols), pa.array(ids[low]), pa.array([",".join(map(str, ids[lo:hi].tolist())) for lo, hi in cuts])],
                [*keys, "low", "piece"])

    def hashes(batches):
        now, sha = None, None
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in keys)))
            done = []
            for k, piece in zip(rows, b.column("piece").to_pylist()):
                if k != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            if done:
                yield batch(done)
        if now is not None:
            yield batch([(*now, sha.hexdigest())])

    def batch(done):
        cols = list(zip(*done))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], [*keys, out])

    cut = rows.select(*keys, value).repartitionByRange(n, *keys, value).sortWithinPartitions(*keys, value).mapInArrow(
        pieces, f"{ddl}, low long, piece string")
    return cut.repartition(n, *keys).sortWithinPartitions(*keys, "low").mapInArrow(hashes, f"{ddl}, {out} string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie's nodes from the rows of ``rebuilt``; see ``conversation_trie``."""
    rows = prefixes(turns)
    node = ["k1", "k2"]
    # one row per conversation: its whole sequence
    whole = cut_lineage(rows.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("end"), F.sum("words").alias("total")).select(
        "conv_id", "end.depth", "end.k1", "end.k2", "total"))
    seqs = cut_lineage(whole.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("total").alias("total")))
    ends = id_list_hashes(whole, node, "conv_id", "ends_sha256")

    # joins of rows with their sequence go by (conversation, part): a part of one conversation fits a task
    chunks = cut_lineage(rows.select("conv_id", "part").distinct().join(seqs.select("conv_id"), "conv_id"))
    held = cut_lineage(rows.join(chunks, ["conv_id", "part"]))
    inner = held.where("depth > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2")).distinct()
    leaves = seqs.join(inner, node, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owned = held.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"))
    owned = owned.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.sum("words").alias("own_words"))
    said = seqs.drop("k1", "k2").join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    said = chunks.join(said, "conv_id")

    after = F.col("total") - F.col("before")
    once = F.when(F.col("depth") >= F.col("own_from"), after).otherwise(F.coalesce("own_words", F.lit(0)))
    nodes = held.join(said, ["conv_id", "part"]).groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"),
        F.sum(F.col("weight") * after - once).alias("saved_tokens"))
    nodes = cut_lineage(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.join(children, node, "left").join(ends, node, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("long")),
        "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}))
    return _with_parents(nodes)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent_conv_id``.  Of parents with more than a 1/1024 of all nodes as children there are fewer than 1024: these
    are broadcast; all others are joined, each with a bounded share of the rows."""
    limit = nodes.count() // HEAVY_KEYS
    parent = nodes.where("n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = F.broadcast(parent.where(F.col("n_children") > limit).drop("n_children"))
    below = nodes.where("depth > 0")
    by_heavy = below.join(heavy, ["p1", "p2"])
    others = below.join(heavy, ["p1", "p2"], "left_anti").join(parent.where(F.col("n_children") <= limit).drop("n_children"), ["p1", "p2"])
    roots = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return roots.unionByName(by_heavy).unionByName(others).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, every: int = SHARED_EVERY, heads: int = HEAD_TURNS) -> DataFrame:
    """Prefix trie of the rebuilt conversations of ``conversations`` (``conv_id, turn, role, text``): one row per node with
    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by turn (null first), equal ones by the MD5 of their role and text, repeated rows all
    count; a null role or text is empty.  Rows without a conv_id belong to no conversation and are left out.
    ``c - c % every`` takes the sign of c as SQL does.  An empty table has no node.  Other columns are ignored.
    Prefixes are told apart by 128-bit keys.
    """
    return prefix_trie(rebuilt(conversations, every, heads))
