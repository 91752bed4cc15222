"""Exact n-gram Jaccard join of documents: blocks of the sparse document x n-gram product.

Documents with equal n-gram sets form one class; only one row per class goes on.  All n-grams
have one order: hash order, but the heaviest ones last.  Two classes whose Jaccard similarity
reaches the threshold share an n-gram among their first ``n - ceil(t n) + 1`` ones, so the product
needs these columns only; it is computed in blocks of columns (Spark partitions by n-gram),
overlaps are summed per pair and pairs that cannot reach the size-derived bound are dropped.

A column with many documents is not multiplied out.  First each document meets the column's first
document and its neighbour; what is verified is joined to components.  In large columns,
neighbours in several other orders follow, only across components.  What is then left are
pairs across components, and only rows outside the column's largest component are paired.
Documents of one component need no further pair, so no link is lost.

Each class carries its size and a parity map: bit ``j`` tells whether an odd number of its n-grams hash
to ``j``.  Two maps that differ in ``h`` bits prove at least ``h`` n-grams that only one set has, so the
overlap is at most ``(|A| + |B| - h) / 2``; a pair below its size bound by that goes before it is
counted or its whole sets are read.  The bound holds for every pair; with long sets it prunes less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.graph import components, joined, may_contain, membership
from ridelens.llm.words import count_keys, mix, pieces, runs, sorted_counts, word_hashes
from ridelens.session import cut_lineage, release

#: At most so many of the heaviest n-grams are put last; this only orders columns.
HEAVY_KEYS = 1 << 16
HEAVY_COUNT = 32
#: Columns of more rows are first searched in this many rounds of this many orders.
LARGE_COLUMN, ROUNDS, ORDERS = 8, 1, 8
#: 64-bit words of the parity map of a set.
MAP_WORDS = 8
MAP = [f"map{j}" for j in range(MAP_WORDS)]
PART = 2 << 20


def ngram_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams; with fewer words the whole sequence is one."""
    words, starts = word_hashes(column, lower=True)
    grams = runs(words, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a:b - n + 1])
            keep = np.ones(len(g), bool)
            keep[1:] = g[1:] != g[:-1]
            out.append(g[keep])
        elif b > a:
            out.append(runs(words[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(words[:0])
    return out


def _set_id(s: np.ndarray) -> int:
    return int(mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def parity_maps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``MAP_WORDS`` 64-bit words per set: the parity of the number of its hashes at each bit."""
    out = np.zeros(len(sets) * MAP_WORDS, np.uint64)
    if sets:
        at = (np.concatenate(sets) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        at %= np.uint64(64 * MAP_WORDS)
        owner = np.repeat(np.arange(len(sets)) * MAP_WORDS, [len(s) for s in sets])
        np.bitwise_xor.at(out, owner + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64).reshape(-1, MAP_WORDS)


def _members(n: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for part in pieces(batches, size=PART):
            sets = ngram_sets(part.column("text"), n)
            maps = parity_maps(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64()),
                 *[pa.array(maps[:, j]) for j in range(MAP_WORDS)]], names=["doc_id", "n_shingles", "set_id", *MAP])
    return run, "doc_id long, n_shingles long, set_id long, " + ", ".join(f"{m} long" for m in MAP)


def _repeated(n: int):
    """N-grams that several documents of one task hold, with their number there."""
    def run(batches):
        held: list = []
        for part in pieces(batches, size=PART):
            sets = ngram_sets(part.column("text"), n)
            held.append(sorted_counts(np.concatenate(sets)) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            if sum(len(k) for k, _ in held) > 1 << 22:
                k, c = count_keys(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
                if len(k) > 1 << 21:  # bounded memory: pass on what is repeated so far
                    yield _pairs(k[c > 1], c[c > 1])
                    held = []
                else:
                    held = [(k, c)]
        if held:
            k, c = count_keys(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            yield _pairs(k[c > 1], c[c > 1])

    def _pairs(k, c):
        return pa.RecordBatch.from_pydict({"token": k.view(np.int64), "n": c.astype(np.int64)})
    return run, "token long, n long"


def _prefixes(n: int, percent: int, heavy):
    """``token, set_id`` of each distinct set's prefix; sets seen before in the task are left out."""
    def run(batches):
        last, seen = heavy.value, set()
        for part in pieces(batches, size=PART):
            tokens, ids, sizes = [], [], []
            for s in ngram_sets(part.column("text"), n):
                if not len(s) or (own := _set_id(s)) in seen:
                    continue
                seen.add(own)
                p = len(s) - -(-percent * len(s) // 100) + 1
                tokens.append(_ordered(s, last)[:p])
                ids.append(own)
                sizes.append(p)
            if len(seen) > 1 << 20:  # bounded memory: a set passed on twice is the same row again
                seen = set()
            if ids:
                yield pa.RecordBatch.from_pydict({"token": np.concatenate(tokens).view(np.int64),
                                                  "set_id": np.repeat(np.array(ids, np.int64), sizes)})
    return run, "token long, set_id long"


def _ordered(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return s
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    is_heavy = heavy[at] == s
    return np.concatenate([s[~is_heavy], s[is_heavy]])


def _columns():
    """Rows of columns with at least two sets, from rows sorted by (token, set_id): each row with the
    column's first set and the set before it.  Only the last row is kept between batches."""
    def run(batches):
        token = set_id = first = None
        opened = False  # whether the first row of the current column has been passed on
        for b in batches:
            t, s = b.column("token").to_numpy(), b.column("set_id").to_numpy()
            if token is not None:
                t, s = np.concatenate([[token], t]), np.concatenate([[set_id], s])
            keep = np.ones(len(t), bool)
            keep[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            t, s = t[keep], s[keep]
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
            firsts = s[head]
            if token is not None:
                firsts[head == 0] = first
            shared = np.zeros(len(t), bool)
            shared[1:] = ~new[1:]
            lead = np.zeros(len(t), bool)
            lead[:-1] = ~new[1:] & new[:-1]
            if token is not None:
                lead[0] = len(t) > 1 and not new[1] and not opened
                shared[0] = False
            out = np.flatnonzero(shared | lead)
            before = np.where(shared, np.concatenate([[0], s[:-1]]), s)
            if len(out):
                yield pa.RecordBatch.from_pydict({"token": t[out], "set_id": s[out], "first": np.where(shared, firsts, s)[out],
                                                  "before": before[out]})
            opened = bool(shared[-1]) or (len(t) == 1 and token is not None and opened)
            token, set_id, first = t[-1], s[-1], firsts[-1]
    return run, "token long, set_id long, first long, before long"


def _fetch(n: int, wanted):
    def run(batches):
        bits = wanted.value
        for part in pieces(batches, size=PART):
            part = part.filter(part.column("doc_id").is_valid())
            hit = may_contain(bits, part.column("doc_id").to_numpy())
            if hit.any():
                part = part.filter(pa.array(hit))
                sets = ngram_sets(part.column("text"), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64()),
                     part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "doc", "grams"])
    return run, "id long, doc long, grams binary"


def _links(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("grams_a"), b.column("grams_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run, "a long, b long"


class _Verifier:
    """Checks pairs of set ids on their whole sets.  Sets are read from the texts once and kept."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, percent: int):
        self.docs, self.classes, self.n, self.percent = docs, classes, n, percent
        self.sets: DataFrame | None = None

    def _fetch(self, pairs: DataFrame) -> None:
        ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select(F.col("id").alias("a")), "a", "left_anti")
        ids = cut_lineage(ids.join(self.classes, F.col("a") == F.col("set_id")).select(F.col("a").alias("id"), F.col("doc_id").alias("doc")))
        if ids.isEmpty():
            return
        run, schema = _fetch(self.n, membership(ids, F.col("doc")))
        new = cut_lineage(self.docs.mapInArrow(run, schema).join(ids, ["id", "doc"]).dropDuplicates(["id"]).select("id", "grams"))
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that reach the threshold."""
        self._fetch(pairs)
        if self.sets is None:
            return pairs
        one = pairs.join(self.sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
        two = one.join(self.sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
        run, schema = _links(self.percent)
        return cut_lineage(two.select("a", "b", "grams_a", "grams_b").mapInArrow(run, schema))


def _mixed(columns: DataFrame, parts: DataFrame) -> DataFrame:
    """``token, set_id, comp, top, rows``: rows of columns that hold several components, with the column's
    largest component and its number of rows."""
    placed = columns.select("token", "set_id").join(parts, F.col("set_id") == F.col("node"), "left").select(
        "token", "set_id", F.coalesce("component", "set_id").alias("comp"))
    sizes = placed.groupBy("token", "comp").agg(F.count("*").alias("rows"))
    top = sizes.groupBy("token").agg(F.max(F.struct("rows", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("rows").alias("rows"))
    top = top.where("comps > 1").select("token", F.col("top.comp").alias("top"), "rows")
    return cut_lineage(placed.join(top, "token"))


def _pairs(left: str, right: str):
    return F.greatest(left, right).alias("a"), F.least(left, right).alias("b")


def _neighbours(mixed: DataFrame, first_order: int) -> DataFrame:
    """Neighbours across components in ``ORDERS`` seeded orders of each large column, with their count."""
    # dealt by token before the orders are made: each row is sent once, and all orders of a column are sorted where it is
    rows = mixed.where(F.col("rows") > LARGE_COLUMN).select("token", "set_id", "comp").repartition("token").withColumn("order", F.explode(F.sequence(
        F.lit(first_order), F.lit(first_order + ORDERS - 1))))
    order = Window.partitionBy("token", "order").orderBy(F.xxhash64("set_id", "order"))
    near = rows.select("set_id", "comp", F.lag("set_id").over(order).alias("other"), F.lag("comp").over(order).alias("other_comp"))
    return near.where("comp <> other_comp").groupBy(*_pairs("set_id", "other")).agg(F.count("*").alias("overlap"))


def _can_reach(x: str, y: str, percent: int):
    """Whether sizes and parity maps of the sides ``x`` and ``y`` leave room for the threshold."""
    n_x, n_y = F.col(f"n_{x}"), F.col(f"n_{y}")
    apart = sum((F.bit_count(F.col(f"{m}_{x}").bitwiseXOR(F.col(f"{m}_{y}"))) for m in MAP[1:]),
                F.bit_count(F.col(f"{MAP[0]}_{x}").bitwiseXOR(F.col(f"{MAP[0]}_{y}"))))
    return (100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)) & (
        (100 + percent) * (n_x + n_y - apart) >= 2 * percent * (n_x + n_y))


def _side(classes: DataFrame, x: str) -> DataFrame:
    return classes.select(F.col("set_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), *[F.col(m).alias(f"{m}_{x}") for m in MAP])


def _across(mixed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs across components that a column holds and that can reach the threshold, with their number
    of shared columns."""
    left = mixed.where("comp <> top").select("token", F.col("set_id").alias("x"), F.col("comp").alias("comp_x")).join(_side(classes, "x"), "x")
    right = mixed.select("token", F.col("set_id").alias("y"), F.col("comp").alias("comp_y"), "top").join(_side(classes, "y"), "y")
    across = left.join(right, "token").where((F.col("comp_x") != F.col("comp_y")) & (
        (F.col("comp_y") == F.col("top")) | (F.col("x") > F.col("y"))) & _can_reach("x", "y", percent))
    return across.groupBy(*_pairs("x", "y")).agg(F.count("*").alias("overlap"))


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int, share: float) -> DataFrame:
    """Pairs whose summed overlap over their prefixes (times ``1 / share``) can reach the size bound."""
    p = pairs.join(_side(classes, "a"), "a").join(_side(classes, "b"), "b")
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    beyond = F.greatest(*[F.col(f"n_{x}") - (F.col(f"n_{x}") - F.ceil(percent * F.col(f"n_{x}") / F.lit(100)) + 1) for x in "ab"])
    return p.where(_can_reach("a", "b", percent) & (F.col("overlap") >= share * (need - beyond))).select("a", "b")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs`` (``doc_id, text``).

    Two documents link when ``100 * |A and B| >= percent * |A or B|`` for their sets of distinct
    ``n``-word shingles (A-Z lower-cased); ``component_id`` is the smallest doc_id reachable by
    links, itself included.  A text with fewer than ``n`` words is one shingle; null texts and texts
    without words have an empty set, link with nothing and are their own component.  Rows with a
    null doc_id get a null component and link nothing.  Repeated rows share a component; rows with
    equal doc_id and different texts link by either text.  Other columns are ignored; an empty
    table gives an empty result.  Sets and n-grams are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    run, schema = _members(n)
    members = cut_lineage(docs.mapInArrow(run, schema))
    classes = cut_lineage(members.where("doc_id is not null and set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), *[F.max(m).alias(m) for m in MAP]))

    run, schema = _repeated(n)
    heavy = (known.mapInArrow(run, schema).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_COUNT)
             .orderBy(F.desc("n"), "token").limit(heavy_keys).select("token").toArrow())
    heavy = spark.sparkContext.broadcast(np.sort(heavy["token"].to_numpy().copy().view(np.uint64)))
    run, schema = _prefixes(n, percent, heavy)
    rows = known.mapInArrow(run, schema)
    run, schema = _columns()
    columns = rows.repartition("token").sortWithinPartitions("token", "set_id").mapInArrow(run, schema)
    columns = cut_lineage(columns)
    release(spark)

    near = columns.select("set_id", F.explode(F.array_distinct(F.array("first", "before"))).alias("other")).where("set_id <> other")
    star = near.groupBy(*_pairs("set_id", "other")).agg(F.count("*").alias("overlap"))
    verifier = _Verifier(known, classes, n, percent)
    tried = cut_lineage(_plausible(star, classes, percent, 0.5))
    links = verifier.links(tried)
    release(spark)
    parts = cut_lineage(components(links))
    mixed = _mixed(columns, parts)
    for turn in range(ROUNDS):
        pairs = cut_lineage(_plausible(_neighbours(mixed, turn * ORDERS), classes, percent, 0.25).join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        tried = tried.unionByName(pairs)
        found = verifier.links(pairs)
        links = links.unionByName(found)
        release(spark)
        parts = cut_lineage(joined(parts, found))
        mixed = _mixed(mixed, parts)  # links only join components, so the other columns stay of one
    pairs = cut_lineage(_plausible(_across(mixed, classes, percent), classes, percent, 1.0).join(tried, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        links = links.unionByName(verifier.links(pairs))
    release(spark)
    same = members.where("doc_id is not null and set_id is not null").select("doc_id", "set_id").join(
        classes.select("set_id", F.col("doc_id").alias("low")), "set_id").where("doc_id <> low").select(
        F.col("doc_id").alias("a"), F.col("low").alias("b"))
    name = lambda x: classes.select(F.col("set_id").alias(x), F.col("doc_id").alias(f"doc_{x}"))
    linked = links.join(name("a"), "a").join(name("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    parts = components(same.unionByName(linked))
    return members.join(parts, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

