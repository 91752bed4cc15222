"""Context-tree weighting over bytes, trained and applied at scale.

Every byte is eight binary decisions; each decision node has a context tree over the bytes
before it, and a node of the tree mixes its own Krichevsky-Trofimov estimate with its children's
mixture (weight one half each, as in context-tree weighting).  All counts follow from the counts of
byte strings of length ``depth + 1``:

1. one pass counts these strings and the words, per task in numpy, then summed by Spark;
2. trees are evaluated in shards that hold whole subtrees (all strings with the same two last
   context bytes); the two top levels are sums over shards, at most 257 x 256 rows;
3. one pass scores the texts: strings and words of a table of bounded size are looked up
   in the task, the rest are joined by key, so every string of every text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.words import LOWER, Lookup, count_keys, pieces, sorted_counts, text_buffer, word_hashes
from ridelens.session import cut_lineage

#: Keys kept in a table that goes to every task; all others are joined.
TABLE_KEYS = 1 << 19
HELD = 1 << 21
PART = 2 << 20
END = 0xFF
END_WORD = np.uint64(0)
WORD, GRAM, ROW = 1, 2, 0
LN2 = np.log(2.0)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """True where crc32 of the id as text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


# ---- byte strings -------------------------------------------------------------------------

def _grams(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the byte strings ending at each byte and at the end sign of each text, and their text."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    padded = np.zeros(len(data) + n * (depth + 1), np.uint64)
    shift = np.repeat((np.arange(n) + 1) * (depth + 1) - 1, size)
    padded[np.arange(len(data)) + shift] = LOWER[data]
    ends = offsets[1:] + (np.arange(n) + 1) * (depth + 1) - 1
    padded[ends] = END
    key = padded[depth:].copy()
    for j in range(1, depth + 1):
        key |= padded[depth - j:len(padded) - j] << np.uint64(8 * j)
    # text i fills positions [start_i, end_i] of the padded bytes after its ``depth`` zeros
    owner = np.repeat(np.arange(n), size + 1 + depth)
    begin = offsets[:-1] + np.arange(n) * (depth + 1)
    real = np.ones(len(padded), bool)
    for j in range(depth):
        real[begin + j] = False
    at = np.flatnonzero(real)
    return key[at - depth], owner[at]


def _count_pass(depth: int):
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n_train", pa.int64()), ("n_all", pa.int64())])

    def rows(kind: int, key: np.ndarray, train: np.ndarray, every: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)),
                                           pa.array(train), pa.array(every)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: []}
        ends = 0

        def merged(kind):
            parts = held[kind]
            out = count_keys(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
            held[kind] = [out]
            return out

        for part in pieces(batches, size=PART):
            train = ~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool)
            text = part.column("text")
            words, starts = word_hashes(text, lower=True)
            learn = np.repeat(train, np.diff(starts))
            key, n = sorted_counts(words[learn])
            held[WORD].append((key, n, n))
            ends += int(train.sum())
            for which in (train, ~train):
                if which.any():
                    key, n = sorted_counts(_grams(text.filter(pa.array(which)), depth)[0])
                    held[GRAM].append((key, n * int(which is train), n))
            for kind in (WORD, GRAM):
                if sum(len(p[0]) for p in held[kind]) > HELD and len(merged(kind)[0]) > HELD // 2:
                    yield rows(kind, *held[kind].pop())
        for kind in (WORD, GRAM):
            if held[kind]:
                yield rows(kind, *merged(kind))
        if ends:
            yield rows(WORD, np.array([END_WORD]), np.array([ends]), np.array([ends]))

    return count, "kind int, key long, n_train long, n_all long"


# ---- trees --------------------------------------------------------------------------------

def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma by the Stirling series after raising the argument by 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    lift = np.ones_like(x)
    for j in range(8):
        lift = lift * (x + j)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(lift)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


class _Level:
    """All decision nodes of one depth: counts, KT block probability, weighted probability."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.node, self.zeros, self.ones, *rest = count_keys(node, zeros, ones, *([below] if below is not None else []))
        own = _log_kt(self.zeros, self.ones)
        self.weighted = np.logaddexp(own, rest[0]) - LN2 if rest else own
        self.stop = np.exp(own - LN2 - self.weighted) if rest else np.ones(len(own))

    def mix(self, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        hit = np.where(bit, self.ones[at], self.zeros[at])
        kt = (hit + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)
        return kt if deeper is None else self.stop[at] * kt + (1 - self.stop[at]) * deeper


def _levels(key: np.ndarray, n: np.ndarray, depth: int, top: int):
    """Levels ``depth .. top`` of the trees over byte strings, with each string's node index and bits."""
    byte, context = key & np.uint64(255), key >> np.uint64(8)
    place = np.arange(8, dtype=np.uint64)
    branch = (np.uint64(1) << place) | (byte[:, None] >> (np.uint64(8) - place))
    bit = ((byte[:, None] >> (np.uint64(7) - place)) & np.uint64(1)).astype(bool)
    count = np.repeat(n.astype(float), 8).reshape(-1, 8)
    node = ((context[:, None] << np.uint64(8)) | branch).ravel()
    zeros, ones, below = np.where(bit, 0, count).ravel(), np.where(bit, count, 0).ravel(), None
    out = []
    for d in range(depth, top - 1, -1):
        if d < depth:  # a parent has one context byte less
            last = out[-1][1]
            node = (_suffix(last.node >> np.uint64(8), d) << np.uint64(8)) | (last.node & np.uint64(255))
            zeros, ones, below = last.zeros, last.ones, last.weighted
        out.append((d, _Level(node, zeros, ones, below)))
    return out, context, branch, bit


def _suffix(context: np.ndarray, d: int) -> np.ndarray:
    return context & np.uint64((1 << (8 * d)) - 1)


def _mixture(levels, context, branch, bit) -> np.ndarray:
    p = None
    for d, level in levels:
        node = ((_suffix(context, d)[:, None] << np.uint64(8)) | branch).ravel()
        p = level.mix(np.searchsorted(level.node, node), bit.ravel(), p)
    return p


def _shards(batches: Iterator[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole shards (rows sorted by shard), several small ones at a time."""
    parts, size = [], 0
    for b in batches:
        parts.append((b.column("shard").to_numpy(), b.column("key").to_numpy().view(np.uint64), b.column("n_train").to_numpy()))
        size += b.num_rows
        if size >= limit:
            shard, key, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
            cut = int(np.searchsorted(shard, shard[-1]))
            if cut:
                yield key[:cut], n[:cut]
            parts, size = [(shard[cut:], key[cut:], n[cut:])], len(shard) - cut
    if size:
        yield tuple(np.concatenate([p[i] for p in parts]) for i in (1, 2))


def _top_of_shards(depth: int):
    def run(batches):
        for key, n in _shards(batches):
            levels, *_ = _levels(key, n, depth, 2)
            level = levels[-1][1]
            node = (_suffix(level.node >> np.uint64(8), 1) << np.uint64(8)) | (level.node & np.uint64(255))
            node, zeros, ones, below = count_keys(node, level.zeros, level.ones, level.weighted)
            yield pa.RecordBatch.from_pydict({"node": node.view(np.int64), "zeros": zeros, "ones": ones, "below": below})
    return run, "node long, zeros double, ones double, below double"


def _string_scores(depth: int, one: _Level, zero: _Level):
    def run(batches):
        for key, n in _shards(batches):
            levels, context, branch, bit = _levels(key, n, depth, 2)
            p = _mixture(levels, context, branch, bit)
            p = _mixture_top(p, one, zero, context, branch, bit)
            value = np.log10(p).reshape(-1, 8).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"kind": np.full(len(key), GRAM, np.int32), "key": key.view(np.int64), "value": value})
    return run, "kind int, key long, value double"


def _mixture_top(p, one: _Level, zero: _Level, context, branch, bit) -> np.ndarray:
    for d, level in ((1, one), (0, zero)):
        node = ((_suffix(context, d)[:, None] << np.uint64(8)) | branch).ravel()
        p = level.mix(np.searchsorted(level.node, node), bit.ravel(), p)
    return p


# ---- scoring ------------------------------------------------------------------------------

def _score_pass(depth: int, words, grams, floor: float, ends: int):
    schema = "row_id long, doc_id long, held_out boolean, kind int, key long, n long, n_tokens long, n_known long, base double, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        word_table, gram_table = Lookup(*words.value), Lookup(*grams.value)
        for part in pieces(batches, size=PART):
            m = part.num_rows
            ids = {c: part.column(c) for c in ("row_id", "doc_id", "held_out")}
            text = part.column("text")
            hashes, starts = word_hashes(text, lower=True)
            owner = np.repeat(np.arange(m), np.diff(starts))
            at = word_table.find(hashes)
            seen = at >= 0
            c = word_table.values[at[seen]]
            base = np.bincount(owner[seen], weights=np.log10(c + 1.0) + floor, minlength=m)
            known = np.bincount(owner[seen], minlength=m)
            base += np.log10(ends + 1.0) + floor
            known += ends > 0
            tails = [(WORD, owner[~seen], hashes[~seen])]
            key, gram_owner = _grams(text, depth)
            at = gram_table.find(key)
            seen = at >= 0
            score = np.bincount(gram_owner[seen], weights=gram_table.values[at[seen]], minlength=m)
            tails.append((GRAM, gram_owner[~seen], key[~seen]))
            out = {"kind": np.full(m, ROW, np.int32), "key": ids["row_id"], "n": np.diff(text_buffer(text)[1]) + 1,
                   "n_tokens": np.diff(starts) + 1, "n_known": known.astype(np.int64), "base": base, "score": score}
            yield pa.RecordBatch.from_arrays([pa.array(out[c]) if c in out else ids[c] for c in names], names=names)
            for kind, who, k in tails:
                if not len(k):
                    continue
                order = np.lexsort((k, who))
                who, k = who[order], k[order]
                first = np.ones(len(k), bool)
                first[1:] = (k[1:] != k[:-1]) | (who[1:] != who[:-1])
                start = np.flatnonzero(first)
                zero = np.zeros(len(start))
                out = {"kind": np.full(len(start), kind, np.int32), "key": k[start].view(np.int64),
                       "n": np.diff(np.append(start, len(k))), "n_tokens": zero.astype(np.int64),
                       "n_known": zero.astype(np.int64), "base": zero, "score": zero}
                take = pa.array(who[start])
                yield pa.RecordBatch.from_arrays([pa.array(out[c]) if c in out else ids[c].take(take) for c in names], names=names)

    return run, schema


def _head(counts: DataFrame, by: str, keys: int) -> int:
    """The count above which at most ``keys`` rows lie."""
    sizes = counts.groupBy(F.floor(F.log2(F.col(by).cast("double") + 1) * 64).alias("level")).agg(
        F.count("*").alias("rows"), F.max(by).alias("most")).orderBy(F.desc("level")).collect()
    total = 0
    for s in sizes:
        total += s["rows"]
        if total > keys:
            return int(s.most)
    return -1


def _table(spark, rows: DataFrame, value: str):
    got = rows.select("key", F.col(value).cast("double").alias("value")).toArrow()
    return spark.sparkContext.broadcast((got["key"].to_numpy().copy(), got["value"].to_numpy().copy()))


def context_tree_scores(docs: DataFrame, train: Column | None = None, depth: int = 5,
                        table_keys: int = TABLE_KEYS) -> DataFrame:
    """Scores every row of ``docs`` (``doc_id, text``) by a context-tree weighting model of the
    rows where ``train`` holds (default: crc32 of the id modulo 7 is not 2).

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte``: ``base_score`` is the smoothed single-word log10 probability, ``score`` the
    model's log10 probability of the lower-cased bytes of the text and an end sign, and
    ``bits_per_byte`` its code length per byte (the end sign counts as one).  The counts are
    frozen after training.

    Null and empty texts have one token, the end; a null id trains.  Repeated rows are scored
    separately and train as often as they occur; an empty table gives an empty result.  Without
    training rows every decision has probability one half.  Other columns are ignored.
    """
    spark = docs.sparkSession
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7")
    held = ~train if train is not None else held_out(F.col("doc_id"))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    run, schema = _count_pass(depth)
    counts = rows.select("held_out", "text").mapInArrow(run, schema).groupBy("kind", "key").agg(
        F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))
    counts = cut_lineage(counts)
    words, grams = counts.where(F.col("kind") == WORD), counts.where(F.col("kind") == GRAM)
    totals = words.agg(F.sum("n_train").alias("n"), F.count("*").alias("v")).first()
    train_tokens = int(totals.n or 0)
    floor = -float(np.log10(train_tokens + totals.v + 1))
    ends = int(words.where(F.col("key") == int(END_WORD)).agg(F.sum("n_train")).first()[0] or 0)

    shard = F.shiftright("key", 8).bitwiseAND(0xFFFF).cast("int")
    trees = grams.select(shard.alias("shard"), "key", "n_train").repartition("shard").sortWithinPartitions("shard")
    run, schema = _top_of_shards(depth)
    top = trees.mapInArrow(run, schema).groupBy("node").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    one = _Level(top["node"].to_numpy().copy().view(np.uint64), *(top[c].to_numpy().astype(float) for c in ("zeros", "ones", "below")))
    zero = _Level(one.node & np.uint64(255), one.zeros, one.ones, one.weighted)
    run, schema = _string_scores(depth, one, zero)
    strings = cut_lineage(trees.mapInArrow(run, schema).join(
        grams.select("key", "n_all"), "key").select("kind", "key", "value", "n_all"))

    word_from, gram_from = _head(words, "n_train", table_keys), _head(strings, "n_all", table_keys)
    word_table = _table(spark, words.where(F.col("n_train") > word_from), "n_train")
    gram_table = _table(spark, strings.where(F.col("n_all") > gram_from), "value")
    run, schema = _score_pass(depth, word_table, gram_table, floor, ends)
    scored = rows.mapInArrow(run, schema)
    rest = words.where(F.col("n_train") <= word_from).select("kind", "key", F.col("n_train").cast("double").alias("value")).unionByName(
        strings.where(F.col("n_all") <= gram_from).select("kind", "key", "value"))
    c = F.coalesce("value", F.lit(0.0))
    is_word, is_gram = F.col("kind") == WORD, F.col("kind") == GRAM
    out = scored.join(rest, ["kind", "key"], "left").groupBy("row_id", "doc_id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(is_word & (c > 0), F.col("n")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(is_word, F.col("n") * (F.log10(c + 1) + floor)).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(is_gram, F.col("n") * F.col("value")).otherwise(F.col("score"))).alias("score"),
        F.sum(F.when(F.col("kind") == ROW, F.col("n"))).alias("n_bytes"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
                      "base_score", "score",
                      (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
