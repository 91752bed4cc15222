"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a seeded shuffled order.  A copy of a document gets the
virtual finish time ``tokens of its source up to and with it / target of its source``; copies of
all sources are taken in the order of these times until the total budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 20_000
SLICES = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """``source, rank, source_size, target`` from one row per document (``source, size``).

    Sources in code point order (null last) take the weights in turn.  The targets share the sum
    of all sizes by weight; a target above ``max_epochs`` times its source's size stops there and
    the excess goes to the others by weight.  With the sources in the order of limit / weight,
    a source stops at its limit if filling all later ones up to its own level still fits.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
           .withColumn("weight", weight)
           .withColumn("limit", (F.col("source_size") * max_epochs).cast("double"))
           .withColumn("budget", F.sum("source_size").over(everything).cast("double")))
    up_to = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    per = (per.withColumn("limits", F.sum("limit").over(up_to))
           .withColumn("later", F.sum("weight").over(everything) - F.sum("weight").over(up_to))
           .withColumn("full", F.col("limits") + F.col("limit") / F.col("weight") * F.col("later") <= F.col("budget")))
    full = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("limit")).otherwise(
        F.least(F.col("limit"), (F.col("budget") - full) / open_weight * F.col("weight")))
    return per.select("source", "rank", "source_size", "n_docs", "budget", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, source, text``): ``doc_id, source, size, source_size,
    target, taken, copies``.

    ``size`` is the number of words (null text: 0) and ``taken = size * copies``, the words the mix
    takes of it, repeats counted; ``copies`` is at most ``max_epochs``.  The order within a source
    depends on ``seed``, the id and the text alone, so reruns agree.  Null sources form a source of
    their own.  Rows with equal id and text are separate rows.  Documents without words take 0
    copies; an empty table gives an empty result.  Other columns of ``docs`` are ignored.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                        F.xxhash64(F.lit(seed), "doc_id", "text").alias("shuffle_key"))
    sized = cut_lineage(sized)
    targets = cut_lineage(source_targets(sized, weights, max_epochs))
    total = targets.agg(F.sum("n_docs").alias("n"), F.max("budget").alias("budget")).first()
    bits = max(4, (int(total.n or 0) // BUCKET_ROWS).bit_length())

    # running words within a source: sums of whole buckets of the shuffled order, then rows of one bucket
    t = targets.select(F.col("source").alias("s"), "rank", "source_size", "target")
    rows = (sized.join(F.broadcast(t) if total.n else t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("bucket", F.shiftrightunsigned("shuffle_key", 64 - bits)))
    before = (rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
              .withColumn("before", F.sum("words").over(
                  Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
              .select("rank", "bucket", F.coalesce("before", F.lit(0)).alias("before")))
    in_bucket = Window.partitionBy("rank", "bucket").orderBy("shuffle_key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    queued = (rows.withColumn("run", F.sum("size").over(in_bucket)).join(before, ["rank", "bucket"])
              .select("doc_id", "source", "size", "rank", "source_size", "target",
                      (F.col("run") + F.col("before")).alias("run")))
    queued = cut_lineage(queued)
    last = _last_taken(queued, float(total.budget or 0), max_epochs)
    copies = sum((F.when(_taken(_finish(e), last), 1).otherwise(0) for e in range(max_epochs)), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("int")
    return queued.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                         (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def _finish(epoch: Column | int) -> Column:
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    return (e * F.col("source_size") + F.col("run")) / F.col("target")


def _taken(finish: Column, last: tuple[float, int] | None) -> Column:
    if last is None:
        return F.lit(False)
    at, rank = F.lit(last[0]), F.lit(last[1])
    return F.coalesce((finish < at) | ((finish == at) & (F.col("rank") <= rank)), F.lit(False))


def _last_taken(queued: DataFrame, budget: float, max_epochs: int) -> tuple[float, int] | None:
    """Finish time and source rank of the last copy that fits into the budget.

    Within a source finish times rise strictly, so (time, rank) orders all copies of documents
    with words.  The time axis is cut into slices, the slice in which the budget ends is cut again
    until it holds few rows; only its rows are then summed one by one.
    """
    items = (queued.where("size > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])))
             .select("rank", "size", _finish(F.col("epoch")).alias("finish")))
    top = items.agg(F.max("finish")).first()[0]
    if top is None:
        return None
    low, high, left = 0.0, float(top), budget
    while True:
        inside = items.where((F.col("finish") > low) & (F.col("finish") <= high))
        width = (high - low) / SLICES
        slices = (inside.groupBy(F.least(F.ceil((F.col("finish") - low) / width), F.lit(SLICES)).alias("slice"))
                  .agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("finish").alias("first"),
                       F.max("finish").alias("last"))
                  .orderBy("slice").collect())
        end = None
        for s in slices:
            if s.words > left:
                end = s
                break
            left -= s.words
        if end is None:
            row = inside.agg(F.max(F.struct("finish", "rank"))).first()[0]
            return float(row.finish), int(row["rank"])
        inside = items.where((F.col("finish") >= end.first) & (F.col("finish") <= end.last))
        if end.n <= BUCKET_ROWS or end.first == end.last or (end.first <= low and end.last >= high):
            break
        low, high = _below(end.first), end.last
    run = F.sum("size").over(Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0))
    row = inside.withColumn("run", run).where(F.col("run") <= left).agg(F.max(F.struct("finish", "rank"))).first()[0]
    if row is not None:
        return float(row.finish), int(row["rank"])
    row = items.where(F.col("finish") < end.first).agg(F.max(F.struct("finish", "rank"))).first()[0]
    return None if row is None else (float(row.finish), int(row["rank"]))


def _below(x: float) -> float:
    import math
    return math.nextafter(x, -math.inf)
