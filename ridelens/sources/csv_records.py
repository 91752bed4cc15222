"""CSV records with line breaks in splittable files (IO1).

A quoted field may hold line breaks, so a block of a file does not know whether it starts inside one.  Two scans
of the lines, both split as Spark splits any text file:

1. one aggregate counts the quotes of every block; whether their number before a block is even follows
   from one row per block;
2. each task then joins the lines of its blocks to records.  What a block holds of a record that began
   before it, or does not end in it, is a fragment; the few fragments are joined in file order.

A record never meets more than its own text, and a file is as many tasks as it has blocks.  A quote within a field is
doubled; a backslash is a sign like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DDL = "file string, block long, seq long, kind string, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


def _starts(lines: DataFrame) -> dict[tuple[str, int], int]:
    """Whether each block starts within a quoted field (1) or not (0)."""
    quotes = F.length(F.regexp_replace("text", '[^"]', ""))
    odd = {}
    for r in lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd")).collect():  # one row per block
        odd.setdefault(r["file"], []).append((r["block"], r["odd"]))
    out = {}
    for file, blocks in odd.items():
        state = 0
        for block, flips in sorted(blocks):
            out[file, block] = state
            state ^= int(flips)
    return out


def _assemble(starts, whole: bool):
    """Records that lie within a block (``whole``), or the fragments: ``open`` (goes on), ``mid``, ``end``."""
    def run(batches):
        key, state, held, kind, seq, out = None, 0, [], None, 0, []

        def flush(last: str):
            if held and ((last == "record") == whole):
                out.append((*key, seq, last, "\n".join(held)))
            held.clear()

        for b in batches:
            for file, block, text in zip(*(b.column(c).to_pylist() for c in ("file", "block", "text"))):
                if (file, block) != key:
                    if key is not None:
                        flush("mid" if kind == "end" else "open")
                    key, state, seq = (file, block), starts.value[file, block], 0
                    kind = "end" if state else "record"
                held.append(text)
                state ^= text.count('"') % 2
                if not state:
                    flush(kind)
                    kind, seq = "record", seq + 1
                if len(out) >= 5000:
                    yield _batch(out)
                    out = []
        if key is not None:
            flush("mid" if kind == "end" else "open")
        if out:
            yield _batch(out)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                      ["file", "block", "seq", "kind", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, seq, text``: every record of the files, where it starts, and its text."""
    lines = _lines(spark, path)
    starts = spark.sparkContext.broadcast(_starts(lines))  # one entry per block
    whole = lines.mapInArrow(_assemble(starts, True), _DDL).drop("kind")
    # at most two fragments per block; an open one and what follows it up to the next open one are one record
    order = Window.partitionBy("file").orderBy("block", "seq")
    pieces = lines.mapInArrow(_assemble(starts, False), _DDL).withColumn("chain", F.sum((F.col("kind") == "open").cast("int")).over(order))
    joined = pieces.groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))).alias("p"))
    joined = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"),
                           F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(joined)


def read_records(spark: SparkSession, path: str, columns: Sequence[str], position: str | None = None) -> DataFrame:
    """The files' records as text columns; each file's first record is its header.  Empty lines are no records.  ``position`` adds a
    column that orders rows as the files hold them."""
    rows = records(spark, path).where("not (block = 0 and seq = 0)").withColumn("text", F.rtrim("text", F.lit("\r"))).where(F.btrim("text") != "")
    ddl = ", ".join(f"`{c}` string" for c in columns)
    fields = F.from_csv("text", ddl, {"multiLine": "true", "escape": '"'})
    out = rows.select(fields.alias("r"), "file", "block", "seq")
    place = [F.struct("file", "block", "seq").alias(position)] if position else []
    return out.select(*[F.col("r").getField(c).alias(c) for c in columns], *place)
