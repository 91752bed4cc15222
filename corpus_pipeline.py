"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``ridelens.llm``.

Each stage is written as Parquet and read again as the next one's input.  A stage takes all rows its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.decontaminate import contaminated
from ridelens.llm.line_dedup import dedup_lines
from ridelens.llm.mixing import mix_sources
from ridelens.llm.ngram_join import ngram_jaccard_join
from ridelens.llm.quality import fit_quality, held_out_fold, keep_good, statistics
from ridelens.session import checkpoint_dir, cut_lineage
from ridelens.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, all rows and columns as they are.

    It is fitted on the documents whose label it may see; the others are read once, to be scored.  Null and empty texts
    are scored like any other; without labels all documents score alike; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    marked = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id")).where(held_out_fold(F.col("doc_id")) != 0)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marked.distinct(), "doc_id", "left_semi")
    return keep_good(docs, fit_quality(cut_lineage(statistics(train)), labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are near copies of earlier ones; a document whose lines all are goes.  Null, empty and blank
    texts have no lines and stay."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id (null last), then of the smallest text hash.

    Rows are told apart by id and text; repeated rows are one.  Null and empty texts link with nothing.  Columns of any name
    pass through.
    """
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")
    parts = ngram_jaccard_join(rows.select(F.col("row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    placed = rows.select("row_key", "doc_id", F.xxhash64("text").alias("text_key")).join(parts, "row_key")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "row_key")
    kept = placed.groupBy("component_id").agg(F.min(order).alias("low")).select("low.row_key")
    return rows.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows are told apart by their text.  Null and empty texts hold none; an empty
    benchmark removes nothing; columns of any name pass through."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = contaminated(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("text_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("text_key"))
    return rows.join(leaks, "text_key", "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often.  Documents without words are never taken."""
    return mix_sources(docs).where("copies > 0")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixture", mixture)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to ``documents``."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
