"""IO1-IO9: readers and writers.  Every writer is one distributed job (no driver collection)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.functions.strings import slug
from ridelens.sources.csv_records import read_records


class MissingInput(FileNotFoundError):
    """An input of a job is absent; the message names the job to run first."""


def read_raw(spark: SparkSession, path: str, columns: Iterable[str] | None = None,
             position: str | None = None, line_breaks: bool = False) -> DataFrame:
    """IO1: CSV with a header, every column text (no inference).  With ``columns`` the schema is
    declared; otherwise the header is read and every field is typed as string.  ``line_breaks`` reads
    files whose quoted fields hold line breaks, still in as many tasks as they have blocks (``csv_records``).

    ``position`` adds a column that orders rows as the files hold them: file name, start of the
    block within the file, then the row within the block (its task reads blocks one after another)."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    if line_breaks:
        return read_records(spark, path, list(columns) if columns is not None else reader.csv(path).columns, position)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    raw = reader.csv(path)
    if position is None:
        return raw
    return raw.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                    F.monotonically_increasing_id().alias("row")).alias(position))


# Types that a text column may have, the narrowest first: Spark type and the text that fits it.
_FITS = (
    ("bigint", lambda c: c.rlike(r"^[+-]?\d{1,18}$")),
    ("double", lambda c: c.rlike(r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))$")),
    ("boolean", lambda c: F.lower(c).isin("true", "false")),
    ("timestamp_ntz", lambda c: c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}") & c.try_cast("timestamp_ntz").isNotNull()),
)


def column_types(raw: DataFrame) -> dict[str, str]:
    """The type of each text column: the narrowest that fits all its values, from one aggregate over all rows.  A column
    without values stays text."""
    cols = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return {}
    row = list(raw.agg(*[e for c in cols for e in (F.count(F.col(f"`{c}`")), *(F.count_if(fits(F.col(f"`{c}`"))) for _, fits in _FITS))]).first())
    out, width = {}, 1 + len(_FITS)
    for i, c in enumerate(cols):
        n, *fit = row[i * width:(i + 1) * width]
        out[c] = next((kind for (kind, _), k in zip(_FITS, fit) if n and k == n), "string")
    return out


def cast_columns(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as the given types; text that does not fit becomes null."""
    return raw.select(*[(F.col(f"`{c}`").try_cast(types[c]) if types.get(c, "string") != "string" else F.col(f"`{c}`")).alias(c)
                        for c in raw.columns])


def read_clean(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet",
               types: dict[str, str] | None = None) -> DataFrame:
    """IO2 / IO3: the cleaned table.  Parquet keeps its types; a CSV is read with ``schema``, or as text whose ``types`` may be
    pinned and else come from ``column_types``, so ``datetime`` is a timestamp again."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if schema is not None:
        return spark.read.option("header", True).schema(schema).csv(path)
    raw = read_raw(spark, path)
    return cast_columns(raw, column_types(raw) if types is None else types)


def require(spark: SparkSession, paths: Iterable[str], job: str) -> None:
    """IO4: fail early, naming the job that produces the missing input."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if not hp.getFileSystem(conf).exists(hp):
            raise MissingInput(f"{p} not found: run {job} first")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """IO5: Parquet by default, CSV with a header on request."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO6: JSON lines, one record per row."""
    df.write.mode(mode).json(path)


def write_by_series(df: DataFrame, path: str, series: str = "series", fmt: str = "parquet",
                    mode: str = "overwrite") -> None:
    """IO7: one folder per series with a file-safe name (ST5), all in one job.  Rows are rebalanced by series first: the small
    pieces of a series meet in one task and one file, and a hot series is split into tasks of the advisory size."""
    out = df.withColumn("series_slug", slug(F.col(series))).hint("rebalance", F.col("series_slug"))
    w = out.write.mode(mode).partitionBy("series_slug")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def write_profile(lines: DataFrame, path: str, order: Iterable[str] = ("segment", "line_no")) -> None:
    """IO9: profile lines as text (sorted by segment and line number; the set is k x metrics lines, so one file)."""
    cols = [c for c in order if c in lines.columns]
    lines.orderBy(*cols).select("line").coalesce(1).write.mode("overwrite").text(path)
