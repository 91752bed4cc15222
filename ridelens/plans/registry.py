"""Query registry: one Spark callable and, where SQL can express it, one DuckDB oracle.

Each Spark callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables.
Double columns are rounded to 6 decimals on both sides (``_r6`` / ``round6``) unless the
operator rounds itself.  Column names match between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r6(df: DataFrame) -> DataFrame:
    """Round every double/float column to 6 decimals (oracle hygiene)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round6(sql: str, cols: list[str]) -> str:
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"


