"""Registered queries: readers and writers (IO1-IO8), and FL9, JN3, FC7.

What a query writes goes to a folder of its own in the session's checkpoint folder and is read back from there, so the
oracle compares the tables with what the files hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.operators import distribution, encode, forecast, segment
from ridelens.operators import series as se
from ridelens.plans.queries_clean import TEXT_COLS
from ridelens.plans.queries_forecast import _hourly_sql
from ridelens.plans.queries_segment import _CEN_SQL
from ridelens.plans.registry import _r6, register, round6
from ridelens.session import checkpoint_dir
from ridelens.sources import files
from ridelens.sources.tables import DIRTY_BOOKINGS_SQL, dirty_bookings, table


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


@register("raw_csv", "SELECT " + ", ".join(["CAST(seq AS VARCHAR) AS seq", *(f"nullif({c}, '') AS {c}" for c in TEXT_COLS)]) + f" FROM ({DIRTY_BOOKINGS_SQL}) AS raw")
def q_raw_csv(spark, sf_dir) -> DataFrame:
    """IO1: the bookings as CSV files, read as text in every column (an empty field is a null)."""
    folder = _folder(spark)
    dirty_bookings(spark, sf_dir).select("seq", *TEXT_COLS).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return files.read_raw(spark, folder)


@register("typed_csv", "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority FROM orders")
def q_typed_csv(spark, sf_dir) -> DataFrame:
    """IO2, IO3: orders as CSV; the types are found in the rows, so dates are timestamps again."""
    folder = _folder(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz"), "o_orderpriority")
    files.write_table(orders, folder, "csv")
    return files.read_clean(spark, folder, fmt="csv")


@register("inputs_present", "SELECT 'orders' AS input, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def q_inputs_present(spark, sf_dir) -> DataFrame:
    """IO4: both inputs must be there before either is read."""
    names = ["orders", "customer"]
    files.require(spark, [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names], "the import")
    first, second = (table(spark, sf_dir, n).agg(F.lit(n).alias("input"), F.count("*").alias("n")) for n in names)
    return first.unionByName(second)


@register("parquet_files", "SELECT * FROM customer")
def q_parquet_files(spark, sf_dir) -> DataFrame:
    """IO5."""
    folder = _folder(spark)
    files.write_table(table(spark, sf_dir, "customer"), folder)
    return files.read_clean(spark, folder)


@register("json_files", "SELECT * FROM part")
def q_json_files(spark, sf_dir) -> DataFrame:
    """IO6."""
    folder, part = _folder(spark), table(spark, sf_dir, "part")
    files.write_json(part, folder)
    return spark.read.schema(part.schema).json(folder)


@register("series_files", "WITH" + _hourly_sql() + "\nSELECT regexp_replace(lower(series), '[^\\p{L}\\p{N}]', '_', 'g') AS series_slug, * FROM hourly")
def q_series_files(spark, sf_dir) -> DataFrame:
    """IO7: one folder per series."""
    folder = _folder(spark)
    files.write_by_series(se.hourly_demand(table(spark, sf_dir, "events"), ts="ts", series="event_type"), folder)
    return spark.read.parquet(folder)


@register("encoder_reloaded", round6("""WITH q AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part)
SELECT p_partkey, 'p_retailprice' AS feature, (p_retailprice - q[2]) / (q[3] - q[1]) AS value FROM part, q
UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS DOUBLE) FROM part
UNION ALL SELECT p_partkey, 'p_brand_' || p_brand, 1.0 FROM part""", ["value"]))
def q_encoder_reloaded(spark, sf_dir) -> DataFrame:
    """IO8: a fitted encoder, saved and loaded again, encodes the parts."""
    folder, part = _folder(spark), table(spark, sf_dir, "part")
    encode.fit_encoder(part, {"scaled": ["p_retailprice"], "categorical": ["p_brand"], "passthrough": ["p_size"]}).save(folder)
    return _r6(encode.Encoder.load(folder).transform_long(part, "p_partkey"))


@register("target_without_nulls", "WITH" + _hourly_sql() + "\nSELECT * FROM hourly WHERE y % 3 <> 0")
def q_target_without_nulls(spark, sf_dir) -> DataFrame:
    """FL9: points whose target is null (here every multiple of 3) drop out."""
    hourly = se.hourly_demand(table(spark, sf_dir, "events"), ts="ts", series="event_type")
    return se.drop_null_target(hourly.withColumn("y", F.when(F.col("y") % 3 != 0, F.col("y"))))


@register("labels_on_rows", "WITH " + _CEN_SQL + """,
d AS (SELECT e.vec_id, c.label AS k, sum((e.x - c.value) * (e.x - c.value)) AS d FROM ev e JOIN cen c ON e.i = c.dim GROUP BY 1, 2),
near AS (SELECT vec_id, first(k ORDER BY d, k) AS k FROM d GROUP BY 1),
place AS (SELECT k, row_number() OVER (ORDER BY count(*) DESC, k) - 1 AS segment FROM near GROUP BY k)
SELECT e.vec_id, e.label, CAST(p.segment AS INTEGER) AS segment FROM embeddings e JOIN near n ON n.vec_id = e.vec_id JOIN place p ON p.k = n.k""")
def q_labels_on_rows(spark, sf_dir) -> DataFrame:
    """JN3: every row with its segment, segments numbered by size."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    centres = segment.collect_centres(segment.centres_from_labels(emb, "embedding", "label"), "label")
    return segment.renumber_by_size(segment.assign(emb, "embedding", centres, "near"), "near", "segment").drop("embedding")


@register("forecast_status", "WITH" + _hourly_sql(series_expr="CAST(user_id AS VARCHAR)", where="user_id IS NOT NULL", unit="day") + """,
stats AS (SELECT series, count(*) AS n, count(*) - CAST(floor(count(*) * 0.5) AS BIGINT) AS n_train FROM hourly GROUP BY 1)
SELECT series, n - n_train AS points, CASE WHEN n_train < 2 THEN 'failed' ELSE 'ok' END AS status FROM stats WHERE n > n_train""")
def q_forecast_status(spark, sf_dir) -> DataFrame:
    """FC7: a series that cannot be fitted (fewer than two points to learn from) says so; the others go on."""
    daily = se.hourly_demand(table(spark, sf_dir, "events"), ts="ts", series="user_id", freq="day")
    out = forecast.forecast_additive(se.time_split(daily, ratio=0.5, freq="day"), freq="day")
    return out.groupBy("series", "status").agg(F.count("*").alias("points"))


@register("kde_price_binned", round6("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, stddev_samp(l_extendedprice) AS sd,
  count(l_extendedprice) AS n FROM lineitem),
p AS (SELECT lo, hi, n, sd * power(n, -0.2) AS h FROM s),
b AS (SELECT *, greatest(1, ceil((hi - lo) / h * 40)) AS bins FROM p),
c AS (SELECT *, (hi - lo) / bins AS width FROM b),
placed AS (SELECT (l_extendedprice - lo) / width AS a, least(floor((l_extendedprice - lo) / width), bins - 1) AS low FROM lineitem, c
  WHERE l_extendedprice IS NOT NULL),
w AS (SELECT low AS bin, low + 1 - a AS w FROM placed UNION ALL SELECT low + 1, a - low FROM placed),
m AS (SELECT bin, sum(w) AS w FROM w GROUP BY 1),
g AS (SELECT lo + (hi - lo) * i / 49 AS gx, * FROM c, range(0, 50) t(i))
SELECT gx AS x, 1e6 * sum(m.w * exp(-power((gx - (lo + bin * width)) / h, 2) / 2.0)) / (n * h * sqrt(2 * pi())) AS density_per_million
FROM g, m GROUP BY gx, n, h""", ["x", "density_per_million"]))
def q_kde_price_binned(spark, sf_dir) -> DataFrame:
    """DI3: the binned density of prices."""
    k = distribution.kde(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50, exact=False)
    return _r6(k.select("x", (F.col("density") * 1e6).alias("density_per_million")))
