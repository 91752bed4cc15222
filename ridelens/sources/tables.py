"""The driver's parquet tables and the dirty-bookings projection built from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The dirty-bookings projection of ``events``.  The same expressions run in
# Spark SQL and in DuckDB, so the cleaning operators can be checked against an oracle.
DIRTY_BOOKING_EXPRS = [
    "event_id AS seq",
    """'"' || cast(event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS string) || '"' AS booking_id""",
    """CASE WHEN event_id % 97 = 0 THEN ' NULL ' ELSE '"C' || cast(user_id AS string) || '"' END AS customer_id""",
    "CASE WHEN event_id % 101 = 0 THEN 'bad' ELSE substr(cast(ts AS string), 1, 10) END AS date",
    "CASE WHEN event_id % 103 = 0 THEN 'n/a' ELSE substr(cast(ts AS string), 12, 8) END AS time",
    """CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'view' THEN ' completed '
      WHEN 'click' THEN 'Cancelled by Customer' WHEN 'error' THEN 'No Driver Found'
      ELSE 'Incomplete' END AS booking_status""",
    "event_type AS vehicle_type",
    "CASE WHEN event_id % 5000 = 1 THEN 'Far' ELSE 'Loc' || cast(user_id % 20 AS string) END AS pickup_location",
    """CASE WHEN event_id % 13 = 0 THEN 'N/A'
      WHEN event_type IN ('click', 'error') AND event_id % 2 = 0 THEN 'null'
      ELSE replace(cast(value AS string), '.', ',') END AS booking_value""",
    "CASE WHEN event_id % 11 = 0 THEN '' ELSE ' ' || regexp_extract(props, '[0-9]+', 0) || ' ' END AS ride_distance",
    "CASE WHEN event_id % 10 < 4 THEN 'NaN' ELSE cast(1 + event_id % 5 AS string) END AS customer_rating",
    "CASE WHEN event_id % 10 < 7 THEN 'None' ELSE cast(1 + user_id % 5 AS string) END AS driver_ratings",
    "CASE WHEN event_type = 'click' THEN '1' ELSE 'nan' END AS cancelled_rides_by_customer",
    "CASE WHEN event_type = 'click' THEN 'Change, of plan' ELSE ' NaN ' END AS reason_for_cancelling_by_customer",
    """CASE WHEN event_id % 200 = 0 THEN 'Cheque' WHEN event_id % 7 = 0 THEN 'none'
      WHEN event_id % 3 = 0 THEN 'UPI' WHEN event_id % 3 = 1 THEN 'Cash' ELSE 'Card' END AS payment_method""",
]

DIRTY_BOOKINGS_SQL = "SELECT\n  " + ",\n  ".join(DIRTY_BOOKING_EXPRS) + "\nFROM events"


def dirty_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text booking table (plus the ``seq`` row order) derived from ``events``."""
    return table(spark, sf_dir, "events").selectExpr(*DIRTY_BOOKING_EXPRS)


# TPC-H order status as a booking status.
ORDER_STATUS = {"F": "Completed", "O": "Incomplete", "P": "Cancelled by Customer"}


def orders_as_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` in booking terms: one booking per order, the customer key as customer,
    the priority as vehicle type and the total price as booking value."""
    from pyspark.sql import functions as F
    status = F.create_map(*[x for k, v in ORDER_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("booking_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").alias("datetime"),
        status[F.col("o_orderstatus")].alias("booking_status"),
        F.col("o_orderpriority").alias("vehicle_type"),
        F.col("o_totalprice").alias("booking_value"),
    )


ORDERS_AS_BOOKINGS_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS booking_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  o_orderdate AS datetime,
  CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Incomplete' WHEN 'P' THEN 'Cancelled by Customer' END
    AS booking_status,
  o_orderpriority AS vehicle_type, o_totalprice AS booking_value
FROM orders"""
