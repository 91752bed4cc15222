"""Registered queries: cleaning operators (ST, DT, FL, IM, FE2, FE3) on the dirty bookings.

The dirty bookings are a fixed projection of ``events`` (``sources.tables``) that runs in both
engines.  The oracle SQL below re-states every rule in DuckDB independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.functions import dates, strings
from ridelens.operators import clean
from ridelens.plans import jobs
from ridelens.plans.registry import _r6, register, round6
from ridelens.sources.tables import DIRTY_BOOKINGS_SQL, dirty_bookings, table

TEXT_COLS = ["booking_id", "customer_id", "date", "time", "booking_status", "vehicle_type", "pickup_location",
             "booking_value", "ride_distance", "customer_rating", "driver_ratings", "cancelled_rides_by_customer",
             "reason_for_cancelling_by_customer", "payment_method"]
CATEGORY_COLS = ["booking_status", "vehicle_type", "pickup_location", "driver_ratings",
                 "reason_for_cancelling_by_customer", "payment_method", "day_name", "time_of_day"]
# Written out here, not imported from the operators, so that a wrong value there shows.
TOKENS_SQL = "'', 'null', 'none', 'na', 'n/a', 'nan'"
NUMBER_RE_SQL = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _null_token(x: str) -> str:
    return f"CASE WHEN lower({_strip(x)}) IN ({TOKENS_SQL}) THEN NULL ELSE {_strip(x)} END"


def _parse(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUMBER_RE_SQL}') THEN TRY_CAST({x} AS DOUBLE) END"


def _dot(x: str) -> str:
    return f"replace({x}, ',', '.')"


def _norm(x: str) -> str:
    return f"coalesce({_strip(f'lower({x})')}, '')"


_NN_SQL = "nn AS (SELECT seq, " + ", ".join(
    (f"regexp_replace({_null_token(c)}, '^\"|\"$', '', 'g') AS {c}" if c in ("booking_id", "customer_id")
     else f"{_null_token(c)} AS {c}") for c in TEXT_COLS) + " FROM raw)"

_CAL_SQL = """
dt AS (SELECT * EXCLUDE (date, time), TRY_CAST(date || ' ' || time AS TIMESTAMP) AS datetime FROM nn),
cal AS (SELECT *, CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS month,
  CAST(day(datetime) AS INTEGER) AS day, CAST(hour(datetime) AS INTEGER) AS hour,
  CAST(isodow(datetime) - 1 AS INTEGER) AS dow, dayname(datetime) AS day_name,
  CAST(coalesce(isodow(datetime) - 1 IN (5, 6), false) AS INTEGER) AS is_weekend,
  CAST(coalesce(hour(datetime) IN (7, 8, 9, 17, 18, 19, 20), false) AS INTEGER) AS is_peak,
  CASE WHEN datetime IS NULL THEN NULL WHEN hour(datetime) >= 5 AND hour(datetime) < 12 THEN 'morning'
       WHEN hour(datetime) >= 12 AND hour(datetime) < 17 THEN 'afternoon'
       WHEN hour(datetime) >= 17 AND hour(datetime) < 21 THEN 'evening' ELSE 'night' END AS time_of_day
FROM dt)"""

_DEDUP_SQL = """
dd AS (SELECT * EXCLUDE (rn, seq) FROM (
  SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY seq) AS rn FROM cal) WHERE rn = 1)"""

_FLAGS_SQL = f"""
fl AS (SELECT *, CAST({_norm('booking_status')} = 'completed' AS INTEGER) AS is_completed,
  CAST(contains({_norm('booking_status')}, 'incomplete') AS INTEGER) AS is_incomplete,
  CAST(contains({_norm('booking_status')}, 'cancel') OR contains({_norm('booking_status')}, 'no driver') AS INTEGER)
    AS is_cancelled
FROM dd)"""

_PREP_SQL = ("WITH raw AS (\n" + DIRTY_BOOKINGS_SQL + "\n),\n" + _NN_SQL + "," + _CAL_SQL + "," + _DEDUP_SQL + ","
             + _FLAGS_SQL)

_PROFILE_COLS = ["booking_status", "vehicle_type", "pickup_location", "booking_value", "ride_distance",
                 "customer_rating", "driver_ratings", "cancelled_rides_by_customer",
                 "reason_for_cancelling_by_customer", "payment_method", "day_name", "time_of_day"]

# Data-dependent schema: the decision below is the one ``cast_profile`` computes on these tables
# (checked separately by the ``cast_profile`` query); the oracle states the resulting types.
_TO_DOUBLE = ["booking_value", "ride_distance", "customer_rating"]

_IMPUTE_SQL = f"""
im AS (SELECT booking_id, customer_id, datetime, year, month, day, hour, dow, day_name, is_weekend, is_peak,
  time_of_day, is_completed, is_incomplete, is_cancelled,
  {_dot('booking_status')} AS booking_status, {_dot('vehicle_type')} AS vehicle_type,
  {_dot('pickup_location')} AS pickup_location, {_dot('driver_ratings')} AS driver_ratings,
  coalesce({_dot('reason_for_cancelling_by_customer')}, 'Not Applicable') AS reason_for_cancelling_by_customer,
  coalesce({_dot('payment_method')}, 'Unknown') AS payment_method,
  coalesce({_parse(_dot('cancelled_rides_by_customer'))}, 0.0) AS cancelled_rides_by_customer,
  CASE WHEN is_cancelled = 1 THEN coalesce({_parse(_dot('booking_value'))}, 0.0)
       ELSE {_parse(_dot('booking_value'))} END AS booking_value,
  CASE WHEN is_cancelled = 1 THEN coalesce({_parse(_dot('ride_distance'))}, 0.0)
       ELSE {_parse(_dot('ride_distance'))} END AS ride_distance,
  {_parse(_dot('customer_rating'))} AS customer_rating
FROM fl)"""


def _cap_sql(src: str, cols: list[str], out: str) -> str:
    bounds = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in cols)
    rep = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, b.{c}_lo), b.{c}_hi) END AS {c}"
                    for c in cols)
    return (f"{out}_b AS (SELECT {bounds} FROM {src}),\n"
            f"{out} AS (SELECT * EXCLUDE ({', '.join(f'{c}_lo, {c}_hi' for c in cols)}) REPLACE ({rep}) "
            f"FROM {src}, {out}_b b)")


def _rare_sql(src: str, fracs: dict[str, float], out: str) -> str:
    parts = []
    for c, f in fracs.items():
        n = f"(SELECT count(*) FROM {src})"
        parts.append(
            f"CASE WHEN (SELECT count({c}) FROM {src}) = 0 THEN {c} "
            f"WHEN {c} IS NULL THEN CASE WHEN (SELECT count(*) FROM {src} WHERE {c} IS NULL) / {n} >= {f!r} "
            f"THEN NULL ELSE 'Other' END "
            f"WHEN {c} IN (SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) / {n} >= {f!r}) "
            f"THEN {c} ELSE 'Other' END AS {c}")
    return f"{out} AS (SELECT * REPLACE ({', '.join(parts)}) FROM {src})"


def _prepared(spark, sf_dir):
    return jobs.prepare_bookings(dirty_bookings(spark, sf_dir))


@register("dirty_bookings", DIRTY_BOOKINGS_SQL)
def q_dirty_bookings(spark, sf_dir):
    """IO1 stand-in: the all-text booking table derived from events."""
    return dirty_bookings(spark, sf_dir)


@register("snake_columns", """SELECT event_id AS event_id, ts AS time_stamp, event_type AS bookingstatus,
  value AS booking_value_inr, props AS props_json FROM events""")
def q_snake_columns(spark, sf_dir):
    """ST1: messy header names to snake_case."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias(" Event ID "), F.col("ts").alias("Time  Stamp"),
        F.col("event_type").alias("Booking-Status"), F.col("value").alias("Booking Value (INR)"),
        F.col("props").alias("props (json)"))
    return strings.snake_columns(ev)


@register("normalize_nulls", "WITH raw AS (\n" + DIRTY_BOOKINGS_SQL + "\n),\n" + _NN_SQL + "\nSELECT * FROM nn")
def q_normalize_nulls(spark, sf_dir):
    """ST2 + ST3: trimmed text, null tokens -> null, quotes off the identifiers."""
    return strings.strip_quotes(strings.normalize_nulls(dirty_bookings(spark, sf_dir)))


@register("slug_norm", f"""SELECT seq, regexp_replace(lower(booking_status), '[^\\p{{L}}\\p{{N}}]', '_', 'g') AS status_slug,
  {_norm('booking_status')} AS status_norm, regexp_replace(lower(reason_for_cancelling_by_customer),
  '[^\\p{{L}}\\p{{N}}]', '_', 'g') AS reason_slug, {_norm('customer_rating')} AS rating_norm,
  {_dot('booking_value')} AS value_dot FROM ({DIRTY_BOOKINGS_SQL}) AS raw""")
def q_slug_norm(spark, sf_dir):
    """ST4, ST5, ST6 on raw text."""
    raw = dirty_bookings(spark, sf_dir)
    return raw.select("seq", strings.slug(F.col("booking_status")).alias("status_slug"),
                      strings.norm_str(F.col("booking_status")).alias("status_norm"),
                      strings.slug(F.col("reason_for_cancelling_by_customer")).alias("reason_slug"),
                      strings.norm_str(F.col("customer_rating")).alias("rating_norm"),
                      F.replace(F.col("booking_value"), F.lit(","), F.lit(".")).alias("value_dot"))


@register("calendar_features", "WITH raw AS (\n" + DIRTY_BOOKINGS_SQL + "\n),\n" + _NN_SQL + "," + _CAL_SQL +
          "\nSELECT seq, datetime, year, month, day, hour, dow, day_name, is_weekend, is_peak, time_of_day FROM cal")
def q_calendar_features(spark, sf_dir):
    """DT1-DT8: parse date + time, calendar features, flags, time of day."""
    df = dates.calendar_features(dates.parse_datetime(strings.normalize_nulls(dirty_bookings(spark, sf_dir))))
    return df.select("seq", "datetime", "year", "month", "day", "hour", "dow", "day_name", "is_weekend",
                     "is_peak", "time_of_day")


@register("date_formats", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS month_first, CAST(o_orderdate AS TIMESTAMP) AS day_first, "
          "CAST(o_orderdate AS TIMESTAMP) AS named, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 13 HOUR AS clocked FROM orders")
def q_date_formats(spark, sf_dir):
    """DT1: order dates as text in four spellings; each column's format is found in its rows."""
    day = F.col("o_orderdate")
    text = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(day, "MM/dd/yyyy").alias("month_first"), F.date_format(day, "dd/MM/yyyy HH:mm:ss").alias("day_first"),
        F.date_format(day, "d MMMM yyyy").alias("named"), F.concat(F.date_format(day, "d.M.yyyy"), F.lit(" 1:00 PM")).alias("clocked"))
    for c in text.columns[1:]:
        text = dates.parse_datetime(text, date=c, time="", out=c + "_read").withColumnRenamed(c + "_read", c)
    return text


@register("column_types", "SELECT * FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), "
          "('value', 'double')) AS t(column_name, kind)")
def q_column_types(spark, sf_dir):
    """IO2: the types of ``events`` read as text, found in all its rows."""
    from ridelens.sources import files
    events = table(spark, sf_dir, "events").select(*[F.col(c).cast("string").alias(c) for c in ("event_id", "ts", "user_id", "event_type", "value")])
    return spark.createDataFrame(list(files.column_types(events).items()), "column_name string, kind string")


@register("dedup_bookings", _PREP_SQL + "\nSELECT * FROM fl")
def q_dedup_bookings(spark, sf_dir):
    """FL1-FL4: dedup on booking_id (smallest seq wins) after names/nulls/dates, then status flags."""
    return _prepared(spark, sf_dir)


_LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus"]


@register("dedup_lineitem", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, "
          "l_linenumber ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in _LI_ORDER) + ") AS rn FROM lineitem) "
          "WHERE rn = 1")
def q_dedup_lineitem(spark, sf_dir):
    """FL1 on real duplicates: (l_orderkey, l_linenumber), first by ship date then the other columns."""
    return clean.dedup(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LI_ORDER[:3])


_PROFILE_SQL = (_PREP_SQL + "\nSELECT column_name, round(share, 6) AS share, share >= 0.4 AS to_double FROM (\n"
                + "\nUNION ALL ".join(
                    f"SELECT '{c}' AS column_name, avg(CASE WHEN {_parse(_dot(c))} IS NOT NULL THEN 1.0 ELSE 0.0 END)"
                    f" AS share FROM fl" for c in _PROFILE_COLS) + ") s")


@register("cast_profile", _PROFILE_SQL)
def q_cast_profile(spark, sf_dir):
    """IM1 step 1: share of rows per text column that parse as numbers, and the decision."""
    prof = clean.cast_profile_df(_prepared(spark, sf_dir))
    return prof.select("column_name", F.round("share", 6).alias("share"), "to_double")


@register("impute_bookings", round6(_PREP_SQL + "," + _IMPUTE_SQL + "\nSELECT * FROM im",
                                    ["booking_value", "ride_distance", "customer_rating", "cancelled_rides_by_customer"]))
def q_impute_bookings(spark, sf_dir):
    """IM1-IM5 + ST4: smart cast, forced count cast, zero on cancelled rides, constant fills."""
    return _r6(jobs.impute_bookings(_prepared(spark, sf_dir))[0])


@register("quantile_cap_lineitem", round6(
    "WITH " + _cap_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "capped") +
    "\nSELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax FROM capped",
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def q_quantile_cap_lineitem(spark, sf_dir):
    """FE2: clip four columns to their exact 1 % / 99 % quantiles."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                                 "l_extendedprice", "l_discount", "l_tax")
    return _r6(clean.quantile_cap(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


_RARE_FRACS = {"payment_method": 0.01, "pickup_location": 0.0005, "customer_rating": 0.01, "vehicle_type": 0.01,
               "customer_id": 0.01}


@register("collapse_rare_bookings", "WITH raw AS (\n" + DIRTY_BOOKINGS_SQL + "\n),\n" + _NN_SQL + ",\n" +
          _rare_sql("nn", _RARE_FRACS, "rr") + "\nSELECT seq, " + ", ".join(_RARE_FRACS) + " FROM rr")
def q_collapse_rare_bookings(spark, sf_dir):
    """FE3: rare values (share of all rows, nulls counted) -> "Other"; includes an all-rare column."""
    nn = strings.strip_quotes(strings.normalize_nulls(dirty_bookings(spark, sf_dir)))
    return clean.collapse_rare(nn, _RARE_FRACS).select("seq", *_RARE_FRACS)


_CLEAN_SQL = (_PREP_SQL + "," + _IMPUTE_SQL + ",\n" + _cap_sql("im", _TO_DOUBLE, "cp") + ",\n"
              + _rare_sql("cp", clean.rare_fracs(CATEGORY_COLS), "rr"))


@register("clean_bookings", round6(_CLEAN_SQL + "\nSELECT * FROM rr",
                                   _TO_DOUBLE + ["cancelled_rides_by_customer"]))
def q_clean_bookings(spark, sf_dir):
    """The whole cleaning job on the dirty bookings."""
    return _r6(jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0])
