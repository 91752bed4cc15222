"""Registered queries: customers, joins, segment summaries, KPIs, encoders, segmentation and
distribution checks.

Customers come from two sources: the cleaned dirty bookings (``events``) and ``orders`` read
as bookings, whose customers carry ``customer.c_mktsegment`` as a deterministic segment, so
that every summary and KPI over segments has an exact oracle.  K-means itself is random-start
and is checked by properties (rows-only here, tests in ``tests/``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.functions import dates
from ridelens.operators import clean, customers, distribution, encode, kpi, segment
from ridelens.operators import forecast as fc
from ridelens.operators import metrics as me
from ridelens.operators import series as se
from ridelens.plans import jobs
from ridelens.plans.queries_clean import _CLEAN_SQL, _parse
from ridelens.plans.queries_forecast import _ALL_FC_SQL, _METRICS_V2_SQL, _events_split, _hourly_sql
from ridelens.plans.registry import _r6, register, round6
from ridelens.sources.tables import ORDERS_AS_BOOKINGS_SQL, dirty_bookings, orders_as_bookings, table

FEATURES = list(customers.CUSTOMER_FEATURES)
DOUBLE_FEATURES = [c for c in FEATURES if c not in ("total_trips", "completed_trips", "incomplete_trips",
                                                    "cancelled_trips")]


def _rhe(x: str, digits: int = 2) -> str:
    s = float(10 ** digits)
    return f"(round_even(CAST({x} AS DOUBLE) * {s}, 0) / {s})"


def _status_sql(c: str = "booking_status") -> str:
    n = f"coalesce(regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g'), '')"
    return (f"CAST({n} = 'completed' AS INTEGER) AS is_completed, "
            f"CAST(contains({n}, 'incomplete') AS INTEGER) AS is_incomplete, "
            f"CAST(contains({n}, 'cancel') OR contains({n}, 'no driver') AS INTEGER) AS is_cancelled")


def _features_sql(src: str, means: dict[str, str]) -> str:
    """AG1 + AG2 over ``src``; ``means`` maps output name -> SQL expression (or NULL)."""
    mean_sql = ", ".join(f"avg({e}) AS {o}" if e != "NULL" else f"CAST(NULL AS DOUBLE) AS {o}" for o, e in means.items())
    return f"""SELECT *, CASE WHEN total_trips = 0 THEN NULL ELSE completed_trips / total_trips END AS completion_rate,
  CASE WHEN total_trips = 0 THEN NULL ELSE cancelled_trips / total_trips END AS cancel_rate FROM (
  SELECT customer_id, count(booking_id) AS total_trips,
    CAST(coalesce(sum(is_completed), 0) AS BIGINT) AS completed_trips,
    CAST(coalesce(sum(is_incomplete), 0) AS BIGINT) AS incomplete_trips,
    CAST(coalesce(sum(is_cancelled), 0) AS BIGINT) AS cancelled_trips, {mean_sql},
    avg(is_weekend) AS weekend_ratio, avg(is_peak) AS peak_ratio
  FROM {src} WHERE customer_id IS NOT NULL GROUP BY 1) f"""


# ------------------------------------------------------------------ customers from cleaned events
_EV_MEANS = {"avg_booking_value": "booking_value", "avg_ride_distance": "ride_distance",
             "avg_driver_rating": _parse("driver_ratings"), "avg_customer_rating": "customer_rating",
             "avg_vtat": "NULL", "avg_ctat": "NULL"}
_EV_CUST_SQL = _CLEAN_SQL + ",\ncf AS (" + _features_sql("rr", _EV_MEANS) + ")"


def _event_customers(spark, sf_dir):
    return customers.customer_features(jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0])


@register("customer_features", round6(_EV_CUST_SQL + "\nSELECT * FROM cf", DOUBLE_FEATURES))
def q_customer_features(spark, sf_dir):
    """AG1 + AG2 on the cleaned bookings."""
    return _r6(_event_customers(spark, sf_dir))


# ------------------------------------------------------------------ customers from orders
_OB_SQL = f"""ob AS ({ORDERS_AS_BOOKINGS_SQL}),
obf AS (SELECT *, CAST(coalesce(isodow(datetime) - 1 IN (5, 6), false) AS INTEGER) AS is_weekend,
  CAST(coalesce(hour(datetime) IN (7, 8, 9, 17, 18, 19, 20), false) AS INTEGER) AS is_peak, {_status_sql()} FROM ob)"""
_OB_MEANS = {"avg_booking_value": "booking_value", "avg_ride_distance": "NULL", "avg_driver_rating": "NULL",
             "avg_customer_rating": "NULL", "avg_vtat": "NULL", "avg_ctat": "NULL"}
_OB_CUST_SQL = ("WITH " + _OB_SQL + ",\nocf AS (" + _features_sql("obf", _OB_MEANS) + "),\n"
                "cs AS (SELECT ocf.*, c.c_mktsegment AS customer_segment FROM ocf LEFT JOIN customer c "
                "ON ocf.customer_id = CAST(c.c_custkey AS VARCHAR))")


def _order_trips(spark, sf_dir):
    return clean.status_flags(dates.calendar_features(orders_as_bookings(spark, sf_dir)))


def _order_customers(spark, sf_dir):
    feats = customers.customer_features(_order_trips(spark, sf_dir))
    seg = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"),
                                                  F.col("c_mktsegment").alias("customer_segment"))
    return feats.join(seg, "customer_id", "left")


@register("customer_features_orders", round6(_OB_CUST_SQL + "\nSELECT * FROM cs", DOUBLE_FEATURES))
def q_customer_features_orders(spark, sf_dir):
    """AG1 + AG2 on orders as bookings, with the customer's market segment (JN1-style lookup)."""
    return _r6(_order_customers(spark, sf_dir))


_TWS_SQL = (_OB_CUST_SQL + ",\ntws AS (SELECT obf.*, cs.customer_segment FROM obf LEFT JOIN "
            "(SELECT customer_id, customer_segment FROM cs WHERE customer_id IS NOT NULL) cs "
            "ON obf.customer_id = cs.customer_id)")


def _trips_with_segment(spark, sf_dir):
    return customers.trips_with_segment(_order_trips(spark, sf_dir), _order_customers(spark, sf_dir))


@register("trips_with_segment", round6(_TWS_SQL + "\nSELECT booking_id, customer_id, datetime, booking_status, "
                                       "vehicle_type, booking_value, customer_segment FROM tws", ["booking_value"]))
def q_trips_with_segment(spark, sf_dir):
    """JN1: every trip with its customer's segment (left join; AQE picks the strategy)."""
    return _r6(_trips_with_segment(spark, sf_dir).select(
        "booking_id", "customer_id", "datetime", "booking_status", "vehicle_type", "booking_value", "customer_segment"))


_SUMMARY_SQL = ("SELECT customer_segment, " + ", ".join(f"{_rhe(f'avg({c})')} AS {c}" for c in FEATURES)
                + " FROM cs GROUP BY 1")


@register("segment_summary", _OB_CUST_SQL + ",\nsm AS (" + _SUMMARY_SQL + ")\nSELECT * FROM sm")
def q_segment_summary(spark, sf_dir):
    """AG3: rounded (half-even) means of the 14 features per segment."""
    return customers.segment_summary(_order_customers(spark, sf_dir), "customer_segment", FEATURES)


@register("segment_sizes", _OB_CUST_SQL + "\nSELECT customer_segment, count(*) AS n FROM cs GROUP BY 1")
def q_segment_sizes(spark, sf_dir):
    """AG4."""
    return customers.segment_sizes(_order_customers(spark, sf_dir), "customer_segment")


@register("crosstab_segment_priority", _TWS_SQL + f"""
, cells AS (SELECT customer_segment, vehicle_type AS value, count(*) AS cnt FROM tws
  WHERE customer_segment IS NOT NULL AND vehicle_type IS NOT NULL GROUP BY 1, 2)
SELECT c.customer_segment, c.value, {_rhe('c.cnt * 100.0 / t.row_total')} AS pct FROM cells c
JOIN (SELECT customer_segment, sum(cnt) AS row_total FROM cells GROUP BY 1) t ON c.customer_segment = t.customer_segment""")
def q_crosstab(spark, sf_dir):
    """AG5: segment x category in row percent (long form)."""
    return customers.crosstab_pct(_trips_with_segment(spark, sf_dir), "customer_segment", "vehicle_type")


_PROFILE_SQL = (_OB_CUST_SQL + ",\npw AS (SELECT customer_segment, CAST(count(*) AS DOUBLE) AS n, "
                + ", ".join(f"{_rhe(f'avg({c})')} AS {c}" for c in FEATURES) + " FROM cs GROUP BY 1),\n"
                "pl AS (" + "\nUNION ALL ".join(
                    ["SELECT customer_segment, CAST(0 AS INTEGER) AS line_no, 'n' AS metric, n AS value FROM pw"]
                    + [f"SELECT customer_segment, {i} AS line_no, 'avg_{c}' AS metric, {c} AS value FROM pw"
                       for i, c in enumerate(FEATURES, 1)]) + ")")


@register("segment_profile", _PROFILE_SQL + "\nSELECT * FROM pl")
def q_segment_profile(spark, sf_dir):
    """SG9: size + rounded means per segment, one row per (segment, metric)."""
    return customers.segment_profile(_order_customers(spark, sf_dir), "customer_segment", FEATURES)


# ------------------------------------------------------------------ KPIs (KP1-KP5, KP10)
@register("kpi_overview", round6(_OB_CUST_SQL + """
SELECT count(*) AS n_rows, count(DISTINCT customer_segment) AS n_segments, avg(avg_ride_distance) AS mean_distance,
  avg(avg_booking_value) AS mean_value FROM cs""", ["mean_distance", "mean_value"]))
def q_kpi_overview(spark, sf_dir):
    """KP1."""
    return _r6(kpi.segment_overview(_order_customers(spark, sf_dir)))


@register("kpi_share", _OB_CUST_SQL + f"""
SELECT customer_segment, n, {_rhe('n * 100.0 / sum(n) OVER ()')} AS share_pct FROM (
  SELECT customer_segment, count(*) AS n FROM cs GROUP BY 1) s""")
def q_kpi_share(spark, sf_dir):
    """KP2."""
    return kpi.segment_share(_order_customers(spark, sf_dir))


@register("kpi_overall", round6(_OB_CUST_SQL + """
SELECT CAST(sum(total_trips) AS DOUBLE) AS total_trips, sum(completed_trips) / sum(total_trips) AS completion_rate,
  (SELECT sum(avg_booking_value * total_trips) / sum(total_trips) FROM cs WHERE avg_booking_value IS NOT NULL) AS mean_value
FROM cs""", ["total_trips", "completion_rate", "mean_value"]))
def q_kpi_overall(spark, sf_dir):
    """KP3 (weighted: true totals)."""
    return _r6(kpi.overall_kpis(_order_customers(spark, sf_dir)))


@register("kpi_overall_unweighted", round6(_OB_CUST_SQL + ",\nsm AS (" + _SUMMARY_SQL + """)
SELECT sum(total_trips) AS total_trips, sum(completed_trips) / sum(total_trips) AS completion_rate,
  avg(avg_booking_value) AS mean_value FROM sm""", ["total_trips", "completion_rate", "mean_value"]))
def q_kpi_overall_unweighted(spark, sf_dir):
    """KP3 as the dashboard does it: over rounded segment means."""
    summary = customers.segment_summary(_order_customers(spark, sf_dir), "customer_segment", FEATURES)
    return _r6(kpi.overall_kpis(None, summary, weighted=False))


@register("kpi_status", _OB_CUST_SQL + ",\nsm AS (" + _SUMMARY_SQL + f""")
SELECT customer_segment, {_rhe('completed_trips / total_trips * 100.0')} AS completion_pct, completed_trips, cancelled_trips,
  incomplete_trips FROM sm""")
def q_kpi_status(spark, sf_dir):
    """KP4."""
    summary = customers.segment_summary(_order_customers(spark, sf_dir), "customer_segment", FEATURES)
    return kpi.segment_status(summary)


@register("kpi_rename", _OB_CUST_SQL + ",\nsm AS (" + _SUMMARY_SQL + """)
SELECT * RENAME (customer_segment AS "Segment", total_trips AS "Total Trips") FROM sm""")
def q_kpi_rename(spark, sf_dir):
    """KP5: display names, only for columns that exist."""
    summary = customers.segment_summary(_order_customers(spark, sf_dir), "customer_segment", FEATURES)
    return kpi.rename_existing(summary, {"customer_segment": "Segment", "total_trips": "Total Trips",
                                         "not_a_column": "Ignored"})


@register("kpi_preview", round6(_OB_CUST_SQL + """
SELECT customer_id, customer_segment, total_trips, avg_booking_value FROM cs
ORDER BY total_trips DESC, customer_id LIMIT 5""", ["avg_booking_value"]))
def q_kpi_preview(spark, sf_dir):
    """KP10: top rows of chosen columns (a top-n report)."""
    cust = _order_customers(spark, sf_dir)
    return _r6(kpi.preview(cust, ["customer_id", "customer_segment", "total_trips", "avg_booking_value", "absent"],
                           5, [F.desc("total_trips"), "customer_id"]))


# ------------------------------------------------------------------ KPIs over forecast metrics (KP6-KP9)
_MT_SQL = _ALL_FC_SQL + ",\nmt AS (" + _METRICS_V2_SQL + ")"


def _metrics(spark, sf_dir):
    return me.forecast_metrics(fc.run_forecasts(_events_split(spark, sf_dir)))


@register("kpi_improvement", round6(_MT_SQL + """
SELECT b.series, b.mae AS base_mae, m.mae AS model_mae, (b.mae - m.mae) / b.mae * 100 AS improvement_pct,
  CASE WHEN m.mae < b.mae THEN 'better' ELSE 'worse' END AS verdict
FROM mt b JOIN mt m ON b.series = m.series WHERE b.model = 'baseline_last' AND m.model = 'additive_log1p'""",
                                    ["base_mae", "model_mae", "improvement_pct"]))
def q_kpi_improvement(spark, sf_dir):
    """KP6."""
    return _r6(kpi.improvement(_metrics(spark, sf_dir), "baseline_last", "additive_log1p"))


@register("kpi_metric_overview", round6(_MT_SQL + """
SELECT avg(mae) AS mean_mae, avg(mape) AS mean_mape, count(DISTINCT series) AS n_series FROM mt
WHERE model = 'additive_log1p'""", ["mean_mae", "mean_mape"]))
def q_kpi_metric_overview(spark, sf_dir):
    """KP7."""
    return _r6(kpi.metric_overview(_metrics(spark, sf_dir), "additive_log1p"))


@register("kpi_rank_series", round6(_MT_SQL + """
SELECT upper(series) AS series, mae, rmse, mape FROM mt WHERE model = 'baseline_weekly'""", ["mae", "rmse", "mape"]))
def q_kpi_rank_series(spark, sf_dir):
    """KP8."""
    return _r6(kpi.rank_series(_metrics(spark, sf_dir), "baseline_weekly"))


@register("kpi_tail", "WITH" + _hourly_sql() + """
SELECT h.* FROM hourly h JOIN (SELECT series, max(ds) AS e FROM hourly GROUP BY 1) m ON h.series = m.series
WHERE h.ds > m.e - INTERVAL 20 HOUR""")
def q_kpi_tail(spark, sf_dir):
    """KP9: last 20 hours of every series."""
    return kpi.tail(se.hourly_demand(table(spark, sf_dir, "events"), ts="ts", series="event_type"), 20)


# ------------------------------------------------------------------ imputers, scalers, one-hot
@register("median_impute", round6(_CLEAN_SQL + """
SELECT booking_id, coalesce(booking_value, (SELECT quantile_cont(booking_value, 0.5) FROM rr)) AS booking_value,
  coalesce(customer_rating, (SELECT quantile_cont(customer_rating, 0.5) FROM rr)) AS customer_rating FROM rr""",
                                  ["booking_value", "customer_rating"]))
def q_median_impute(spark, sf_dir):
    """IM6: exact median imputer."""
    df = jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0].select("booking_id", "booking_value", "customer_rating")
    return _r6(encode.apply_fill(df, encode.fit_median(df, ["booking_value", "customer_rating"])))


def _mode_sql(c: str, src: str = "rr") -> str:
    return (f"(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 1) "
            f"ORDER BY n DESC, {c} LIMIT 1)")


@register("mode_impute", round6(_CLEAN_SQL + f"""
SELECT booking_id, coalesce(driver_ratings, {_mode_sql('driver_ratings')}) AS driver_ratings,
  coalesce(customer_rating, {_mode_sql('customer_rating')}) AS customer_rating,
  coalesce(time_of_day, {_mode_sql('time_of_day')}) AS time_of_day FROM rr""", ["customer_rating"]))
def q_mode_impute(spark, sf_dir):
    """IM7: most-frequent imputer for text and numbers, ties -> smallest."""
    df = jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0].select(
        "booking_id", "driver_ratings", "customer_rating", "time_of_day")
    return _r6(encode.apply_fill(df, encode.fit_mode(df, ["driver_ratings", "customer_rating", "time_of_day"])))


@register("duration_distance", round6(_EV_CUST_SQL + """
SELECT customer_id, coalesce(avg_vtat, 0.0) AS duration, coalesce(avg_ride_distance, 0.0) AS distance FROM cf""",
                                      ["duration", "distance"]))
def q_duration_distance(spark, sf_dir):
    """IM8 + IM9 on the customer table (the file the reference's script targets)."""
    cust = _event_customers(spark, sf_dir)
    out = encode.add_distance(encode.add_duration(cust), source="avg_ride_distance")
    return _r6(out.select("customer_id", "duration", "distance"))


@register("profile_booking_value", round6(_CLEAN_SQL + """
SELECT 'booking_value' AS column_name, min(booking_value) AS min, max(booking_value) AS max,
  avg(booking_value) AS mean, quantile_cont(booking_value, 0.5) AS median,
  count(*) - count(booking_value) AS missing FROM rr""", ["min", "max", "mean", "median"]))
def q_profile(spark, sf_dir):
    """IM10."""
    return _r6(encode.profile(jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0], "booking_value"))


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("robust_scale_lineitem", round6("WITH b AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_r"
    for c in _LI_NUM) + " FROM lineitem)\nSELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"({c} - b.{c}_m) / CASE WHEN b.{c}_r = 0 THEN 1.0 ELSE b.{c}_r END AS {c}" for c in _LI_NUM)
    + " FROM lineitem, b", _LI_NUM))
def q_robust_scale(spark, sf_dir):
    """FE4: (x - median) / IQR, IQR 0 -> 1."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_LI_NUM)
    return _r6(encode.apply_scale(li, encode.fit_robust(li, _LI_NUM)))


@register("standard_scale_customer", round6("""WITH b AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1,
  avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM customer)
SELECT c_custkey, (c_acctbal - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END AS c_acctbal,
  (c_nationkey - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END AS c_nationkey FROM customer, b""",
                                            ["c_acctbal", "c_nationkey"]))
def q_standard_scale(spark, sf_dir):
    """FE5: (x - mean) / population std."""
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return _r6(encode.apply_scale(cu, encode.fit_standard(cu, ["c_acctbal", "c_nationkey"])))


@register("onehot_part", """SELECT p_partkey, 'p_brand_' || p_brand AS feature FROM part WHERE p_brand IS NOT NULL
UNION ALL SELECT p_partkey, 'p_type_' || p_type AS feature FROM part WHERE p_type IS NOT NULL""")
def q_onehot_part(spark, sf_dir):
    """FE6: dictionary encoding; long form of the non-zero dummies."""
    part = table(spark, sf_dir, "part")
    model = encode.fit_onehot(part, ["p_brand", "p_type"])
    return encode.onehot_long(part, model, ["p_brand", "p_type"], "p_partkey")


_ENC_SCALED = ["booking_value", "ride_distance", "customer_rating"]
_ENC_TEXT = ["booking_status", "vehicle_type", "pickup_location", "driver_ratings", "reason_for_cancelling_by_customer",
             "payment_method", "day_name", "time_of_day"]
_ENC_PASS = ["year", "month", "day", "hour", "dow", "is_weekend", "is_peak", "is_completed", "is_incomplete", "is_cancelled",
             "cancelled_rides_by_customer"]


def _encoder_sql() -> str:
    filled = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM rm)) AS {c}" for c in _ENC_SCALED)
    parts = [f"""SELECT booking_id, '{c}' AS feature, ({c} - q[2]) / CASE WHEN q[3] = q[1] THEN 1.0 ELSE q[3] - q[1] END AS value
FROM fi, (SELECT quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM fi) b""" for c in _ENC_SCALED]
    parts += [f"SELECT booking_id, '{c}_' || coalesce({c}, {_mode_sql(c, 'rm')}) AS feature, 1.0 AS value FROM rm" for c in _ENC_TEXT]
    parts += [f"SELECT booking_id, '{c}' AS feature, CAST(coalesce({c}, {_mode_sql(c, 'rm')}) AS DOUBLE) AS value FROM rm"
              for c in _ENC_PASS]
    return (_CLEAN_SQL + f",\nrm AS MATERIALIZED (SELECT * FROM rr),\nfi AS (SELECT booking_id, {filled} FROM rm)\n"
            + "\nUNION ALL ".join(parts))


@register("encoder_features", round6(_encoder_sql(), ["value"]))
def q_encoder_features(spark, sf_dir):
    """FE1 + FE7 + FE8: the fitted column transformer on the cleaned bookings, its vectors by feature name."""
    df = jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0]
    return _r6(encode.fit_encoder(df).transform_long(df, "booking_id"))


@register("encoded_trip_means", _CLEAN_SQL + f"""
SELECT vehicle_type, {_rhe('avg(booking_value)')} AS avg_booking_value, {_rhe('avg(ride_distance)')} AS avg_ride_distance,
  {_rhe('avg(customer_rating)')} AS avg_customer_rating FROM rr GROUP BY 1""")
def q_encoded_trip_means(spark, sf_dir):
    """AG3 on encoded trips with a given label: the means are those of the unscaled values."""
    df = jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0]
    rows = encode.fit_encoder(df).transform(df)
    return customers.segment_summary(rows, "vehicle_type", ["booking_value", "ride_distance", "customer_rating"], prefix="avg_")


@register("encoded_trip_crosstab", _CLEAN_SQL + f"""
, cells AS (SELECT vehicle_type, time_of_day AS value, count(*) AS cnt FROM rr
  WHERE vehicle_type IS NOT NULL AND time_of_day IS NOT NULL GROUP BY 1, 2)
SELECT c.vehicle_type, c.value, {_rhe('c.cnt * 100.0 / t.row_total')} AS pct FROM cells c
JOIN (SELECT vehicle_type, sum(cnt) AS row_total FROM cells GROUP BY 1) t ON c.vehicle_type = t.vehicle_type""")
def q_encoded_trip_crosstab(spark, sf_dir):
    """AG5 on encoded trips with a given label: rows without a category stay without one."""
    df = jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0]
    return customers.crosstab_pct(encode.fit_encoder(df).transform(df), "vehicle_type", "time_of_day")


# ------------------------------------------------------------------ segmentation measures with given labels
_EV_SQL = """ev AS (SELECT vec_id, label, CAST(x AS DOUBLE) AS x, i FROM (
  SELECT vec_id, label, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings))"""


def _sil_sql(lab: str, tag: str) -> str:
    """Squared-Euclidean silhouette + inertia of labels ``lab`` (an expression of ``label``)."""
    return f"""
{tag}_e AS (SELECT vec_id, {lab} AS label, x, i FROM ev),
{tag}_pq AS (SELECT vec_id, label, sum(x * x) AS qx FROM {tag}_e GROUP BY 1, 2),
{tag}_st AS (SELECT label, count(*) AS n, sum(qx) AS q FROM {tag}_pq GROUP BY 1),
{tag}_sm AS (SELECT label, i, sum(x) AS s FROM {tag}_e GROUP BY 1, 2),
{tag}_dt AS (SELECT e.vec_id, sm.label AS c, sum(e.x * sm.s) AS dot FROM {tag}_e e JOIN {tag}_sm sm ON e.i = sm.i
  GROUP BY 1, 2),
{tag}_dd AS (SELECT p.vec_id, p.label, dt.c, p.qx + st.q / st.n - CAST(2.0 AS DOUBLE) / st.n * dt.dot AS d, st.n AS cn
  FROM {tag}_pq p JOIN {tag}_dt dt ON p.vec_id = dt.vec_id JOIN {tag}_st st ON st.label = dt.c),
{tag}_pp AS (SELECT vec_id, label, max(CASE WHEN c = label THEN d * cn / (cn - 1) END) AS own,
  max(CASE WHEN c = label THEN cn END) AS own_n, min(CASE WHEN c <> label THEN d END) AS other
  FROM {tag}_dd GROUP BY 1, 2),
{tag}_res AS (SELECT
  (SELECT avg(CASE WHEN own_n = 1 THEN 0.0 WHEN own < other THEN 1 - own / other
                   WHEN own > other THEN other / own - 1 ELSE 0.0 END) FROM {tag}_pp) AS silhouette,
  (SELECT sum(qx) FROM {tag}_pq) - (SELECT sum(ss / n) FROM (SELECT label, sum(s * s) AS ss FROM {tag}_sm GROUP BY 1) a
     JOIN {tag}_st USING (label)) AS inertia)"""


@register("silhouette_labels", round6("WITH " + _EV_SQL + "," + _sil_sql("label", "s") +
                                      "\nSELECT silhouette FROM s_res", ["silhouette"]))
def q_silhouette(spark, sf_dir):
    """SG4 on the given labels of ``embeddings``."""
    return _r6(segment.silhouette(table(spark, sf_dir, "embeddings"), "embedding", "label"))


_KS = list(range(2, 9))
_EVAL_SQL = ("WITH " + _EV_SQL + "," + ",".join(_sil_sql(f"label % {k}", f"k{k}") for k in _KS) + ",\nev_k AS ("
             + "\nUNION ALL ".join(f"SELECT {k} AS k, inertia, silhouette FROM k{k}_res" for k in _KS) + ")")


def _given_evaluation(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    rows = []
    for k in _KS:
        lab = emb.withColumn("lk", F.col("label") % k)
        sil = segment.silhouette(lab, "embedding", "lk").first()["silhouette"]
        rows.append((k, segment.labelled_cost(lab, "embedding", "lk"), sil))
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


@register("evaluate_given_labels", round6(_EVAL_SQL.replace("SELECT 2 AS k", "SELECT CAST(2 AS INTEGER) AS k") +
                                          "\nSELECT CAST(k AS INTEGER) AS k, inertia, silhouette FROM ev_k",
                                          ["inertia", "silhouette"]))
def q_evaluate_given(spark, sf_dir):
    """SG3 measures (inertia, silhouette) for the coarsened given labels ``label % k``, k = 2..8."""
    return _r6(_given_evaluation(spark, sf_dir))


@register("best_k", round6(_EVAL_SQL + """
SELECT CAST(k AS INTEGER) AS k, inertia, silhouette FROM ev_k ORDER BY silhouette DESC, k LIMIT 1""",
                           ["inertia", "silhouette"]))
def q_best_k(spark, sf_dir):
    """SG6: greatest silhouette, ties -> smaller k."""
    return _r6(segment.best_k(_given_evaluation(spark, sf_dir)))


_CEN_SQL = _EV_SQL + ",\ncen AS (SELECT label, i AS dim, avg(x) AS value FROM ev GROUP BY 1, 2)"


@register("centroid_range_labels", round6("WITH " + _CEN_SQL + """
SELECT 'f' || CAST(dim AS VARCHAR) AS feature, max(value) - min(value) AS range_across_clusters FROM cen
GROUP BY dim ORDER BY range_across_clusters DESC, feature LIMIT 30""", ["range_across_clusters"]))
def q_centroid_range(spark, sf_dir):
    """SG7: top-30 centre coordinate ranges (centres = label means)."""
    emb = table(spark, sf_dir, "embeddings")
    return _r6(segment.centroid_range(segment.centres_from_labels(emb, "embedding", "label"), "label", 30))


@register("assign_nearest", "WITH " + _CEN_SQL + """,
d AS (SELECT e.vec_id, c.label AS k, sum((e.x - c.value) * (e.x - c.value)) AS d FROM ev e JOIN cen c ON e.i = c.dim
  GROUP BY 1, 2)
SELECT emb.vec_id, emb.label, CAST(first(d.k ORDER BY d.d, d.k) AS INTEGER) AS segment
FROM embeddings emb JOIN d ON emb.vec_id = d.vec_id GROUP BY 1, 2""")
def q_assign_nearest(spark, sf_dir):
    """SG10: nearest centre (label means) for every vector."""
    emb = table(spark, sf_dir, "embeddings")
    cen = segment.collect_centres(segment.centres_from_labels(emb, "embedding", "label"), "label")
    return segment.assign(emb, "embedding", cen).select("vec_id", "label", "segment")


# ------------------------------------------------------------------ k-means (random start: rows-only + properties)
@register("kmeans_customers")
def q_kmeans_customers(spark, sf_dir):
    """SG2: customer k-means (k = 3, seed 42, best of 10) on the cleaned bookings."""
    out, _, _ = segment.segment_customers(jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0], k=3)
    return _r6(out.drop("features"))


@register("kmeans_trips")
def q_kmeans_trips(spark, sf_dir):
    """SG1: trip k-means on the encoded cleaned bookings."""
    lab, _, _ = segment.segment_trips(jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0], k=3)
    return lab.select("booking_id", "trip_segment")


@register("evaluate_k")
def q_evaluate_k(spark, sf_dir):
    """SG3: inertia and silhouette for k = 2..8 on the embeddings, best of 10 starts each."""
    return _r6(segment.evaluate_k(table(spark, sf_dir, "embeddings"), features="embedding"))


@register("evaluate_k_minibatch")
def q_evaluate_k_minibatch(spark, sf_dir):
    """SG5: the same by mini-batch k-means."""
    return _r6(segment.evaluate_k(table(spark, sf_dir, "embeddings"), features="embedding", fast=True))


@register("pca_2d")
def q_pca_2d(spark, sf_dir):
    """SG8: centred 2-D PCA coordinates with the label."""
    return _r6(segment.pca_2d(table(spark, sf_dir, "embeddings"), "embedding", "label"))


# ------------------------------------------------------------------ distribution checks
def _moments_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, n, m3 / power(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM (
  SELECT count({c}) AS n, avg(power({c} - mu, 2)) AS m2, avg(power({c} - mu, 3)) AS m3, avg(power({c} - mu, 4)) AS m4
  FROM lineitem, (SELECT avg({c}) AS mu FROM lineitem) m) q"""


@register("normality_lineitem", round6("WITH mo AS (" + "\nUNION ALL ".join(_moments_sql(c) for c in _LI_NUM) + """),
jb AS (SELECT *, n / 6.0 * (power(skewness, 2) + power(kurtosis, 2) / 4.0) AS jb FROM mo)
SELECT feature, n, skewness, kurtosis, jb, exp(-jb / 2.0) AS p_value, exp(-jb / 2.0) > 0.05 AS is_normal FROM jb""",
                                       ["skewness", "kurtosis", "jb", "p_value"]))
def q_normality(spark, sf_dir):
    """DI1 (re-aimed): Jarque-Bera on all rows."""
    return _r6(distribution.normality(table(spark, sf_dir, "lineitem"), _LI_NUM))


@register("normality_ranks")
def q_normality_ranks(spark, sf_dir):
    """DI1 on ranks: Shapiro-Francia on all rows (SQL has no inverse normal; checked against numpy)."""
    return _r6(distribution.shapiro_francia(table(spark, sf_dir, "lineitem"), _LI_NUM))


@register("histogram_price", round6("""WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 1.0 END AS width FROM r),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / width) + 1, 10) AS INTEGER) AS bin, count(*) AS n
  FROM lineitem, w WHERE l_extendedprice IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, lo + (i - 1) * width AS lo, lo + i * width AS hi, coalesce(n, 0) AS n
FROM range(1, 11) g(i) CROSS JOIN w LEFT JOIN b ON b.bin = g.i""", ["lo", "hi"]))
def q_histogram(spark, sf_dir):
    """DI2: 10 equal-width bins."""
    return _r6(distribution.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10))


@register("kde_discount", round6("""WITH s AS (SELECT min(l_discount) AS lo, max(l_discount) AS hi,
  stddev_samp(l_discount) AS sd, count(l_discount) AS n FROM lineitem),
p AS (SELECT lo, hi, n, sd * power(n, -0.2) AS h FROM s),
g AS (SELECT lo + (hi - lo) * i / 49 AS gx, h, n FROM p, range(0, 50) t(i))
SELECT gx AS x, sum(exp(-power((gx - l_discount) / h, 2) / 2.0)) / (n * h * sqrt(2 * pi())) AS density
FROM g, lineitem WHERE l_discount IS NOT NULL GROUP BY gx, h, n""", ["x", "density"]))
def q_kde(spark, sf_dir):
    """DI3: Gaussian KDE at 50 points, Scott bandwidth, all rows."""
    return _r6(distribution.kde(table(spark, sf_dir, "lineitem"), "l_discount", 50))


# ------------------------------------------------------------------ more operators over the same sources
@register("demand_by_segment", _TWS_SQL + "," + _hourly_sql(
    series_expr="customer_segment", where="customer_segment IS NOT NULL", ts="datetime", src="tws", unit="day")
          + "\nSELECT * FROM hourly")
def q_demand_by_segment(spark, sf_dir):
    """AG9: demand series per customer segment (AG7 on the JN1 result; orders are daily)."""
    return se.hourly_demand(_trips_with_segment(spark, sf_dir), ts="datetime", series="customer_segment", freq="day")


@register("hourly_demand_cleaned", _CLEAN_SQL + "," + _hourly_sql(
    series_expr="vehicle_type", where="vehicle_type IS NOT NULL", ts="datetime", src="rr") + "\nSELECT * FROM hourly")
def q_hourly_demand_cleaned(spark, sf_dir):
    """AG7 on the output of the cleaning job, as the reference chains them."""
    return se.hourly_demand(jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0], series="vehicle_type")


# The order priorities of the TPC-H-like ``orders`` table (the pivot's columns).
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("crosstab_wide", _TWS_SQL + f"""
, cells AS (SELECT customer_segment, vehicle_type AS value, count(*) AS cnt FROM tws
  WHERE customer_segment IS NOT NULL AND vehicle_type IS NOT NULL GROUP BY 1, 2),
lng AS (SELECT c.customer_segment, c.value, {_rhe('c.cnt * 100.0 / t.row_total')} AS pct FROM cells c
  JOIN (SELECT customer_segment, sum(cnt) AS row_total FROM cells GROUP BY 1) t ON c.customer_segment = t.customer_segment)
SELECT customer_segment, """ + ", ".join(
    f"coalesce(max(CASE WHEN value = '{v}' THEN pct END), 0.0) AS \"{v}\"" for v in PRIORITIES)
          + " FROM lng GROUP BY 1")
def q_crosstab_wide(spark, sf_dir):
    """AG5 wide: pivot with an explicit value list (no extra job), absent cells 0."""
    long = customers.crosstab_pct(_trips_with_segment(spark, sf_dir), "customer_segment", "vehicle_type")
    return customers.crosstab_wide(long, "customer_segment", PRIORITIES)


@register("segmentation_filters", round6(_CLEAN_SQL + """
SELECT booking_id, booking_value, is_completed FROM rr WHERE is_completed = 1 AND booking_value >= 50""",
                                         ["booking_value"]))
def q_segmentation_filters(spark, sf_dir):
    """FL5 + FL6: completed rides with booking value >= 50 (null values drop out)."""
    df = jobs.clean_bookings(dirty_bookings(spark, sf_dir))[0]
    return _r6(clean.segmentation_input(df, completed_only=True, min_value=50).select(
        "booking_id", "booking_value", "is_completed"))


@register("trip_segment_summary", _TWS_SQL + "\nSELECT customer_segment, " + ", ".join(
    f"{_rhe(f'avg({c})')} AS avg_{c}" for c in ("booking_value", "is_weekend", "is_peak", "is_completed"))
          + " FROM tws GROUP BY 1")
def q_trip_segment_summary(spark, sf_dir):
    """AG3 for trips: ``avg_*`` columns per segment."""
    return customers.segment_summary(_trips_with_segment(spark, sf_dir), "customer_segment",
                                     ["booking_value", "is_weekend", "is_peak", "is_completed", "fare_per_km"],
                                     prefix="avg_")


@register("profile_lines", _PROFILE_SQL + """
SELECT customer_segment, line_no, metric, CASE WHEN metric = 'n'
  THEN printf('Segment %s size : %d', customer_segment, CAST(value AS BIGINT))
  ELSE '  ' || metric || ' : ' || coalesce(CAST(value AS VARCHAR), 'nan') END AS line FROM pl""")
def q_profile_lines(spark, sf_dir):
    """IO9: the profile text lines (written with ``files.write_profile``)."""
    prof = customers.segment_profile(_order_customers(spark, sf_dir), "customer_segment", FEATURES)
    return customers.profile_lines(prof, "customer_segment")
