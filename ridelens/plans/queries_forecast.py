"""Registered queries: demand series, forecasts and forecast metrics (events as bookings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridelens.operators import forecast as fc
from ridelens.operators import metrics as me
from ridelens.operators import series as se
from ridelens.plans import jobs
from ridelens.session import cut_lineage
from ridelens.plans.registry import _r6, register, round6
from ridelens.sources.tables import table

# --------------------------------------------------------------------------------------
# Demand series and forecasts (events as bookings: ts = time, event_type = vehicle type)
# --------------------------------------------------------------------------------------

def _hourly_sql(series_expr: str = "CAST(event_type AS VARCHAR)", where: str = "event_type IS NOT NULL",
                ts: str = "ts", src: str = "events", unit: str = "hour") -> str:
    step = "INTERVAL 1 HOUR" if unit == "hour" else "INTERVAL 1 DAY"
    return f"""
counts AS (
  SELECT {series_expr} AS series, date_trunc('{unit}', {ts}) AS ds, count(*) AS y
  FROM {src} WHERE {ts} IS NOT NULL AND {where} GROUP BY 1, 2),
spans AS (SELECT series, min(ds) AS lo, max(ds) AS hi FROM counts GROUP BY 1),
grid AS (SELECT series, unnest(generate_series(lo, hi, {step})) AS ds FROM spans),
hourly AS (
  SELECT g.series, g.ds, CAST(coalesce(c.y, 0) AS BIGINT) AS y
  FROM grid g LEFT JOIN counts c ON g.series = c.series AND g.ds = c.ds)"""


def _split_sql(src: str = "hourly", unit: str = "hour", ratio: str = "0.2") -> str:
    return f"""
stats AS (
  SELECT series, min(ds) AS t0, count(*) AS n,
         count(*) - CAST(floor(count(*) * CAST({ratio} AS DOUBLE)) AS BIGINT) AS n_train
  FROM {src} GROUP BY 1),
split AS (
  SELECT h.*, s.t0, s.n, s.n_train, date_diff('{unit}', s.t0, h.ds) AS pos,
         date_diff('{unit}', s.t0, h.ds) < s.n_train AS is_train
  FROM {src} h JOIN stats s ON h.series = s.series)"""


_LAST_SQL = """
last AS (SELECT series, CAST(arg_max(y, ds) AS DOUBLE) AS last_y FROM split WHERE is_train GROUP BY 1)"""

_FC_LAST_SQL = """
fc_last AS (
  SELECT t.series, 'baseline_last' AS model, t.ds, CAST(t.y AS DOUBLE) AS y, l.last_y AS y_pred
  FROM split t LEFT JOIN last l ON t.series = l.series WHERE NOT t.is_train)"""

_FC_WEEKLY_SQL = """
fc_weekly AS (
  SELECT t.series, 'baseline_weekly' AS model, t.ds, CAST(t.y AS DOUBLE) AS y,
         coalesce(CAST(w.y AS DOUBLE), l.last_y) AS y_pred
  FROM split t
  LEFT JOIN split w ON w.is_train AND w.series = t.series AND w.ds = t.ds - INTERVAL 7 DAY
  LEFT JOIN last l ON t.series = l.series
  WHERE NOT t.is_train)"""


def _additive_sql(name: str, log: bool, rows: str = "split WHERE is_train", slots=("dow", "hod")) -> str:
    """Classic additive model fitted on ``rows`` of ``split``; defines ``{name}_line`` and ``{name}_season``."""
    v = "ln(1 + y)" if log else "CAST(y AS DOUBLE)"
    slot_sel = ", ".join({"dow": "isodow(ds) - 1 AS dow", "hod": "hour(ds) AS hod"}[s] for s in slots)
    slot_cols = ", ".join(slots)
    slot_join = " AND ".join(f"p.{s} = se.{s}" for s in slots)
    return f"""
{name}_pts AS (SELECT series, ds, CAST(pos AS DOUBLE) AS t, {v} AS v, {slot_sel} FROM {rows}),
{name}_ab AS (SELECT series, regr_intercept(v, t) AS a, regr_slope(v, t) AS b FROM {name}_pts GROUP BY 1),
{name}_res AS (SELECT p.*, p.v - (l.a + l.b * p.t) AS r FROM {name}_pts p JOIN {name}_ab l ON p.series = l.series),
{name}_season AS (SELECT series, {slot_cols}, avg(r) AS s FROM {name}_res GROUP BY ALL),
{name}_line AS (
  SELECT l.series, l.a, l.b, sd.sigma FROM {name}_ab l JOIN (
    SELECT p.series, stddev_pop(p.r - se.s) AS sigma FROM {name}_res p
    JOIN {name}_season se ON p.series = se.series AND {slot_join} GROUP BY 1) sd ON l.series = sd.series)"""


def _additive_pred_sql(name: str, rows: str, log: bool, clip: bool, extra: str = "p.series, p.ds",
                       slots=("dow", "hod")) -> str:
    """SELECT scoring ``rows`` (alias p, with series, ds, pos) by model ``name``: fit, lo, hi."""
    slot_sel = {"dow": "isodow(p.ds) - 1", "hod": "hour(p.ds)"}
    slot_join = " AND ".join(f"se.{s} = {slot_sel[s]}" for s in slots)
    fit = "(l.a + l.b * p.pos + coalesce(se.s, 0.0))"

    def back(x: str) -> str:
        if log:
            x = f"(exp({x}) - 1)"
        if clip:
            x = f"greatest({x}, 0.0)"
        return x
    return (f"SELECT {extra}, {back(fit)} AS fit, {back(f'({fit} - {fc.Z80!r} * l.sigma)')} AS lo, "
            f"{back(f'({fit} + {fc.Z80!r} * l.sigma)')} AS hi "
            f"FROM {rows} LEFT JOIN {name}_line l ON p.series = l.series "
            f"LEFT JOIN {name}_season se ON se.series = p.series AND {slot_join}")


def _events_split(spark: SparkSession, sf_dir: str, series: str | None = "event_type") -> DataFrame:
    """Hourly series per event type, split, materialised once (``jobs.demand_split``)."""
    return jobs.demand_split(table(spark, sf_dir, "events"), ts="ts", series=series)


@register("hourly_demand_by_type", "WITH" + _hourly_sql() + "\nSELECT * FROM hourly")
def q_hourly_demand_by_type(spark, sf_dir):
    """AG7: zero-filled hourly counts per category (each with its own span)."""
    return se.hourly_demand(table(spark, sf_dir, "events"), ts="ts", series="event_type")


@register("hourly_demand_global",
          "WITH" + _hourly_sql(series_expr="'all'", where="TRUE") + "\nSELECT * FROM hourly")
def q_hourly_demand_global(spark, sf_dir):
    """AG6: zero-filled hourly counts over the whole table."""
    return se.hourly_demand(table(spark, sf_dir, "events"), ts="ts", series=None)


@register("daily_demand_orders", "WITH" + _hourly_sql(
    series_expr="CAST(o_orderpriority AS VARCHAR)", where="o_orderpriority IS NOT NULL", ts="o_orderdate",
    src="orders", unit="day") + "\nSELECT * FROM hourly")
def q_daily_demand_orders(spark, sf_dir):
    """AG7 with ``freq="day"`` on orders per priority."""
    return se.hourly_demand(table(spark, sf_dir, "orders"), ts="o_orderdate", series="o_orderpriority", freq="day")


@register("log_demand_by_type",
          round6("WITH" + _hourly_sql() + "\nSELECT series, ds, ln(1 + y) AS y FROM hourly", ["y"]))
def q_log_demand(spark, sf_dir):
    """AG8."""
    return _r6(se.log_demand(q_hourly_demand_by_type(spark, sf_dir)))


@register("series_keys", "SELECT DISTINCT CAST(event_type AS VARCHAR) AS series FROM events WHERE event_type IS NOT NULL")
def q_series_keys(spark, sf_dir):
    """FL7."""
    return se.series_keys(table(spark, sf_dir, "events"), "event_type")


@register("usable_series_by_user", "WITH" + _hourly_sql(
    series_expr="CAST(user_id AS VARCHAR)", where="user_id IS NOT NULL") + """
SELECT * FROM hourly WHERE series IN (
  SELECT series FROM hourly GROUP BY 1 HAVING count(*) >= 50 AND sum(y) <> 0)""")
def q_usable_series(spark, sf_dir):
    """FL8 on per-user series (many short ones)."""
    return se.usable_series(se.hourly_demand(table(spark, sf_dir, "events"), ts="ts", series="user_id"), 50)


@register("time_split", "WITH" + _hourly_sql() + "," + _split_sql() + "\nSELECT * FROM split")
def q_time_split(spark, sf_dir):
    """FC1."""
    return _events_split(spark, sf_dir)


@register("forecast_last", round6(
    "WITH" + _hourly_sql() + "," + _split_sql() + "," + _LAST_SQL + "," + _FC_LAST_SQL + "\nSELECT * FROM fc_last",
    ["y", "y_pred"]))
def q_forecast_last(spark, sf_dir):
    """FC2."""
    return _r6(fc.forecast_last(_events_split(spark, sf_dir)))


@register("forecast_weekly", round6(
    "WITH" + _hourly_sql() + "," + _split_sql() + "," + _LAST_SQL + "," + _FC_WEEKLY_SQL + "\nSELECT * FROM fc_weekly",
    ["y", "y_pred"]))
def q_forecast_weekly(spark, sf_dir):
    """FC3 + JN2."""
    return _r6(fc.forecast_weekly(_events_split(spark, sf_dir)))


def _fc_additive_sql(log: bool) -> str:
    model = "additive_log1p" if log else "additive"
    return round6(
        "WITH" + _hourly_sql() + "," + _split_sql() + "," + _additive_sql("m", log) + "\n"
        f"SELECT series, '{model}' AS model, ds, CAST(y AS DOUBLE) AS y, fit AS y_pred, lo AS y_lower, "
        "hi AS y_upper, CASE WHEN b IS NULL THEN 'failed' ELSE 'ok' END AS status FROM ("
        + _additive_pred_sql("m", "(SELECT * FROM split WHERE NOT is_train) p", log, log,
                             extra="p.series, p.ds, p.y, l.b") + ") q",
        ["y", "y_pred", "y_lower", "y_upper"])


@register("forecast_additive", _fc_additive_sql(False))
def q_forecast_additive(spark, sf_dir):
    """FC4 classic: trend + (weekday, hour) seasonal means, 80 % bounds."""
    return _r6(fc.forecast_additive(_events_split(spark, sf_dir), log=False))


@register("forecast_additive_log", _fc_additive_sql(True))
def q_forecast_additive_log(spark, sf_dir):
    """FC5: FC4 on log1p, expm1 back, clipped at 0."""
    return _r6(fc.forecast_additive(_events_split(spark, sf_dir), log=True))


_FUTURE_SQL = round6(
    "WITH" + _hourly_sql() + "," + _split_sql() + "," + _additive_sql("m", True, rows="split") + """,
fut AS (
  SELECT s.series, unnest(generate_series(s.n, s.n + 167)) AS pos, s.t0 FROM stats s),
futp AS (SELECT series, pos, t0 + pos * INTERVAL 1 HOUR AS ds FROM fut)
SELECT series, ds, fit AS yhat, lo AS yhat_lower, hi AS yhat_upper FROM ("""
    + _additive_pred_sql("m", "futp p", True, True) + ") q",
    ["yhat", "yhat_lower", "yhat_upper"])


@register("forecast_future", _FUTURE_SQL)
def q_forecast_future(spark, sf_dir):
    """FC6: 168 hours after the end of each series, fitted on all points, in orders."""
    return _r6(fc.forecast_future(_events_split(spark, sf_dir), horizon=168, log=True))


_ALL_FC_SQL = ("WITH" + _hourly_sql() + "," + _split_sql() + "," + _LAST_SQL + "," + _FC_LAST_SQL + ","
               + _FC_WEEKLY_SQL + "," + _additive_sql("m", True) + """,
fc_add AS (
  SELECT series, 'additive_log1p' AS model, ds, CAST(y AS DOUBLE) AS y, fit AS y_pred FROM ("""
               + _additive_pred_sql("m", "(SELECT * FROM split WHERE NOT is_train) p", True, True,
                                    extra="p.series, p.ds, p.y") + """) q),
fc_all AS (SELECT * FROM fc_last UNION ALL SELECT * FROM fc_weekly UNION ALL SELECT * FROM fc_add)""")


@register("forecast_all", round6(_ALL_FC_SQL + "\nSELECT * FROM fc_all", ["y", "y_pred"]))
def q_forecast_all(spark, sf_dir):
    """FC8: every model over every series in one table."""
    return _r6(fc.run_forecasts(_events_split(spark, sf_dir)))


_METRICS_V2_SQL = """
SELECT series, model, count(y_pred) AS n, avg(abs(y - y_pred)) AS mae, sqrt(avg(power(y - y_pred, 2))) AS rmse,
       avg(CASE WHEN y > 0 THEN abs((y - y_pred) / y) END) * 100 AS mape,
       avg(2.0 * abs(y_pred - y) / CASE WHEN abs(y) + abs(y_pred) = 0 THEN 1e-6 ELSE abs(y) + abs(y_pred) END) * 100 AS smape
FROM fc_all GROUP BY 1, 2"""


@register("forecast_metrics", round6(_ALL_FC_SQL + _METRICS_V2_SQL, ["mae", "rmse", "mape", "smape"]))
def q_forecast_metrics(spark, sf_dir):
    """ME1, ME3, ME4 per series and model (flagship)."""
    return _r6(me.forecast_metrics(fc.run_forecasts(_events_split(spark, sf_dir))))


@register("forecast_metrics_v1", round6(
    "WITH" + _hourly_sql() + "," + _split_sql() + "," + _LAST_SQL + "," + _FC_LAST_SQL + """
SELECT series, model, count(y_pred) AS n, avg(abs(y - y_pred)) AS mae, sqrt(avg(power(y - y_pred, 2))) AS rmse,
       avg(abs((y - y_pred) / greatest(y, 1e-6))) * 100 AS mape
FROM fc_last GROUP BY 1, 2""", ["mae", "rmse", "mape"]))
def q_forecast_metrics_v1(spark, sf_dir):
    """ME1 + ME2 (MAPE with the 1e-6 floor)."""
    return _r6(me.forecast_metrics(fc.forecast_last(_events_split(spark, sf_dir)), version="v1"))


_FC_WEEKLY_REC_SQL = """
fc_weekly_r AS (
  SELECT t.series, 'baseline_weekly' AS model, t.ds, CAST(t.y AS DOUBLE) AS y,
         coalesce(CAST(w.y AS DOUBLE), l.last_y) AS y_pred
  FROM split t
  LEFT JOIN split w ON w.is_train AND w.series = t.series AND w.pos = t.n_train - 168 + ((t.pos - t.n_train) % 168)
  LEFT JOIN last l ON t.series = l.series
  WHERE NOT t.is_train)"""


@register("forecast_weekly_recursive", round6(
    "WITH" + _hourly_sql() + "," + _split_sql() + "," + _LAST_SQL + "," + _FC_WEEKLY_REC_SQL
    + "\nSELECT * FROM fc_weekly_r", ["y", "y_pred"]))
def q_forecast_weekly_recursive(spark, sf_dir):
    """FC3 with ``recursive=True``: the last train week repeats over the whole test part."""
    return _r6(fc.forecast_weekly(_events_split(spark, sf_dir), recursive=True))


@register("forecast_future_train_origin", round6(
    "WITH" + _hourly_sql() + "," + _split_sql() + "," + _additive_sql("m", True) + """,
fut AS (SELECT s.series, unnest(generate_series(0, s.n_train + 167)) AS pos, s.t0 FROM stats s),
futp AS (SELECT series, pos, t0 + pos * INTERVAL 1 HOUR AS ds FROM fut)
SELECT series, ds, fit AS yhat, lo AS yhat_lower, hi AS yhat_upper FROM ("""
    + _additive_pred_sql("m", "futp p", True, True) + ") q", ["yhat", "yhat_lower", "yhat_upper"]))
def q_forecast_future_train(spark, sf_dir):
    """FC6 with ``origin="train"``: fitted on train, from the first point to 168 h after the train part."""
    return _r6(fc.forecast_future(_events_split(spark, sf_dir), horizon=168, log=True, origin="train"))


_VEHICLE_SQL = ("WITH" + _hourly_sql() + """,
usable AS (SELECT * FROM hourly WHERE series IN (
  SELECT series FROM hourly GROUP BY 1 HAVING count(*) >= 50 AND sum(y) <> 0)),
hourly_l AS (SELECT series, ds, ln(1 + y) AS y FROM usable),""" + _split_sql(src="hourly_l") + "," + _LAST_SQL + ","
                + _FC_LAST_SQL + "," + _additive_sql("m", False) + """,
fc_add AS (SELECT series, 'additive' AS model, ds, y, fit AS y_pred FROM ("""
                + _additive_pred_sql("m", "(SELECT * FROM split WHERE NOT is_train) p", False, False,
                                     extra="p.series, p.ds, p.y") + """) q),
fc_v AS (SELECT * FROM fc_last UNION ALL SELECT * FROM fc_add)
SELECT series, model, count(y_pred) AS n, avg(abs(y - y_pred)) AS mae, sqrt(avg(power(y - y_pred, 2))) AS rmse,
       avg(abs((y - y_pred) / greatest(y, 1e-6))) * 100 AS mape
FROM fc_v GROUP BY 1, 2""")


@register("vehicle_metrics_log", round6(_VEHICLE_SQL, ["mae", "rmse", "mape"]))
def q_vehicle_metrics_log(spark, sf_dir):
    """The per-vehicle job as the reference scores it: usable series (FL8), log1p target (AG8),
    naive and additive forecasts, metrics on the log scale with the 1e-6 MAPE floor (ME2)."""
    hourly = se.hourly_demand(table(spark, sf_dir, "events"), ts="ts", series="event_type")
    split = cut_lineage(se.time_split(se.log_demand(se.usable_series(hourly, 50))))
    fcs = fc.run_forecasts(split, ["baseline_last", "additive"])
    return _r6(me.forecast_metrics(fcs, version="v1"))


@register("forecast_fourier")
def q_forecast_fourier(spark, sf_dir):
    """FC4 / FC5 second variant: changepoint trend + Fourier seasonality, ridge fit per series
    (random-free but solver-specific: rows-only, quality checked in tests)."""
    split = _events_split(spark, sf_dir)
    return _r6(fc.run_forecasts(split, ["fourier", "fourier_log1p"]))


@register("forecast_sparse_trend")
def q_forecast_sparse_trend(spark, sf_dir):
    """FC4 / FC5 third variant: sparse trend changes, with bounds that widen and the status of each series (FC7)."""
    return _r6(fc.run_forecasts(_events_split(spark, sf_dir), ["sparse", "sparse_log1p"], bounds=True))


@register("forecast_future_sparse")
def q_forecast_future_sparse(spark, sf_dir):
    """FC6 by the sparse-trend model: 168 hours after the end of each series, in orders, bounds widening."""
    return _r6(fc.forecast_future(_events_split(spark, sf_dir), horizon=168, log=True, model="sparse"))
