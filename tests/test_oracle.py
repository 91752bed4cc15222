"""Spark vs DuckDB for a representative subset of the registered queries at sf0.001
(the full set runs with ``scripts/oracle_check.py``)."""

import duckdb
import pytest

import __spark_entry__ as ent
from scripts.oracle_check import _hash, _norm
from ridelens.sources.tables import TABLES

from .conftest import SF

SUBSET = ["hourly_demand_by_type", "forecast_metrics", "forecast_weekly", "forecast_additive_log", "dedup_bookings",
          "clean_bookings", "quantile_cap_lineitem", "collapse_rare_bookings", "customer_features_orders",
          "crosstab_segment_priority", "kpi_share", "silhouette_labels", "assign_nearest", "normality_lineitem",
          "vehicle_metrics_log"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    got = ent.queries()[name](spark, SF).toPandas()
    want = con.execute(ent.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _hash(_norm(got)) == _hash(_norm(want))
