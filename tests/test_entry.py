import __spark_entry__ as ent


def test_entry_smoke(spark):
    df = ent.entry(spark)
    assert df.count() > 0 and {"series", "model", "mae", "rmse", "mape", "smape"} <= set(df.columns)


def test_registry_consistent():
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
