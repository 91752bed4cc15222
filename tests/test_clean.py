import pytest
from pyspark.sql import functions as F

from ridelens.operators import clean, customers, encode, quantiles


def test_number_parsing(spark):
    vals = ["1e3", "5", "nan", "Infinity", "1.5", "1d", "0x10", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.x for r in df.select(clean.parse_number(F.col("s")).alias("x")).collect()]
    assert got[0] == 1000.0 and got[1] == 5.0 and got[2] is None and got[3] == float("inf")
    assert got[4] == 1.5 and got[5] is None and got[6] is None and got[7] is None


def test_smart_cast_threshold(spark):
    df = spark.createDataFrame([("1,5", "a"), ("2", "b"), ("x", "3"), ("y", "c"), ("z", "d")], "a string, b string")
    out, prof = clean.smart_cast(df, threshold=0.4, protect=())
    assert prof == {"a": 0.4, "b": 0.2}
    assert dict(out.dtypes) == {"a": "double", "b": "string"}
    assert [r.a for r in out.collect()] == [1.5, 2.0, None, None, None]


def test_dedup_keeps_first_and_null_keys_equal(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, None, 5), (4, None, 2), (5, "b", 9)],
                               "seq int, k string, v int")
    out = sorted(clean.dedup(df, ["k"], ["seq"]).collect(), key=lambda r: r.seq)
    assert [(r.seq, r.k, r.v) for r in out] == [(1, "a", 3), (3, None, 5), (5, "b", 9)]


def test_exact_quantiles_match_pandas(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    q = quantiles.quantiles(df, ["x"], [0.01, 0.5, 0.99])["x"]
    assert q == pytest.approx([1.03, 2.5, 9.79])
    capped = [r.x for r in clean.quantile_cap(df, ["x"]).collect()]
    assert capped[:4] == pytest.approx([1.03, 2.0, 3.0, 9.79]) and capped[4] is None


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_quantiles_many_partitions(spark, parts):
    import numpy as np
    df = spark.range(0, 5000).select((F.col("id") * 37 % 1001).cast("double").alias("x"),
                                     (F.col("id") % 7).cast("double").alias("y")).repartition(parts)
    got = quantiles.quantiles(df, ["x", "y"], [0.1, 0.25, 0.9])
    ids = np.arange(5000)
    assert got["x"] == pytest.approx(list(np.quantile((ids * 37 % 1001).astype(float), [0.1, 0.25, 0.9])))
    assert got["y"] == pytest.approx(list(np.quantile((ids % 7).astype(float), [0.1, 0.25, 0.9])))


def test_rare_collapse(spark):
    rows = [("a",)] * 60 + [("b",)] * 39 + [(None,)]
    df = spark.createDataFrame(rows, "c string")
    out = [r.c for r in clean.collapse_rare(df, {"c": 0.05}).collect()]
    assert out.count("a") == 60 and out.count("b") == 39 and out.count("Other") == 1  # rare null -> Other
    all_rare = spark.createDataFrame([(str(i),) for i in range(50)], "c string")
    assert {r.c for r in clean.collapse_rare(all_rare, {"c": 0.05}).collect()} == {"Other"}
    nulls = spark.createDataFrame([(None,)] * 5, "c string")
    assert [r.c for r in clean.collapse_rare(nulls, {"c": 0.5}).collect()] == [None] * 5


def test_fill_cancelled_only(spark):
    df = spark.createDataFrame([(1, None), (0, None), (1, 5.0)], "is_cancelled int, booking_value double")
    assert [r.booking_value for r in clean.fill_cancelled(df).collect()] == [0.0, None, 5.0]


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    assert encode.fit_mode(df, ["c"]) == {"c": "a"}


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.675,)], "x double")
    got = [r.y for r in df.select(customers.round_half_even(F.col("x"), 2).alias("y")).collect()]
    assert got == [0.12, 2.68]


def test_scalers_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert encode.fit_standard(df, ["x"]) == {"x": (3.0, 1.0)}
    assert encode.fit_robust(df, ["x"]) == {"x": (3.0, 1.0)}


def test_customer_features_nulls(spark):
    df = spark.createDataFrame([("c1", None, 0, 0, 0, None), ("c1", None, 0, 0, 0, None), (None, "b", 1, 0, 0, 5.0)],
                               "customer_id string, booking_id string, is_completed int, is_incomplete int, "
                               "is_cancelled int, booking_value double")
    out = customers.customer_features(df).collect()
    assert len(out) == 1 and out[0].total_trips == 0 and out[0].completed_trips == 0
    assert out[0].avg_booking_value is None and out[0].completion_rate is None


def test_crosstab_nulls_left_out(spark):
    df = spark.createDataFrame([(0, "a"), (0, None), (1, "b"), (1, "b")], "seg int, c string")
    out = {(r.seg, r.value): r.pct for r in customers.crosstab_pct(df, "seg", "c").collect()}
    assert out == {(0, "a"): 100.0, (1, "b"): 100.0}


def test_onehot_width_and_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",)], "c string")
    model = encode.fit_onehot(train, ["c"])
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    vecs = [r["c__ohe"] for r in model.transform(test).collect()]
    assert [v.size for v in vecs] == [2, 2, 2]
    assert list(vecs[0].toArray()) == [1.0, 0.0] and vecs[1].numNonzeros() == 0 and vecs[2].numNonzeros() == 0


def test_crosstab_wide_values_found(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b")], "seg int, c string")
    wide = customers.crosstab_wide(customers.crosstab_pct(df, "seg", "c"), "seg")
    rows = {r.seg: (r.a, r.b) for r in wide.collect()}
    assert rows == {0: (50.0, 50.0), 1: (0.0, 100.0)}
    with pytest.raises(ValueError):
        customers.crosstab_wide(customers.crosstab_pct(df, "seg", "c"), "seg", max_values=1)
