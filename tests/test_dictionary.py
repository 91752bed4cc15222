"""Distributed dictionary encoding."""

import random

from pyspark.sql import functions as F

from ridelens.operators import dictionary, encode


def test_numbers_are_sorted_places(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("xyzé"), str(rnd.randint(0, 900)) if rnd.random() < 0.9 else None) for _ in range(3000)]
    d = dictionary.fit_dictionary(spark.createDataFrame(rows, "a string, b string").repartition(4), ["a", "b"])
    for i, c in enumerate("ab"):
        values = sorted({r[i] for r in rows if r[i] is not None}, key=lambda v: v.encode())
        got = {r["value"]: (r["idx"], r["n"]) for r in d.table.where(F.col("name") == c).collect()}
        assert got == {v: (at, sum(r[i] == v for r in rows)) for at, v in enumerate(values)}
        assert d.widths[c] == len(values)


def test_rows_meet_the_rare_part_without_hot_keys(spark, monkeypatch):
    """With few broadcast values: frequent, rare, unseen and null values all get what a whole broadcast gives."""
    rnd = random.Random(2)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"v{rnd.randint(0, 400)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, c string")
    d = dictionary.fit_dictionary(df, ["c"])
    more = df.unionByName(spark.createDataFrame([(-1, "unseen"), (-2, None)], "i int, c string"))
    want = {r.i: r.at for r in d.index(more, "c", "c", "at").collect()}
    monkeypatch.setattr(dictionary, "BROADCAST_VALUES", 20)
    split = d.index(more, "c", "c", "at")
    assert {r.i: r.at for r in split.collect()} == want and want[-1] is None and want[-2] is None
    assert len({r.c__ohe.size for r in d.transform(more).collect()}) == 1


def test_a_million_values(spark):
    """No label reaches the driver or the plan."""
    df = spark.range(1_000_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("c"))
    d = dictionary.fit_dictionary(df, ["c"])
    assert d.widths == {"c": 1_000_000}
    wrong = d.index(df, "c", "c", "at").where(F.col("at") != F.substring("c", 2, 7).cast("long")).count()
    assert wrong == 0
    plan = d.transform(df)._jdf.queryExecution().toString()
    assert "k0000007" not in plan and len(plan) < 100_000


def test_feature_table_follows_the_vector(spark):
    df = spark.createDataFrame([(1.0, "b", "u", 4), (2.0, "a", "u", 5), (None, "b", None, 6)], "booking_value double, k string, l string, n int")
    enc = encode.fit_encoder(df)
    assert enc.feature_names() == ["booking_value", "k_a", "k_b", "l_u", "n"]
    assert [r.position for r in enc.feature_table().orderBy("position").collect()] == [0, 1, 2, 3, 4]
    vec = enc.transform(df).where("n = 5").first().features.toArray().tolist()
    assert vec[1:] == [1.0, 0.0, 1.0, 5.0]


def test_encoder_passes_read_persisted_rows(spark):
    """The fit and the rows it encodes next come from one computation of the input."""
    df = spark.createDataFrame([(float(i % 7), "ab"[i % 2], i) for i in range(50)], "booking_value double, k string, n int").withColumn("v", F.rand(3))
    enc = encode.fit_encoder(df)
    assert df.storageLevel.useMemory and "InMemoryTableScan" in enc.transform(df)._jdf.queryExecution().toString()
    df.unpersist()
