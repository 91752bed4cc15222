"""Hot customers, wide gaps and densities: bounded work per task, same results."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ridelens.operators import customers, distribution, series, skew


def test_heavy_keys_are_found(spark):
    rnd = random.Random(3)
    keys = ["hot"] * 3000 + ["warm"] * 900 + [f"c{rnd.randint(0, 4000)}" for _ in range(5000)] + [None] * 500
    rnd.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "c string").repartition(7)
    counts, n = Counter(k for k in keys if k is not None), len(keys) - 500
    for k in (4, 20, 200):
        got = skew.heavy_keys(df, F.col("c"), k)
        assert len(got) <= k and {c for c, m in counts.items() if m >= 2 * n / k} <= set(got)
        assert all(counts[c] >= n / k for c in got)
    assert skew.heavy_keys(df.limit(0), F.col("c")) == []


def test_a_customer_with_a_third_of_all_trips_is_spread(spark):
    """Without any help of AQE no partition of the joined trips holds more than a small share of them."""
    rnd = random.Random(4)
    n = 24_000
    rows = [(i, "HOT" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else f"c{rnd.randint(0, 3000)}") for i in range(n)]
    trips = spark.createDataFrame(rows, "i int, customer_id string").repartition(16)
    cust = spark.createDataFrame([(f"c{i}", i % 4) for i in range(2500)] + [("HOT", 9), (None, 7)], "customer_id string, customer_segment int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("false", "-1", "16")):
            spark.conf.set(k, v)
        joined = customers.trips_with_segment(trips, cust).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("part").count().collect()]
        got = {r.i: r.customer_segment for r in joined.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    segment = {f"c{i}": i % 4 for i in range(2500)} | {"HOT": 9}
    assert got == {i: segment.get(c) for i, c in rows} and len(got) == n
    assert max(sizes) < n / 12


@pytest.mark.parametrize("freq", ["hour", "day"])
def test_gaps_of_any_width(spark, monkeypatch, freq):
    monkeypatch.setattr(series, "CHUNK", 7)
    step = dt.timedelta(hours=1) if freq == "hour" else dt.timedelta(days=1)
    t = dt.datetime(2024, 3, 1)
    points = [("a", 0, 2), ("a", 1, 1), ("a", 500, 4), ("a", 507, 1), ("b", 3, 1)]
    counts = spark.createDataFrame([(s, t + i * step, y) for s, i, y in points], "series string, ds timestamp_ntz, y long")
    got = {(r.series, r.ds): r.y for r in series.zero_fill(counts, freq).collect()}
    want = {("a", t + i * step): 0 for i in range(508)} | {(s, t + i * step): y for s, i, y in points}
    assert got == want


def test_a_stray_timestamp_is_spread(spark):
    """17.7 million empty hours: no array beyond 10,000 elements, and the points come from many tasks."""
    rows = [("a", dt.datetime(1, 1, 1)), ("a", dt.datetime(2024, 1, 1))]
    counts = spark.createDataFrame(rows, "series string, ds timestamp_ntz").withColumn("y", F.lit(1).cast("long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in series.zero_fill(counts).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hours = int((rows[1][1] - rows[0][1]).total_seconds() // 3600) + 1
    assert sum(parts) == hours and len(parts) >= 4 and max(parts) < hours * 0.35
    assert max(hours ** 0.5 + 1, hours / hours ** 0.5 + 1) < 10_000


def test_binned_density_is_close_to_the_exact_one(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.gauss(3, 2) if rnd.random() < 0.8 else rnd.expovariate(0.2),) for _ in range(5000)] + [(None,)], "v double")
    exact, binned = ({r.x: r.density for r in distribution.kde(df, "v", exact=e).collect()} for e in (True, False))
    assert exact.keys() == binned.keys() and len(exact) == 50
    _, _, _, h = distribution._scott(df, "v")
    assert max(abs(exact[x] - binned[x]) for x in exact) < min(1e-4, 8e-5 * 0.4 / h)
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert distribution.kde(flat, "v").collect() == []
