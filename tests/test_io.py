import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ridelens.operators import customers, encode
from ridelens.plans import jobs
from ridelens.sources import files
from ridelens.sources.tables import dirty_bookings

from .conftest import SF


def _tmp():
    return tempfile.mkdtemp(prefix="ridelens-io-")


def test_parquet_and_csv_round_trip(spark):
    df, _ = jobs.clean_bookings(dirty_bookings(spark, SF))
    d = _tmp()
    files.write_table(df, os.path.join(d, "p"))
    back = files.read_clean(spark, os.path.join(d, "p"))
    assert back.dtypes == df.dtypes and back.exceptAll(df.select(*back.columns)).count() == 0
    files.write_table(df, os.path.join(d, "c"), fmt="csv")
    back_csv = files.read_clean(spark, os.path.join(d, "c"), schema=df.schema, fmt="csv")
    assert back_csv.count() == df.count()
    assert back_csv.select(F.sum("booking_value")).first()[0] == pytest.approx(df.select(F.sum("booking_value")).first()[0])


def test_raw_csv_all_text(spark):
    d = _tmp()
    dirty_bookings(spark, SF).write.option("header", True).csv(os.path.join(d, "raw"))
    raw = files.read_raw(spark, os.path.join(d, "raw"))
    assert all(t == "string" for _, t in raw.dtypes)


def test_require_names_job(spark):
    with pytest.raises(files.MissingInput, match="run preprocessing first"):
        files.require(spark, ["/nonexistent/cleaned"], "preprocessing")


def test_json_and_by_series(spark):
    d = _tmp()
    df = spark.createDataFrame([("Go Sedan", 1.0), ("Premier Sedan", 2.0)], "series string, mae double")
    files.write_json(df, os.path.join(d, "j"))
    assert spark.read.json(os.path.join(d, "j")).count() == 2
    files.write_by_series(df, os.path.join(d, "s"))
    assert sorted(os.listdir(os.path.join(d, "s")))[-2:] == ["series_slug=go_sedan", "series_slug=premier_sedan"]


def test_profile_text(spark):
    d = _tmp()
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "seg int, v double")
    lines = customers.profile_lines(customers.segment_profile(df, "seg", ["v"]), "seg")
    files.write_profile(lines, os.path.join(d, "t"), order=("seg", "metric"))
    text = [r.value for r in spark.read.text(os.path.join(d, "t")).collect()]
    assert "  avg_v : 2.0" in text and "Segment 1 size : 1" in text


def test_encoder_save_load_same_vectors(spark):
    df, _ = jobs.clean_bookings(dirty_bookings(spark, SF))
    enc = encode.fit_encoder(df)
    assert len(enc.feature_names()) == enc.transform(df).first()["features"].size
    d = _tmp()
    enc.save(d)
    enc2 = encode.Encoder.load(d)
    a = enc.transform(df).select("booking_id", "features").orderBy("booking_id").collect()
    b = enc2.transform(df).select("booking_id", "features").orderBy("booking_id").collect()
    assert a == b
