"""Records with line breaks, read in many blocks, against the whole-file reader."""

import random

import pytest

from ridelens.sources import files


def write(path, rows):
    def field(v):
        return "" if v is None else '"' + v.replace('"', '""') + '"' if any(x in v for x in ',"\n') else v
    path.write_text("\n".join(["a,b c,d", *(",".join(map(field, r)) for r in rows)]) + "\n", newline="")


@pytest.fixture()
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "40"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_equals_the_whole_file_reader(spark, tmp_path, small_blocks):
    rnd = random.Random(6)
    texts = ["x", None, "two\nlines", 'say "hi"', "a,b", '"""', "\n\n\n", 'mixed, "q"\nand\n"more"', "é\n中"]
    d = tmp_path / "csv"
    d.mkdir()
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [(f"{name}{i}", rnd.choice(texts), rnd.choice(texts)) for i in range(150)]
        rows[70] = (f"{name}70", "long\n" * 400 + 'end "q"', "after")  # a record over many blocks
        rows[90] = (f"{name}90", "-" * 2000, None)
        write(d / name, rows)
        want += rows
    got = files.read_raw(spark, str(d), position="at", line_breaks=True)
    assert got.columns == ["a", "b c", "d", "at"]
    blocks = {(r["file"], r["block"]) for r in got.select("at.*").distinct().collect()}
    assert len(blocks) > 20
    ours = [tuple(r)[:3] for r in got.orderBy("at").collect()]
    theirs = {tuple(r) for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(d)).collect()}
    assert [r[0] for r in ours] == [r[0] for r in want]  # file order
    assert set(ours) == theirs and len(ours) == len(want)
    assert [(a, b, c) for a, b, c in ours] == want


def test_no_line_breaks_and_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\r\n1,2\r\n\r\n3,\r\n", newline="")
    got = files.read_raw(spark, str(tmp_path), line_breaks=True)
    assert sorted(map(tuple, got.collect())) == [("1", "2"), ("3", None)]
    (tmp_path / "a.csv").write_text("a,b\n")
    assert files.read_raw(spark, str(tmp_path), line_breaks=True).collect() == []
