"""The pipeline's stages one after another against brute force, with clashing columns, nulls and empty tables."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, text_key string, kept_key int, row int"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(4000)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [say(25) for _ in range(6)]
    good = ["\n".join(say(12) for _ in range(6)) for _ in range(60)]
    texts = list(good)
    texts += [t.upper() for t in good[:10]]  # near copies of whole documents
    texts += [say(30) + " " + items[i % 6] + " " + say(30) for i in range(12)]
    texts += [say(40) + "\n" + good[20].split("\n")[2] for _ in range(8)]  # a line of another document
    texts += [None, "", " \n "]
    rows = [(i, t, "en", "web" if i % 3 else "books", len(t or ""), "a", "b", 1, 2) for i, t in enumerate(texts)]
    rows += [(None, say(50), "en", None, 1, "a", "b", 1, 2), rows[3]]
    d = tmp_path_factory.mktemp("world")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows, items


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())


def test_stages_against_brute_force(spark, world):
    folder, rows, items = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = p.quality(spark, docs, folder)
    assert Counter(map(tuple, good.collect())) == Counter(rows)  # without labels all score alike, over the threshold

    left = p.lines(spark, good, folder)
    assert left.columns == docs.columns
    seen, want = set(), {}
    for r in sorted((r for r in set(rows) if r[0] is not None), key=lambda r: r[0]):
        lines = (r[1] or "").split("\n")
        keep = [x for x in lines if not x.strip() or x.strip().lower() not in seen]
        seen |= {x.strip().lower() for x in lines}
        if [x for x in keep if x.strip()] or not [x for x in lines if x.strip()]:
            want[r[0]] = None if r[1] is None else "\n".join(keep)
    got = {r.doc_id: r.text for r in left.collect() if r.doc_id is not None}
    assert got == want

    one = p.near_duplicates(spark, docs, folder).collect()  # on whole documents: the line stage leaves no near copies
    shingles = lambda t: {tuple(words(t)[i:i + 5]) for i in range(max(1, len(words(t)) - 4))} if words(t) else set()
    kept = []
    for r in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        a = shingles(r[1])
        if not any(a and 100 * len(a & b) >= 80 * len(a | b) for b in map(shingles, (k[1] for k in kept))):
            kept.append(r)
    assert Counter(map(tuple, one)) == Counter(kept)

    clean = p.decontamination(spark, docs, folder)
    leak = lambda t: any(" " + i + " " in " " + " ".join((t or "").split()) + " " for i in items)
    assert Counter(map(tuple, clean.collect())) == Counter(r for r in rows if not leak(r[1]))


def test_run_keeps_what_each_stage_keeps(spark, world):
    folder, rows, items = world
    got = p.run(spark, folder).collect()
    assert got and all(r.copies > 0 for r in got)
    leaked = {r[0] for r in rows if any(i in (r[1] or "") for i in items)}
    assert not leaked & {r.doc_id for r in got} and not {60, 61, 69} & {r.doc_id for r in got}


def test_empty_tables(spark, world, tmp_path):
    folder, *_ = world
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert p.decontamination(spark, docs, str(tmp_path)).count() == docs.count()


def test_decontamination_finds_leaks_that_lose_the_rare_words(spark, tmp_path):
    """The four words that are lost carry most of the item's weight; what is left are frequent words, in order."""
    rnd = random.Random(6)
    common = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "kl"]
    item = [rnd.choice(common) for _ in range(20)]
    for j in (2, 7, 12, 17):
        item[j] = f"rare{j}"
    leak = " ".join(["own"] * 9 + [rnd.choice(common) if w.startswith("rare") else w for w in item] + ["own"] * 9)
    texts = [" ".join(rnd.choice(common) for _ in range(60)) for _ in range(120)] + [leak]
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in p.decontamination(spark, docs, str(tmp_path)).collect()}
    assert 120 not in kept and len(kept) >= 110
