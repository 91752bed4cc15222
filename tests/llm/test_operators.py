"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties,
repeated rows and extra columns with clashing names; and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpus_pipeline import mixture, near_duplicates
from ridelens.llm.ann import chi_square_cdf, nearest_neighbours
from ridelens.llm.decontaminate import common_subsequence, contaminated
from ridelens.llm.graph import components, may_contain, membership
from ridelens.llm.license_scan import TEMPLATES, scan_licenses
from ridelens.llm.line_dedup import dedup_lines, line_dedup_report
from ridelens.llm.lm import context_tree_scores
from ridelens.llm.mixing import mix_sources
from ridelens.llm.ngram_join import ngram_jaccard_join
from ridelens.llm.quality import classify_quality
from ridelens.llm.substring import substring_dedup
from ridelens.llm.warc import warc_round_trip

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component long, size int"
rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 5))) for _ in range(60)]


def _text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _corpus():
    base = [_text(60) for _ in range(8)]
    texts = [None, "", "  \n ", "one", "One  TWO three", "x" * 3000, "a a a a " * 300, *base]
    for t in base:
        w = t.split()
        near = w[:30] + ["zz"] + w[31:]
        texts += [t, " ".join(near), " ".join(w[:10] + ["q", "r"] + w[12:40] + ["s"] + w[41:]), _text(5) + "\n" + t[:150] + "\n" + _text(6)]
    texts += ["All rights reserved. " + _text(5), "Licensed under CC BY-NC 4.0.\n" + _text(9), "GNU General  Public-License! " * 2]
    rows = [(i, t, "en", [None, "a", "b", "é"][i % 4], 1, 0.5, 3, 2) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[9], (None, base[0], None, None, None, None, None, None), (None, None, None, "a", None, None, None, None)]


ROWS = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text, lower=True):
    b = (text or "").encode()
    return (b.translate(LOWER) if lower else b).split()


def test_components_and_membership(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (5, 5), (None, 3)] + [(300 + i, 300) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, **{300 + i: 300 for i in range(50)}}
    keys = spark.createDataFrame([(1,), (5,), (None,)], "k long")
    bits = membership(keys, keys["k"]).value
    assert may_contain(bits, np.array([1, 5])).all() and may_contain(bits, np.arange(100, 5000)).mean() < 0.01


def test_line_dedup(spark, docs, nothing):
    line = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(1, f"{line}\nunique line of the first document", None), (2, f"  {line.upper()}  \n\n{line.replace('lazy', 'lazi')}", 1),
            (3, None, None), (4, "", 2), (5, "something else entirely, kept as it is", 3), (None, line, 4), (2, "other text of id two", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, line long")
    got = sorted((r.doc_id or 99, r.n_lines, r.n_removed, r.removed_lines) for r in line_dedup_report(d).collect())
    assert got == [(1, 2, 0, []), (2, 1, 0, []), (2, 2, 2, [0, 2]), (3, 0, 0, []), (4, 0, 0, []), (5, 1, 0, []), (99, 1, 1, [0])]
    kept = {(r.doc_id, r.text) for r in dedup_lines(d).collect()}
    assert kept == {(1, rows[0][1]), (3, None), (4, ""), (5, rows[4][1]), (2, rows[6][1])}
    assert line_dedup_report(nothing).count() == 0 and line_dedup_report(docs).count() == len(ROWS)


def _tree(counts, depth):
    """Counts of decisions by (context, node) at each depth, straight from the definition."""
    nodes = defaultdict(lambda: [0, 0])
    for gram, n in counts.items():
        for d in range(depth + 1):
            node = 1
            for i in range(7, -1, -1):
                bit = gram[-1] >> i & 1
                nodes[gram[-1 - d:-1] if d else b"", d, node][bit] += n
                node = node * 2 + bit
    return nodes


def test_context_trees(spark, docs, nothing):
    depth = 2
    lg = math.lgamma
    kt = lambda a, b: lg(a + .5) + lg(b + .5) - lg(a + b + 1) - math.log(math.pi)
    grams = lambda t: [b[i:i + depth + 1] for b in [b"\0" * depth + (t or "").encode().translate(LOWER) + b"\xff"] for i in range(len(b) - depth)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, unigrams = Counter(), Counter()
    for i, t, *_ in ROWS:
        if not held(i):
            counts.update(grams(t))
            unigrams.update([*_words(t), None])
    nodes = _tree(counts, depth)
    children = defaultdict(set)
    for ctx, d, node in nodes:
        if d:
            children[ctx[1:], d - 1, node].add((ctx, d, node))
    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(*nodes[key])
            memo[key] = own if key[1] == depth else np.logaddexp(own, sum(weighted(c) for c in children[key])) - math.log(2)
        return memo[key]

    def p(ctx, d, node, bit):
        a = nodes.get((ctx[depth - d:], d, node), [0, 0])
        est = (a[bit] + .5) / (sum(a) + 1)
        if d == depth:
            return est
        key = (ctx[depth - d:], d, node)
        stop = math.exp(kt(*a) - math.log(2) - weighted(key)) if key in nodes else .5
        return stop * est + (1 - stop) * p(ctx, d + 1, node, bit)

    def score(t):
        total = 0
        for g in grams(t):
            node = 1
            for i in range(7, -1, -1):
                bit = g[-1] >> i & 1
                total += math.log10(p(g[:-1], 0, node, bit))
                node = node * 2 + bit
        return total

    n, v = sum(unigrams.values()), len(unigrams)
    want = sorted(((i is None, i or 0, len(_words(t)) + 1, sum(unigrams[w] > 0 for w in [*_words(t), None]), n,
                    sum(math.log10((unigrams[w] + 1) / (n + v + 1)) for w in [*_words(t), None]), score(t)) for i, t, *_ in ROWS))
    for limit in (1 << 19, 3):  # all in the table, nearly all joined
        rows = context_tree_scores(docs, depth=depth, table_keys=limit).collect()
        assert all(r.held_out == held(r.doc_id) for r in rows)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
        assert np.allclose(np.array(got, float), np.array(want, float), rtol=1e-9, atol=1e-7)
    assert context_tree_scores(nothing, depth=depth).count() == 0


def test_substring_dedup(docs, nothing):
    order = sorted({(i is None, i or 0, t) for i, t, *_ in ROWS}, key=lambda r: r[:2])
    first = {}
    for last, i, t in order:
        w = _words(t, lower=False)
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s:s + 20]), (last, i, s))
    want = []
    for i, t, *_ in ROWS:
        w = _words(t, lower=False)
        cover = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s:s + 20])] != (i is None, i or 0, s):
                cover |= set(range(s, s + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in cover)
        want.append((i is None, i or 0, len(w), len(cover), hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[3] for w in want) > 500
    assert substring_dedup(nothing).count() == 0


def test_warc_round_trip(spark):
    long = "<p>" + "ü" * 80 + "</p>"
    rows = [(3, "http://a/b c\r\n", long, 1), (2, None, long, 2), (5, "", long, 3), (2, "http://x", long, 4), (7, "u", "short", 5),
            (8, "u", "short", 6), (9, "u", None, 7), (None, None, long, 8), (None, "u", "", 9), (11, "u", "WARC/1.1\r\n\r\n" * 5000, 10)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        revisit = h == long and i != 2
        want.append((i or 0, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else 0))
    got = [(r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc_round_trip(d).collect()]
    assert sorted(got) == sorted(want)
    assert warc_round_trip(d.limit(0)).count() == 0


def test_decontamination(spark, nothing):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(30), 1.0) for i in range(6)] + [(6, None, 1.0), (7, "", 1.0), (0, None, 1.0)]
    clean = [(100 + i, say(200), 1) for i in range(40)] + [(None, None, 1), (200, "", 1)]
    exact = [(i, f"{say(90)} {items[i][1].upper()}! {say(70)}", 1) for i in range(3)]
    words = items[4][1].split()
    para = [(4, f"{say(50)} {' '.join(w if k % 6 else 'other' for k, w in enumerate(words))} {say(40)}", 1), (5, say(3000) + " " + items[5][1], 1)]
    d = spark.createDataFrame(clean + exact + para + exact[:1], "doc_id long, text string, cosine int")
    b = spark.createDataFrame(items, "item_id long, text string, cosine double")
    got = sorted((x.doc_id, x.item_id) for x in contaminated(d, b).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5)]
    assert contaminated(d, b.limit(0)).count() == 0
    assert contaminated(nothing, b).count() == 0
    for _ in range(50):
        x, y = ([r.randrange(5) for _ in range(r.randrange(1, 12))] for _ in range(2))
        t = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        assert common_subsequence(np.array(x), np.array(y)) == t[-1, -1]


def test_mixture(spark, docs, nothing):
    rows = mix_sources(docs).collect()
    size = defaultdict(int)
    for _, t, _, s, *_ in ROWS:
        size[s] += len(_words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1] * 9))
    target, open_ = {}, set(order)
    while True:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    target |= share
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert sum(taken.values()) <= sum(size.values())
    most = max(len(_words(t)) for _, t, *_ in ROWS)
    assert all(abs(taken[s] - target[s]) <= 2 * most for s in order)
    key = lambda x: sorted((r.doc_id or -1, r.source or "", r.taken) for r in x)
    assert key(rows) == key(mix_sources(docs.repartition(5)).collect()) and len(rows) == len(ROWS)
    assert mix_sources(nothing).count() == 0


def test_quality(spark, docs, nothing):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [r.choice(WORDS) for _ in range(60)]
        rows.append((i, " ".join(x + "%%%" if bad else x for x in w), "en"))
        labels.append((i, 0 if bad else 1, "x"))
    d = spark.createDataFrame(rows, "doc_id long, text string, stats string")
    y = spark.createDataFrame(labels + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    got = classify_quality(d, y).collect()
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= .3) for g in got)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert np.mean([g.predicted == int(g.doc_id % 4 != 0) for g in got if g.held_out]) > 0.97
    assert classify_quality(nothing, y).count() == 0
    none = classify_quality(docs, y.limit(0)).collect()
    assert len(none) == len(ROWS) and {g.score for g in none} == {0.5}


def test_nearest_neighbours(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 16))
    x[300:330] = x[0]
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None, 1), (950, [0.0] * 16, 1), (1000, [float("nan")] * 16, 1), (1050, [1.0] * 3, 1), (1100, [], 1), (None, [1.0] * 16, 1),
           (1150, [None] * 16, 1), rows[50]]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    got = defaultdict(dict)
    for g in nearest_neighbours(d).collect():
        got[g.query_id][g["rank"]] = (g.vec_id, g.score)
    assert set(got) == set(range(0, 600, 50))
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        c = unit @ unit[q]
        c[q] = -2
        best = np.lexsort((np.arange(600), -np.round(c, 12)))[:5]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(math.isclose(s, c[v], abs_tol=1e-12) for v, s in found.values())
        hits += len(set(best.tolist()) & {v for v, _ in found.values()})
    assert hits >= 0.9 * 5 * len(got) and [got[0][k][0] for k in range(1, 6)] == [300, 301, 302, 303, 304]
    assert nearest_neighbours(d.limit(0)).count() == 0
    assert math.isclose(float(chi_square_cdf(np.array([7.344121]), 8)[0]), 0.5, abs_tol=1e-6)


def test_ngram_join(docs, nothing):
    sets = []
    for i, t, *_ in ROWS:
        w = tuple(_words(t))
        sets.append({w[k:k + 5] for k in range(max(1, len(w) - 4))} if w else set())
    ids = [r[0] for r in ROWS]
    low = {i: i for i in ids if i is not None}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for a in range(len(ROWS)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (ids[a], ids[b]) and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                low[max(x, y)] = min(x, y)
    want = [(i if i is not None else -1, len(s), find(i) if i is not None else -1) for i, s in zip(ids, sets)]
    for heavy in (1 << 16, 0):
        got = [(r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1)
               for r in ngram_jaccard_join(docs, heavy_keys=heavy).collect()]
        assert sorted(got) == sorted(want)
    assert ngram_jaccard_join(nothing).count() == 0


def test_near_copies_of_one_text(spark):
    r = random.Random(5)
    base = _text(150).split()
    rows = []
    for i in range(60):  # copies with as many edits as leave some pairs above and some below the threshold
        w = list(base)
        for _ in range(4):
            w[r.randrange(150)] = f"edit{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k:k + 5]) for k in range(146)} for _, t in rows]
    low = list(range(60))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for a in range(60):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.doc_id: g.component_id for g in got} == {i: find(i) for i in range(60)}


def test_license_scan(docs, nothing):
    phrases = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
    want = []
    for i, t, *_ in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in phrases for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        want.append((i if i is not None else -1, len(w), len(at), min(places, default=-1), max(places, default=-1), ",".join(sorted({x for _, x in at}))))
    rows = scan_licenses(docs).collect()
    none = lambda v: -1 if v is None else v
    assert sorted((none(r.doc_id), r.n_words, r.n_base, none(r.first_word), none(r.last_word), r.base_labels) for r in rows) == sorted(want)
    assert any("cc-by-nc-4.0" in r.labels for r in rows) and all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in rows)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in rows)
    assert scan_licenses(nothing).count() == 0


def _shingles(line):
    return {line[k:k + 5] for k in range(max(1, len(line) - 4))}


def test_lines_around_one_base(spark):
    r = random.Random(5)
    base = "q" + "".join(r.choice("abcdefghijklmnop") for _ in range(118)) + "q"
    lines = [base]
    for _ in range(150):  # each near the base, but many not near each other
        w = list(base)
        for _ in range(2):
            w[r.randrange(120)] = r.choice("0123456789")
        lines.append("".join(w))
    sets = [_shingles(x) for x in lines]
    assert all(100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets)
    rows = [(i, x) for i, x in enumerate(lines)]
    got = line_dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(g.doc_id for g in got if not g.n_removed) == [0]


def test_short_and_edited_lines(spark):
    r = random.Random(11)
    say = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2))
    lines = ["-" * n for n in (6, 9, 40, 300)] + ["ha " * 5 + "h", "ha " * 90 + "h", "ab", "abc", "".join(r.choice("01") for _ in range(900)),
                                                  "".join(r.choice("01") for _ in range(900))]
    for n in (9, 13, 14, 16, 20, 25, 35, 42, 48, 55):  # one character changed at the end, one in the middle
        for _ in range(4):
            base = "x" + say(n) + "x"
            lines += [base, base[:-1] + "7", base[:n // 2] + "8" + base[n // 2 + 1:]]
    for n in (70, 120, 150, 170, 400):  # edits spread over the line, as many as the threshold allows
        for _ in range(6):
            base = "x" + say(n) + "x"
            w, k = list(base), (n - 4) // 45
            for j in range(k):
                w[(2 * j + 1) * n // (2 * k)] = "9"
            lines += [base, "".join(w)]
    sets = [_shingles(x) for x in lines]
    low = list(range(len(lines)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    near = [(a, b) for a in range(len(lines)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for a, b in near:
        low[max(find(a), find(b))] = min(find(a), find(b))
    assert len(near) > 60
    got = line_dedup_report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)).collect()
    assert {g.doc_id for g in got if not g.n_removed} == {find(i) for i in range(len(lines))}


def test_license_blocks_at_all_places(spark):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())

    long = next(t for label, t in TEMPLATES if label == "bsd")
    notices = ["Licensed under the terms of the MIT License", "Licensed under the terms of CC BY NC 4.0", long.replace("source", "their source"),
               "Released under the MIT License. Released by us under the the MIT License"]
    rows = [(i, "word " * shift + notice + " of the end" * (i % 3)) for i, (notice, shift) in
            enumerate((n, s) for n in notices for s in range(24))] + [(900, None), (901, "the the the under")]
    want = {}
    for i, text in rows:
        w, want[i] = words(text or ""), []
        for label, template in TEMPLATES:
            t = words(template)
            need = math.ceil(0.9 * len(set(t)) - 1e-9)
            for k in range(len(w)):
                n = len(set(w[k:k + 2 * len(t)]) & set(t))
                if w[k] in t and n >= need:
                    want[i].append((label, k, round(n / len(set(t)), 9)))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {g.doc_id: sorted((b.label, b.first_word, round(b.containment, 9)) for b in g.blocks) for g in got} == {i: sorted(w) for i, w in want.items()}
    assert all("mit" in g.labels for g in got if g.doc_id < 24) and all("cc-by-nc-4.0" in g.labels for g in got if 24 <= g.doc_id < 48)


def test_pipeline_rows_of_equal_or_null_id(spark):
    a, b, c = (_text(60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (None, c), (None, c), (None, b), (3, None), (None, None)]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter((g.doc_id, g.text) for g in got) == Counter([(1, a), (1, b), (None, c), (3, None), (None, None)])


def test_pipeline_mixture_rows(spark, docs):
    got = mixture(spark, docs, "").collect()
    key = lambda rows: Counter((r.doc_id, r.source, r.copies) for r in rows)
    assert key(got) == key(r for r in mix_sources(docs).collect() if r.copies) and 0 < len(got) < len(ROWS)
