"""Prefix trie, spelling variants and token files against brute force and the library itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridelens.llm import prefix_trie as trie
from ridelens.llm import spelling, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string, depth string, part int, words string"


# ---------------------------------------------------------------------------- prefix trie
def md5(s: str) -> str:
    return hashlib.md5(s.encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), md5(md5(role or "") + md5(text or "")), (role or "", text or "")))
    own = {c: [x[2] for x in sorted(r)] for c, r in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
    return out


def brute_trie(rows):
    members, kids = defaultdict(list), defaultdict(list)
    seqs = rebuilt(rows)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def subtree(p):
        todo = [p]
        while todo:
            x = todo.pop()
            yield x
            todo += kids[x]

    out = {}
    for p, m in members.items():
        below = list(subtree(p))
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[x] for x in below), saved,
                               hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_rows(frame):
    rows = frame.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], TURNS)


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_PIECE", 3)
    rnd = random.Random(5)
    rows = []
    for c in rnd.sample(range(-60, 400), 150):
        for t in range(rnd.randint(1, 6)):
            rows.append((c, rnd.choice([None, t, t]), rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "a b", "c", "", None, "d  e\tf"])))
    rows += [(1000 + c, t, "user", f"hi {t}") for c in range(300) for t in range(3)]  # copies of one conversation
    rows += [(7, t, "user", f"turn {t % 2}") for t in range(900)]  # one conversation over several parts
    rows += [(5, 1, "user", "same")] * 40 + [(None, 1, "user", "nobody")] * 3
    assert trie_rows(trie.conversation_trie(turns(spark, rows).repartition(5))) == brute_trie(rows)


def test_long_conversation_is_spread(spark):
    rows = turns(spark, [(7, t, "user", f"turn {t}") for t in range(2000)] + [(20 + c, 0, "user", "x") for c in range(20)])
    parts = trie.prefixes(trie.rebuilt(rows)).where("conv_id = 7").groupBy("part").count().collect()
    assert len(parts) > 3 and max(r["count"] for r in parts) < 1000


def test_trie_of_nothing(spark):
    assert trie.conversation_trie(turns(spark, [])).collect() == []
    alone = trie_rows(trie.conversation_trie(turns(spark, [(21, 0, "user", "x")])))
    assert all(v == brute_trie([(21, 0, "user", "x")])[k] for k, v in alone.items())


def test_running_sums(spark):
    rnd = random.Random(3)
    data = sorted((rnd.choice([1, 2, 2, 2, 9]), i, rnd.randint(-5, 5), rnd.getrandbits(60)) for i in range(500))
    got = trie.running(trie.ranged(spark.createDataFrame(data, "k long, i long, s long, x long"), "k", "i"), "k", ["s"], ["x"]).collect()
    sums, xors, want = Counter(), Counter(), {}
    for k, i, s, x in data:
        sums[k] += s
        xors[k] ^= x
        want[k, i] = (sums[k], xors[k])
    assert {(r.k, r.i): (r.s, r.x) for r in got} == want


# ---------------------------------------------------------------------------- spelling variants
def brute_words(rows):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(small)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def brute_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def edited(rnd, w):
    i, c = rnd.randrange(len(w)), rnd.choice("abcdéÿ")
    return rnd.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])


def test_variants_equal_brute_force(spark):
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abcdeéà") for _ in range(rnd.randint(5, 9))) for _ in range(40)]
    rows = [(None, None), (1, ""), (2, "×÷ 123 日本語 é")]
    for i in range(600):
        words = []
        for _ in range(60):
            w = rnd.choice(base[:8] + base)
            words += [edited(rnd, w) if rnd.random() < 0.2 else w] * rnd.choice([1, 1, 4])
        rows.append((rnd.choice([i, i, None]), rnd.choice([" ", "-", ", ", "中"]).join(words).title()))
    rows += [(9000 + i, "Repeated" * 30 + " " + "x" * 70 + "y") for i in range(6)] + [(1, "doubled rows")] * 5
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n int, key string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}
    want = brute_variants(brute_words(rows))
    assert got == want and sum(v[0] is not None for v in want.values()) > 5


def test_crowded_chunks_lose_no_pair(spark):
    """A half shared by all words: every pair of crowded chunks is still found, by deletions."""
    rnd = random.Random(2)
    words = {"motion" + "".join(rnd.choice("abc") for _ in range(rnd.randint(5, 7))): 5 for _ in range(500)}
    words |= {"".join(rnd.choice("abc") for _ in range(6)) + "ations": 9 for _ in range(200)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    for crowd in (0, 20, 10_000):
        pairs = spelling.near_pairs(frame, crowd).collect()
        assert {tuple(sorted((r.a, r.b))) for r in pairs} == want and len(pairs) == len(want)


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_across_pieces(spark, monkeypatch):
    """Pieces end at bytes that no run holds; a run longer than a piece stays whole."""
    import pyarrow as pa
    monkeypatch.setattr(spelling, "PIECE", 64)
    text = " ".join(["separate"] * 50) + "ü" * 300 + " " + "ü" * 300
    got = spelling._count_words(pa.RecordBatch.from_pydict({"doc_id": [5], "text": [text]}), 6, 10 ** 9)
    assert Counter(dict(zip(got["word"].to_pylist(), got["n"].to_pylist()))) == Counter(re.findall("[A-Za-zÀ-ÿ]+", text))


# ---------------------------------------------------------------------------- token files
def sample_texts():
    rnd = random.Random(1)
    signs = list("abXY  \n\n\t.,'!|<>-09é×÷ßñ  中文🙂\r\x1c\x00") + ["'s", "'ll", " the", "<|endoftext|>", "\n\n", "don't", " word,\nNext"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(4000)] + ["", "a" * 3000, "one two three. " * 3000]


def test_chunks_give_the_ids_of_whole_texts():
    import pyarrow as pa
    with open(BPE, encoding="utf-8") as f:
        spec = f.read()
    assert token_files._splittable(spec)
    texts = sample_texts()
    for plain in (False, True):
        tok = Tokenizer.from_str(spec)
        tok.encode_special_tokens = plain
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        for split in (True, False):
            ids, starts = token_files.encode_batch(pa.array(texts), spec, plain, split)
            assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == want


@pytest.fixture(scope="module")
def docs_rows():
    texts = sample_texts()[:600]
    ids = [*range(-100, len(texts) - 100)]
    random.Random(4).shuffle(ids)
    return list(zip(ids, texts)) + [(None, "no id"), (None, None), (10 ** 12, None), (3, "again"), (3, "again")]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, docs_rows, encoding):
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs_rows], "doc_id long, text string, part int, start long, ids string")
    folder = str(tmp_path / "f")
    token_files.write_tokens(docs.repartition(4), folder, BPE, encoding, row_group_bytes=2_000, page_rows=20)
    got = token_files.token_digests(token_files.read_tokens(spark, folder)).collect()
    tok, want, at = Tokenizer.from_file(BPE), [], 0
    order = {r.i: (r.doc_id is None, r.doc_id or 0, r.h is not None, r.h or 0) for r in spark.createDataFrame(
        [(i, d, t) for i, (d, t) in enumerate(docs_rows)], "i int, doc_id long, text string").select(
        "i", "doc_id", F.xxhash64(F.coalesce("text", F.lit(None))).alias("h")).collect()}
    for i in sorted(order, key=order.get):
        ids = [*tok.encode(docs_rows[i][1] or "", add_special_tokens=False).ids, 0]
        want.append((docs_rows[i][0], at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)

    files = sorted((tmp_path / "f" / "tokens").glob("*.parquet"))
    assert len(files) > 1
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = cols["ids.list.element"]
            assert ("RLE_DICTIONARY" in ids.encodings) == (encoding == "dictionary")
            assert encoding == "dictionary" or "DELTA_BINARY_PACKED" in ids.encodings
            assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings and cols["doc_id"].has_offset_index and cols["doc_id"].has_column_index
    assert groups > len(files)


def test_selective_reads(spark, tmp_path, docs_rows):
    docs = spark.createDataFrame(docs_rows, "doc_id long, text string")
    folder = str(tmp_path / "f")
    token_files.write_tokens(docs, folder, BPE)
    some = token_files.read_tokens(spark, folder, 10, 20)
    assert sorted(r.doc_id for r in some.collect()) == list(range(10, 21))
    plan = some.select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("\n") if "FileScan parquet" in x and "doc_id" in x)
    assert "ids" not in scan.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(doc_id)" in scan


def test_token_files_of_nothing(spark):
    assert token_files.token_round_trip(spark.createDataFrame([], "doc_id long, text string"), BPE).collect() == []
