"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into overlapping passages.  Their TF-IDF vectors over the
benchmark's informative words (weights from all documents' passages) are projected on the leading right
singular vectors of the matrix of all passages, found by a distributed randomised SVD: each task
sums its part of ``A'(A G)`` for a random ``G``, and the small factorisation of the sum is done once.
The benchmark's own passages are rows of the matrix too, with a weight that keeps their directions among
the leading ones however seldom they leak; the rank is their number and ``RANK`` more.  Cosines in
that space give candidates, and so does the share of an item's own weight that a passage holds, so a
short item counts however much other benchmark text stands around it.  For candidates words are compared in
order: the longest common subsequence with the item, and how much of the item's answer (its closing words) it holds.

The space may miss a leak whose lost words carry most of an item's weight.  So the pairs it proposes nothing for are searched
exactly (``_Rest``): a text that leaks an item holds one of a few of its rarest words, by the number of words that may be lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.license_scan import NORMAL
from ridelens.llm.words import Lookup, pieces, word_hashes

PART = 2 << 20
#: Items of one block of queries; larger benchmarks are searched in several blocks.
BLOCK_ITEMS = 500
PASSAGE, STRIDE = 64, 32
RANK, EXTRA = 32, 16
#: Words in at most this share of all passages (or this many) are informative; an item keeps its rarest in any case.
MAX_SHARE, FEW = 0.0005, 20
MIN_TERMS, KEPT_TERMS = 3, 8
COSINE = 0.5
#: A passage that holds at least this share of an item's weight is a candidate, whatever else it holds.
OWN_SHARE = 0.5
ANSWER_WORDS = 8
#: Cells of the table of a group of texts and the items' words.
CELLS = 1 << 24


def _passages(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last + 1 word of each passage; the last one of a text ends with it."""
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(1, -(-(n - PASSAGE) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = offsets[text] + k * STRIDE
    return text, first, np.minimum(first + PASSAGE, offsets[text + 1])


def _term_counts(at: np.ndarray, term: np.ndarray, first: np.ndarray, last: np.ndarray, n_terms: int):
    """``(passage, term, count)`` of the terms at word positions ``at`` within each passage."""
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, last)
    size = hi - lo
    passage = np.repeat(np.arange(len(first)), size)
    take = np.arange(len(passage)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    key = np.sort(passage * n_terms + term[take])
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    return key[start] // n_terms, key[start] % n_terms, np.diff(np.append(start, len(key)))


class _Space:
    """Terms with their weights: ``tf = 1 + log(count)``, ``idf = log((1 + passages) / (1 + df)) + 1``."""

    def __init__(self, terms: np.ndarray, df: np.ndarray, passages: int, keep: np.ndarray, least: int):
        self.terms, self.least = terms[keep], least
        self.idf = np.log((1 + passages) / (1 + df[keep])) + 1

    def passages(self, table: Lookup, words: np.ndarray, offsets: np.ndarray):
        """Texts and bounds of the passages with at least ``least`` distinct terms, the norms of their rows, and the sparse unit rows."""
        found = table.find(words)
        at = np.flatnonzero(found >= 0)
        text, first, last = _passages(offsets)
        passage, term, count = _term_counts(at, found[at].astype(np.int64), first, last, max(1, len(self.terms)))
        enough = np.bincount(passage, minlength=len(text))[passage] >= self.least
        passage, term, count = passage[enough], term[enough], count[enough]
        value = ((1 + np.log(count)) * self.idf[term]).astype(np.float32)
        start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.zeros(0, np.int64)
        rows = passage[start]
        norm = np.sqrt(np.add.reduceat(value ** 2, start)) if len(start) else np.zeros(0, np.float32)
        row_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(passage))))
        return text[rows], first[rows], last[rows], norm, start, row_of, term, value / norm[row_of] if len(start) else value


def _times(dense: np.ndarray, start: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sparse passage rows times a dense matrix over terms."""
    if not len(start):
        return np.zeros((0, dense.shape[1]), np.float32)
    return np.add.reduceat(dense[term] * value[:, None], start, axis=0)


def _frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and the number of passages, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]):
        table = Lookup(terms, terms)
        df, passages = np.zeros(len(terms) + 1, np.int64), 0
        for part in pieces(batches, size=PART):
            words, offsets = word_hashes(part.column("text"), table=NORMAL)
            found = table.find(words)
            at = np.flatnonzero(found >= 0)
            text, first, last = _passages(offsets)
            _, term, _ = _term_counts(at, found[at].astype(np.int64), first, last, max(1, len(terms)))
            df += np.bincount(term, minlength=len(df))
            passages += len(text)
        df[-1] = passages
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(df)), "n": df})

    total = np.zeros(len(terms) + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r.i] = r.n
    return total[:-1], int(total[-1])


def _right_vectors(docs: DataFrame, space: _Space, queries: np.ndarray, passages: int, seed: int) -> np.ndarray:
    """Leading right singular vectors of the passages' TF-IDF matrix (Nystrom form of the randomised SVD).

    ``queries`` are the benchmark's rows; each weighs as much as all corpus passages could together.
    """
    m = len(space.terms)
    rank = min(m, len(queries) + RANK)
    k = min(m, rank + EXTRA)
    g = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, k)))[0].astype(np.float32)

    def run(batches):
        table = Lookup(space.terms, space.terms)
        total = np.zeros((m, k))
        for part in pieces(batches, size=PART):
            words, offsets = word_hashes(part.column("text"), table=NORMAL)
            *_, start, row_of, term, value = space.passages(table, words, offsets)
            if not len(start):
                continue
            projected = _times(g, start, term, value)
            order = np.argsort(term, kind="stable")
            t = term[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            total[t[first]] += np.add.reduceat(projected[row_of[order]] * value[order, None], first, axis=0)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), k).cast(pa.list_(pa.float64()))],
            names=["term", "row"])

    y = max(passages, 1) * (queries.T @ (queries @ g)).astype(float)
    sums = docs.select("text").mapInArrow(run, "term long, row array<double>").groupBy("term").agg(
        F.array(*[F.sum(F.col("row")[j]) for j in range(k)]).alias("row")).toArrow()
    for t, row in zip(sums["term"].to_pylist(), sums["row"].to_pylist()):
        y[t] += row
    inner = g.T.astype(float) @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((m, 1))
    b = y @ (vectors[:, good] / np.sqrt(values[good]))
    return np.linalg.svd(b, full_matrices=False)[0][:, :rank]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; the rows of the table are bits of one integer."""
    where: dict[int, int] = {}
    for j, w in enumerate(b.tolist()):
        where[w] = where.get(w, 0) | (1 << j)
    full = row = (1 << len(b)) - 1
    for w in a.tolist():
        both = row & where.get(w, 0)
        row = ((row + both) | (row - both)) & full
    return len(b) - row.bit_count()


def _answer(item: np.ndarray) -> np.ndarray:
    return item[-min(ANSWER_WORDS, max(1, len(item) // 3)):]


def _shares(item: np.ndarray, region: np.ndarray) -> tuple[float, float]:
    """Share of the item, and of its answer, that a region of a document holds in order."""
    answer = _answer(item)
    return common_subsequence(item, region) / len(item), common_subsequence(answer, region) / len(answer)


def _least(share: float, n: int) -> int:
    """The smallest number of ``n`` words that makes up the share; ``n + 1`` if none does."""
    return next((c for c in range(1, n + 1) if c / n >= share), n + 1)


class _Rest:
    """Finds every pair of a text and an item it leaks, without the space.

    A leak holds ``whole`` words of the item in order, or ``part`` of them and ``closing`` of its answer.  So it
    holds one of the rarest ``n - whole + 1`` words, or one of the rarest ``n - part + 1`` and one of the answer's rarest: texts
    with none of these are out, then those that hold too few of the item's words at all.
    """

    def __init__(self, terms: np.ndarray, df: np.ndarray, place: np.ndarray, offsets: np.ndarray, lcs_share: float,
                 paraphrase_share: float, answer_share: float):
        self.terms, self.items = terms, [place[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        self.needs, term_of, item_of = [], [], []
        for i, own in enumerate(self.items):
            n, last = len(own), _answer(own)
            whole, part, closing = _least(lcs_share, n), _least(paraphrase_share, n), _least(answer_share, len(last))
            self.needs.append((whole, part, closing))
            rarest, answer = own[np.argsort(df[own], kind="stable")], last[np.argsort(df[last], kind="stable")]
            some = min(np.unique(rarest[:n - part + 1]), np.unique(answer[:len(last) - closing + 1]), key=lambda w: df[w].sum())
            anchors = np.union1d(rarest[:n - whole + 1], some)
            term_of.append(anchors)
            item_of.append(np.full(len(anchors), i))
        term, item = np.concatenate(term_of), np.concatenate(item_of)
        order = np.argsort(term, kind="stable")
        self.anchor_items = item[order]
        self.bounds = np.searchsorted(term[order], np.arange(len(terms) + 1))

    def pairs(self, found: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Texts and items that their words leave room for; ``found`` numbers the words of all texts."""
        m, k = len(self.terms), len(self.items)
        for lo in range(0, len(offsets) - 1, max(1, CELLS // m)):
            hi = min(lo + max(1, CELLS // m), len(offsets) - 1)
            own = found[offsets[lo]:offsets[hi]]
            at = np.flatnonzero(own >= 0)
            text = np.searchsorted(offsets[lo:hi + 1] - offsets[lo], at, "right") - 1
            holds = np.zeros((hi - lo, m), bool)
            holds[text, own[at]] = True
            near = np.zeros((hi - lo, k), bool)
            anchored = np.flatnonzero(np.diff(self.bounds))
            row, col = np.nonzero(holds[:, anchored])
            first, size = self.bounds[anchored[col]], np.diff(self.bounds)[anchored[col]]
            step = max(1, CELLS // k)
            for a in range(0, len(row), step):
                n = size[a:a + step]
                run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:a + step], n)
                near[np.repeat(row[a:a + step], n), self.anchor_items[run]] = True
            for i in np.flatnonzero(near.any(axis=0)).tolist():
                rows, item, (whole, part, closing) = np.flatnonzero(near[:, i]), self.items[i], self.needs[i]
                count = holds[rows[:, None], item].sum(axis=1)
                last = holds[rows[:, None], _answer(item)].sum(axis=1)
                for t in rows[(count >= whole) | ((count >= part) & (last >= closing))].tolist():
                    yield lo + t, i

    def best(self, i: int, item: np.ndarray, words: np.ndarray) -> tuple[float, float, int] | None:
        """Shares and place of the region of ``words`` that holds most of a leaked item; regions are one and a half times as long
        and start at any word of it.  A region's sequence grows by at most the words that enter it, so the next one tried is
        the first that could do."""
        whole, part, closing = self.needs[i]
        n, last, width = len(item), _answer(item), len(item) + len(item) // 2
        hit = np.flatnonzero(np.isin(words, item))
        end = np.searchsorted(hit, hit + width)
        room = np.flatnonzero(end - np.arange(len(hit)) >= min(whole, part))
        most, found, at = 0, None, 0
        while at < len(room):
            j = room[at]
            region = words[hit[j]:hit[j] + width]
            size, held = common_subsequence(item, region), common_subsequence(last, region)
            if size > most and (size >= whole or (size >= part and held >= closing)):
                most, found = size, (size / n, held / len(last), int(hit[j]))
            lacking = max(most + 1 - size, min(whole - size, max(part - size, closing - held)))
            at = max(at + 1, int(np.searchsorted(end[room], end[j] + lacking)))
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs_share: float = 0.8,
                 paraphrase_share: float = 0.6, answer_share: float = 0.75, seed: int = 11) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, answer_share, first_word``: one row per document id and benchmark
    item it leaks; ``docs`` has ``doc_id, text`` and ``benchmark`` ``item_id, text``.

    A leak holds at least ``lcs_share`` of the item's words in order within a region of one and a half
    times its length, or ``paraphrase_share`` of them together with ``answer_share`` of its answer (its
    closing words).  The space proposes the places; pairs it has none for are searched exactly, so every leak is found.  Words are runs of letters, digits and other characters from U+0080 on, A-Z lower-cased.
    Null and empty texts and items neither leak nor are leaked; rows with a null doc_id are
    reported with a null id; repeated rows and items with equal ids give one row per pair of ids (the
    best place); other columns are ignored; an empty table on either side gives an empty result.
    Texts are searched whole, against all items, in blocks of ``BLOCK_ITEMS``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        part = _search(docs, rows, cosine, lcs_share, paraphrase_share, answer_share, seed)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("lcs_share", "cosine", "answer_share", -F.col("first_word"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.cosine", "best.lcs_share", "best.answer_share", (-F.col("best.col4")).alias("first_word"))


def _search(docs: DataFrame, items: pa.Table, cosine: float, lcs_share: float, paraphrase_share: float, answer_share: float,
            seed: int) -> DataFrame:
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"
    words, offsets = word_hashes(items["text"], table=NORMAL)
    if not len(words):
        return docs.sparkSession.createDataFrame([], schema)
    terms = np.unique(words)
    df, n_passages = _frequencies(docs, terms)
    # words in very many passages say little, but an item keeps its rarest words in any case
    keep = df <= max(MAX_SHARE * n_passages, FEW)
    place = np.searchsorted(terms, words)
    for a, b in zip(offsets[:-1], offsets[1:]):
        own = np.unique(place[a:b])
        if keep[own].sum() < KEPT_TERMS:
            keep[own[np.argsort(df[own], kind="stable")[:KEPT_TERMS]]] = True
    least = min(MIN_TERMS, min(int(keep[np.unique(place[a:b])].sum()) for a, b in zip(offsets[:-1], offsets[1:]) if b > a))
    space = _Space(terms, df, n_passages, keep, least)
    rest = _Rest(terms, df, place, offsets, lcs_share, paraphrase_share, answer_share)
    q_text, q_first, q_last, q_norm, start, row_of, term, value = space.passages(Lookup(space.terms, space.terms), words, offsets)
    rows = np.zeros((len(start), len(space.terms)), np.float32)
    rows[row_of, term] = value
    basis = _right_vectors(docs, space, rows, n_passages, seed).astype(np.float32)
    queries = np.ascontiguousarray((rows @ basis).T)
    ids = items["item_id"].to_pylist()
    item_words = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:])]

    def run(batches):
        table, all_terms = Lookup(space.terms, space.terms), Lookup(rest.terms, rest.terms)
        for part in pieces(batches, size=PART):
            doc_words, doc_offsets = word_hashes(part.column("text"), table=NORMAL)
            text, first, last, norm, start, _, term, value = space.passages(table, doc_words, doc_offsets)
            out: dict = {}
            for at in range(0, len(start), 8192):
                rows = slice(at, at + 8192)
                stop = start[at + 8192] if at + 8192 < len(start) else len(term)
                begin = start[at]
                z = _times(basis, start[rows] - begin, term[begin:stop], value[begin:stop])
                near = z @ queries
                own = near * (norm[rows, None] / q_norm)
                for r, q in np.argwhere((near >= cosine) | (own >= OWN_SHARE)).tolist():
                    p, item = at + r, q_text[q]
                    size = len(item_words[item])
                    back = int(q_first[q] - offsets[item])
                    lo = max(int(first[p]) - back - size // 2, int(doc_offsets[text[p]]))
                    hi = min(int(last[p]) + size + size // 2, int(doc_offsets[text[p] + 1]))
                    for share, held, word in _regions(item_words[item], doc_words[lo:hi]):
                        if share >= lcs_share or (share >= paraphrase_share and held >= answer_share):
                            key = (int(text[p]), int(item))
                            new = (share, float(near[r, q]), held, -(lo + word - int(doc_offsets[text[p]])))
                            out[key] = max(out.get(key, new), new)
            for t, item in rest.pairs(all_terms.find(doc_words), doc_offsets):
                if (t, item) in out:
                    continue
                own = doc_words[doc_offsets[t]:doc_offsets[t + 1]]
                leak = rest.best(item, item_words[item], own)
                if leak:
                    share, held, word = leak
                    region = own[word:word + len(item_words[item]) + len(item_words[item]) // 2]
                    *_, start, _, term, value = space.passages(table, region, np.array([0, len(region)]))
                    near = _times(basis, start, term, value) @ queries[:, q_text == item]
                    out[t, item] = (share, float(near.max(initial=0.0)), held, -word)
            if out:
                keys = list(out)
                best = [out[k] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array([k[0] for k in keys])), pa.array([ids[k[1]] for k in keys], pa.int64()),
                     pa.array([b[1] for b in best]), pa.array([b[0] for b in best]), pa.array([b[2] for b in best]),
                     pa.array([-b[3] for b in best], pa.int64())],
                    names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"])

    return docs.mapInArrow(run, schema)


def _regions(item: np.ndarray, words: np.ndarray) -> Iterator[tuple[float, float, int]]:
    """Shares of the item and of its answer in regions of one and a half times its length, every half
    length apart, that hold enough of its words in any order to matter."""
    size = len(item)
    width, step = size + size // 2, max(1, size // 2)
    hit = np.concatenate([[0], np.cumsum(np.isin(words, item))])
    for a in range(0, max(1, len(words) - width + step), step):
        b = min(a + width, len(words))
        if 2 * (hit[b] - hit[a]) >= size:
            yield (*_shares(item, words[a:b]), a)
