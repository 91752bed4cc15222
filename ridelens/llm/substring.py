"""Substring dedup by seed and extend: remove words of passages that already occur earlier.

Every window of ``length`` words has one anchor: the seed of ``seed`` words with the smallest hash in
it (winnowing), so equal windows have equal anchors at equal places.  An anchor's occurrence
carries the windows around it that it stands for, from the furthest extension to the left to the furthest
to the right.  Occurrences meet by anchor; there, in document order, each extension that an
earlier occurrence has too is a repeat.  Neighbouring repeats add up to maximal ones.

Occurrences that repeat as a whole within one task are settled there, so a passage in very
many documents sends one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.graph import may_contain, membership
from ridelens.llm.words import inside_text, mix, pieces, runs, word_hashes
from ridelens.session import cut_lineage

WIN_BYTES = 5
PART = 2 << 20
NULL_ID = np.iinfo(np.int64).max  # a null doc_id sorts after all others

_SPAN = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int32()), ("start", pa.int64()),
                   ("windows", pa.int32()), ("hashes", pa.binary())])
_SPAN_DDL = "anchor long, doc_id long, text_key int, start long, windows int, hashes binary"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(x) - width + 1], out[width - have:width - have + len(x) - width + 1])


def anchored_windows(words: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """``(start, count, anchor, hash)``: runs of windows with one anchor (positions over all words),
    and the hash of every window of these runs in order."""
    valid = np.flatnonzero(inside_text(offsets, length)) if len(words) >= length else np.zeros(0, np.int64)
    if not len(valid):
        return valid, valid, words[:0], words[:0]
    seeds = runs(words, seed)
    width = length - seed + 1
    least = _sliding_min(seeds, width)[valid]
    place = np.zeros(len(valid), np.int64)
    for j in range(width - 1, -1, -1):
        hit = seeds[valid + j] == least
        place[hit] = valid[hit] + j
    new = np.ones(len(valid), bool)
    new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)
    at = np.flatnonzero(new)
    return valid[at], np.diff(np.append(at, len(valid))), least[at], runs(words, length)[valid]


class _Settled:
    """The first occurrence ``(doc, start)`` of each group of equal windows that a task has met, as sorted arrays (24 bytes each)."""

    LIMIT = 1 << 20

    def __init__(self):
        self.group, self.doc, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, group: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of these occurrences come after another of their group, here or met before; takes them in."""
        order = np.lexsort((at, doc, group))
        g, d, s = group[order], doc[order], at[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        keys, first_doc, first_at = g[new], d[new], s[new]
        place = np.searchsorted(self.group, keys)
        have = place < len(self.group)
        have[have] = self.group[place[have]] == keys[have]
        met = place[have]
        old_doc, old_at = self.doc[met], self.at[met]
        before = (old_doc < first_doc[have]) | ((old_doc == first_doc[have]) & (old_at < first_at[have]))
        first_doc[have] = np.where(before, old_doc, first_doc[have])
        first_at[have] = np.where(before, old_at, first_at[have])
        self.doc[met], self.at[met] = first_doc[have], first_at[have]
        out = np.zeros(len(g), bool)
        nth = np.cumsum(new) - 1
        out[order] = (d != first_doc[nth]) | (s != first_at[nth])
        if len(self.group) > self.LIMIT:  # bounded memory: whatever is not settled here is settled by its anchor
            self.__init__()
            place = np.zeros(len(keys), np.int64)
            have[:] = False
        self.group, self.doc, self.at = (np.insert(x, place[~have], y[~have]) for x, y in (
            (self.group, keys), (self.doc, first_doc), (self.at, first_at)))
        return out


def _occurrences(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]):
        settled = _Settled()
        for part in pieces(batches, size=PART):
            words, offsets = word_hashes(part.column("text"))
            start, count, anchor, hashes = anchored_windows(words, offsets, length, seed)
            if not len(start):
                continue
            row = np.searchsorted(offsets, start, "right") - 1
            doc = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            key = part.column("text_key").to_numpy()[row]
            at = start - offsets[row]
            first = np.cumsum(count) - count
            group = mix(np.add.reduceat(hashes * np.uint64(0x9E3779B97F4A7C15), first) + anchor * np.uint64(3) + count.astype(np.uint64))
            known = settled.later(group, doc, at)
            # what is settled needs no meeting, so it is spread over all partitions
            anchor = np.where(known, mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)), anchor)
            short = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :WIN_BYTES]
            sent = np.repeat(~known, count)
            data = np.ascontiguousarray(short[sent]).ravel()
            sizes = np.where(known, 0, count * WIN_BYTES)
            offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            spans = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(doc), pa.array(key.astype(np.int32)), pa.array(at.astype(np.int64)),
                 pa.array(count.astype(np.int32)), spans], schema=_SPAN)
    return run


def _repeats(batches: Iterator[pa.RecordBatch]):
    """Repeated windows from occurrences sorted by (anchor, doc_id, start).  Between batches only the
    windows of the last anchor are kept."""
    last, kept = None, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for b in batches:
        anchor, doc, key, start, count = (b.column(c).to_numpy() for c in ("anchor", "doc_id", "text_key", "start", "windows"))
        blob = b.column("hashes").combine_chunks() if isinstance(b.column("hashes"), pa.ChunkedArray) else b.column("hashes")
        big = blob.cast(pa.large_binary())
        offs = np.frombuffer(big.buffers()[1], np.int64)[big.offset:big.offset + len(big) + 1]
        data = np.frombuffer(big.buffers()[2], np.uint8)[offs[0]:offs[-1]].reshape(-1, WIN_BYTES)
        sent = np.diff(offs) // WIN_BYTES
        whole = sent == 0  # settled by its task
        if whole.any():
            yield _ranges(doc[whole], key[whole], start[whole], count[whole])
        row = np.repeat(np.arange(len(anchor)), sent)
        if not len(row):
            continue
        wide = np.zeros((len(data), 8), np.uint8)
        wide[:, :WIN_BYTES] = data
        window = mix(wide.view(np.uint64).ravel() ^ (anchor[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        where = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(sent) - sent, sent)
        owner = doc[row]
        carried = len(kept[0]) if last is not None and last == anchor[row[0]] else 0
        if carried:
            window, where, owner = (np.concatenate([k, x]) for k, x in zip(kept, (window, where, owner)))
        order = np.argsort(window, kind="stable")
        sorted_window = window[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_window[1:] != sorted_window[:-1]
        first = np.empty(len(order), np.int64)
        first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        repeat = (owner[first] != owner) | (where[first] != where)
        final = anchor[row[-1]]
        tail = np.concatenate([np.full(carried, final == last), anchor[row] == final]) if carried else anchor[row] == final
        tail &= first == np.arange(len(first))
        last, kept = final, (window[tail], where[tail], owner[tail])
        hit = np.flatnonzero(repeat[carried:])
        if len(hit):
            r, w = row[hit], where[carried:][hit]
            new = np.ones(len(hit), bool)
            new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)
            at = np.flatnonzero(new)
            yield _ranges(doc[r[at]], key[r[at]], w[at], np.diff(np.append(at, len(hit))))


def _ranges(doc, key, start, windows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": doc, "text_key": key.astype(np.int32), "start": start,
                                       "windows": windows.astype(np.int64)})


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"),
                       F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int").alias("text_key"))


def repeated_passages(docs: DataFrame, length: int = 20, seed: int = 8) -> DataFrame:
    """``doc_id, text_key, spans``: per document with repeats its maximal repeats ``(first, last)`` in words,
    each a union of windows of ``length`` words that start earlier too (in a document of smaller
    id, or earlier in the same one).  ``text_key`` tells rows with equal id apart."""
    found = (_keyed(docs).mapInArrow(_occurrences(length, seed), _SPAN_DDL)
             .repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
             .mapInArrow(_repeats, "doc_id long, text_key int, start long, windows long"))
    lists = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    return cut_lineage(lists.mapInArrow(_maximal(length), "doc_id long, text_key int, spans array<struct<first:long,last:long>>"))


def _maximal(length: int):
    def run(batches):
        for b in batches:
            found = b.column("found")
            rows = found.flatten()
            sizes = np.diff(found.offsets.to_numpy())
            owner = np.repeat(np.arange(len(found)), sizes)
            start, windows = (rows.field(c).to_numpy() for c in ("start", "windows"))
            order = np.lexsort((start, owner))
            first, last = start[order], (start + windows + length - 2)[order]
            # each document's words behind those of the documents before it, so that one running maximum serves all
            base = owner * (int(last.max(initial=0)) + 3)
            reach = np.maximum.accumulate(last + base)
            new = np.ones(len(order), bool)
            new[1:] = (first + base)[1:] > reach[:-1] + 1
            at = np.flatnonzero(new)
            end = np.append(at, len(order))[1:] - 1
            spans = pa.StructArray.from_arrays([pa.array(first[at]), pa.array(reach[end] - base[end])], ["first", "last"])
            offsets = np.searchsorted(owner[at], np.arange(len(found) + 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
                                             names=["doc_id", "text_key", "spans"])
    return run


def _touched(bits, wanted: bool):
    def run(batches):
        for b in batches:
            hit = may_contain(bits.value, b.column("doc_id").to_numpy()) == wanted
            if hit.any():
                yield b.filter(pa.array(hit))
    return run


def _cut(batches: Iterator[pa.RecordBatch]):
    for part in pieces(batches, size=PART):
        kept, n_words, n_removed = [], [], []
        spans = part.column("spans").to_pylist() if "spans" in part.schema.names else [None] * part.num_rows
        for text, cuts in zip(part.column("text"), spans):
            words = text.as_buffer().to_pybytes().split()
            n = len(words)
            for c in reversed(cuts or []):
                del words[c["first"]:c["last"] + 1]
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.large_string()).cast(pa.string()),
             pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def _untouched(bits):
    """The documents without repeats, cut in the same step: one Python worker a task holds them, not two."""
    def run(batches):
        return _cut(_touched(bits, False)(batches))
    return run


def substring_dedup(docs: DataFrame, length: int = 20, seed: int = 8) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256``, one row per row of ``docs``
    (``doc_id, text``).

    Each word covered by a repeated window (see ``repeated_passages``) is removed; windows are judged
    on the input.  Words are runs of other bytes than white space, unchanged; kept words are joined by
    one space.  Null and empty texts have no words.  A null doc_id sorts after all others.  Rows
    equal in id and text have equal results and don't remove each other's words (no start is
    earlier); other columns are ignored; an empty table gives an empty result.  Seeds and windows
    are compared by hash (64 and 40 bits together).
    """
    spans = repeated_passages(docs, length, seed)
    keyed = _keyed(docs)
    bits = membership(spans, F.col("doc_id"))
    ddl = "doc_id long, text string, text_key int"
    out = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    rest = keyed.mapInArrow(_untouched(bits), out)
    some = keyed.mapInArrow(_touched(bits, True), ddl).join(spans, ["doc_id", "text_key"], "left").select(
        "doc_id", "text", "spans").mapInArrow(_cut, out)
    return rest.unionByName(some).withColumn("doc_id", F.nullif("doc_id", F.lit(int(NULL_ID))))
