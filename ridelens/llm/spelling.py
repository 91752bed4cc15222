"""Spelling variants by asymmetric q-chunks.

Two words one edit apart: the longer one (either, if equally long) is cut at both ends into two disjoint chunks
of half its length; the other gives its positional grams of that length.  One edit touches one chunk
at most and moves the other by at most one place, so chunks and grams are joined within a shift of
one, and each pair is verified.  Grams that no chunk can meet within that shift are left out before the join.

A chunk that more than ``CROWD`` words share on either side would pair all of them; words of such chunks
are joined on what is left after one deletion instead, where a group has at most one word per
letter and place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.words import LOWER, PIECE, _cut, pieces, text_buffer
from ridelens.session import cut_lineage

MIN_LETTERS = 6
MIN_COUNT = 5
TIMES = 5
DROP_EVERY = 199
CROWD = 64
LONG_RUN = 64

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
#: Bytes at which a text may be cut: ASCII signs other than letters.
_GAP = ~_ASCII_LETTER
_GAP[0x80:] = False

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def _runs(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of A-Z, a-z and U+00C0 to U+00FF; ``breaks`` are where texts start."""
    inside = np.zeros(len(data) + 2, bool)
    lead = data == 0xC3  # U+00C0 to U+00FF: 0xC3 and one more byte
    body = inside[1:-1]
    body |= _ASCII_LETTER[data] | lead
    body[1:] |= lead[:-1]
    first, last = body & ~inside[:-2], body & ~inside[2:]
    first[breaks] = body[breaks]
    before = breaks[breaks > 0] - 1
    last[before] = body[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, carried on from the (finished) CRC-32 in ``state``."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size, crc = starts[order], size[order], ~state[order]
    long_runs = int(np.searchsorted(-size, -LONG_RUN))
    for j in range(int(size[long_runs]) if long_runs < len(size) else 0):
        m = int(np.searchsorted(-size, -j))  # runs of more than j bytes
        crc[:m] = _CRC[(crc[:m] ^ data[at[:m] + j]) & 0xFF] ^ (crc[:m] >> 8)
    crc = ~crc
    for i in range(long_runs):
        crc[i] = zlib.crc32(data[at[i]:at[i] + size[i]].tobytes(), int(state[order[i]]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _count_words(b: pa.RecordBatch, min_letters: int, drop_every: int) -> pa.Table:
    """``word, n`` of a batch of ``doc_id, text``."""
    whole, offsets = text_buffer(b.column("text"))
    heads = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in b.column("doc_id").to_pylist()], np.uint32)
    found, at = [], 0
    while at < len(whole):
        end = min(at + PIECE, len(whole))
        if end < len(whole):
            end = _cut(whole, offsets, at, end, _GAP)
        lo, hi = np.searchsorted(offsets, [at, end])
        data = LOWER[whole[at:end]]
        starts, ends = _runs(data, offsets[lo:hi] - at)
        letters = ends - starts - np.diff(np.append(0, np.cumsum(data == 0xC3))[np.stack([starts, ends], 1)], axis=1)[:, 0]
        keep = letters >= min_letters
        starts, ends, letters = starts[keep], ends[keep], letters[keep]
        if len(starts):
            h = _hashes(data, starts, ends, heads[np.searchsorted(offsets, starts + at, "right") - 1])
            hit = h % np.uint32(drop_every) == 0
            bounds = np.empty(2 * len(starts), np.int64)
            bounds[::2], bounds[1::2] = starts, ends
            runs = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
            plain = runs.take(pa.array(2 * np.flatnonzero(~hit)))
            changed = []
            for i in np.flatnonzero(hit):
                word, place = data[starts[i]:ends[i]].tobytes().decode(), int(h[i]) % int(letters[i])
                if letters[i] > min_letters:
                    changed.append(word[:place] + word[place + 1:])
            found.append(pa.concat_arrays([plain, pa.array(changed, pa.large_string())]))
        at = end
    counts = pc.value_counts(pa.chunked_array(found, pa.large_string()))
    return pa.table({"word": counts.field("values"), "n": counts.field("counts")})


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY,
               held: int = 400_000) -> DataFrame:
    """``word, n``: distinct words of at least ``min_letters`` code points with at least ``min_count`` occurrences; checkpointed.

    A run loses one code point where the CRC-32 of ``<doc_id>:<run>`` is a multiple of ``drop_every``.  Tasks add
    counts up and pass them on whenever they hold ``held`` distinct words.
    """
    def run(batches):
        tables, rows = [], 0
        for b in pieces(batches):
            tables.append(_count_words(b, min_letters, drop_every))
            rows += tables[-1].num_rows
            if rows > 2 * held:
                tables = [_summed(tables)]
                rows = tables[0].num_rows
                if rows > held:
                    yield from tables.pop().cast(kind).to_batches(max_chunksize=50_000)
                    rows = 0
        if tables:
            yield from _summed(tables).cast(kind).to_batches(max_chunksize=50_000)

    kind = pa.schema([("word", pa.string()), ("n", pa.int64())])
    counts = docs.select(F.col("doc_id"), "text").mapInArrow(run, "word string, n long")
    return cut_lineage(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _gram(word: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` (from 0)."""
    return F.substring(word, start + 1, size)


def chunks(words: DataFrame) -> DataFrame:
    """``key, word, n``: the two chunks of each word, one row each; the key holds chunk, word length and which one it is."""
    size = F.char_length("word")
    q = F.floor(size / 2).cast("int")
    pair = F.array(F.xxhash64(size, F.lit(0), _gram(F.col("word"), F.lit(0), q)), F.xxhash64(size, F.lit(1), _gram(F.col("word"), size - q, q)))
    return words.select(F.explode(pair).alias("key"), "word", "n")


def grams(words: DataFrame) -> DataFrame:
    """``key, word, n``: positional grams of each word for chunks of words as long, and one longer, within a shift of one."""
    size = F.char_length("word")
    places = []
    for more in (0, 1):
        target = size + more
        q = F.floor(target / 2).cast("int")
        for which, chunk_at in ((0, F.lit(0)), (1, target - q)):
            for shift in (-1, 0, 1):
                start = chunk_at + shift
                places.append(F.when((start >= 0) & (start + q <= size), F.xxhash64(target, F.lit(which), _gram(F.col("word"), start, q))))
    return words.select(F.explode(F.array_distinct(F.array_compact(F.array(*places)))).alias("key"), "word", "n")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, a_n, b, b_n``: each unordered pair of words one insertion, deletion or replacement apart, once; checkpointed."""
    left = cut_lineage(chunks(words).select("key", F.col("word").alias("a"), F.col("n").alias("a_n")))
    right = cut_lineage(grams(words).select("key", F.col("word").alias("b"), F.col("n").alias("b_n")))
    crowded = cut_lineage(left.groupBy("key").count().where(F.col("count") > crowd).select("key").join(
        right.groupBy("key").count().where(F.col("count") > crowd).select("key"), "key"))
    # at most `crowd` rows of one side meet a row of the other
    some = left.join(crowded, "key", "left_anti").join(right.join(crowded, "key", "left_anti"), "key")
    same = F.char_length("a") == F.char_length("b")
    some = some.where((~same | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).drop("key")
    pairs = some.unionByName(_crowded_pairs(left.join(crowded, "key", "left_semi"), right.join(crowded, "key", "left_semi")))
    return cut_lineage(pairs.distinct())


def _crowded_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs among words of crowded chunks, by what a deletion leaves: as many rows as the words have letters."""
    def shortened(rows, word):
        at = F.posexplode(F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(
            F.substring(F.col(word), F.lit(1), i - 1), F.substring(F.col(word), i + 1, F.char_length(word)))))
        return rows.select("*", at.alias("at", "rest"))

    left, right = left.select("a", "a_n").distinct(), right.select("b", "b_n").distinct()
    cut = shortened(left, "a")
    replaced = cut.join(shortened(right, "b"), ["at", "rest"]).where(F.col("a") < F.col("b")).select("a", "a_n", "b", "b_n")
    removed = cut.join(right, F.col("rest") == F.col("b")).select("a", "a_n", "b", "b_n")
    return replaced.unionByName(removed)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: the end of each chain of forms, by doubling steps."""
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = cut_lineage(state.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").alias("moved")))
        if state.where("moved is not null").limit(1).count() == 0:
            return state.select("word", "root")


def spelling_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY,
                      times: int = TIMES) -> DataFrame:
    """Groups spellings of the words of ``docs`` (``doc_id, text``): ``word, form, root, n, n_near, form_n``, one row per word.

    A word's ``form`` is its near word of largest count (ties: smallest in code-point order) if that is at least
    ``times`` the word's own, else null; ``root`` is the end of the chain of forms, the word itself without one.  A chain
    ends as counts grow with each step.  A null text has no words, a null doc_id reads as an empty string,
    repeated rows count each.  Runs are never cut, however long.  An empty table gives no row.  Other columns
    are ignored.
    """
    words = vocabulary(docs, min_letters, min_count, drop_every)
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    enough = -F.col("best.minus") >= times * F.col("n")
    known = cut_lineage(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                     F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")))
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
