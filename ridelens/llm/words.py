"""Vectorised word handling over Arrow text columns, used inside ``mapInArrow`` tasks.

Words are runs of bytes other than ``0x20`` and ``0x09-0x0D`` of the UTF-8 text.  Each word gets
a 64-bit hash from prefix sums of a polynomial over its bytes, so a whole Arrow batch is
handled without a Python step per word.  Long texts are cut into pieces at word ends: the
per-byte arrays never exceed a piece (or one longer word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

# The byte classes of the word pattern and of ASCII lower-casing.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_BYTES = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOWER = np.frombuffer(LOWER_BYTES, np.uint8)

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
SAME = np.arange(256, dtype=np.uint8)
_STEP = _U(0xD1342543DE82EF95)
_STEP_INV = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** [0, n)`` modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 8 * PIECE:
            return have[:n]
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column without copying; a null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _piece_words(data: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a piece; ``breaks`` are positions where a text starts."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[table][data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    if len(breaks):
        first[breaks] = inside[1:-1][breaks]
        before = breaks[breaks > 0] - 1
        last[before] = inside[1:-1][before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[table][data] * powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_BASE_INV, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(column: pa.Array, lower: bool = False, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word hashes of all texts in order, and where each text's words start (n + 1 offsets).

    ``table`` replaces each byte first (``0x20``: a separator); ``lower`` stands for ASCII lower-casing.
    """
    table = table if table is not None else LOWER if lower else SAME
    data, offsets = text_buffer(column)
    hashes, starts = [], []
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            end = _cut(data, offsets, at, end, SPACE[table])
        lo, hi = np.searchsorted(offsets, [at, end])
        h, s, _ = _piece_words(data[at:end], offsets[lo:hi] - at, table)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words as ``word_hashes`` gives them for texts."""
    return word_hashes(pa.array(words, pa.large_string()))[0]


def _cut(data: np.ndarray, offsets: np.ndarray, at: int, end: int, space: np.ndarray) -> int:
    """The last text start or space in ``(at, end]``, or else the first one after it."""
    k = np.searchsorted(offsets, end, "right") - 1
    best = offsets[k] if offsets[k] > at else 0
    spaces = np.flatnonzero(space[data[max(at, end - 4096):end]])
    if len(spaces):
        best = max(best, max(at, end - 4096) + int(spaces[-1]) + 1)
    if best > at:
        return int(best)
    while end < len(data):
        spaces = np.flatnonzero(space[data[end:end + PIECE]])
        stop = min(end + int(spaces[0]) + 1 if len(spaces) else min(end + PIECE, len(data)),
                   int(offsets[np.searchsorted(offsets, end)]))
        if len(spaces) or stop == offsets[np.searchsorted(offsets, end)]:
            return stop
        end = stop
    return len(data)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (``len - k + 1`` of them, across text bounds too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= _STEP
            out += hashes[j:n + j]
        return mix(out)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_STEP_INV, len(hashes)), out=sums[1:])
    return mix((sums[k:] - sums[:n]) * powers(_STEP, n))


def inside_text(offsets: np.ndarray, k: int) -> np.ndarray:
    """Mask over all runs of ``k`` words: true where the run lies within one text."""
    total = int(offsets[-1])
    ok = np.ones(max(total - k + 1, 0), bool)
    for j in range(1, k):
        cut = offsets[1:-1] - j
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``size`` text bytes each (one longer text stays whole)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Lookup:
    """Open-addressing hash table from 64-bit keys to a value array, built and read with numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.values = np.ascontiguousarray(keys).view(np.uint64), values
        left, at = np.arange(len(keys), dtype=np.int32), self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        at = self._home(keys)
        got = self.slots[at]
        hit = (got >= 0) & (self.keys[got] == keys)
        out[hit] = got[hit]
        left = np.flatnonzero((got >= 0) & ~hit)
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[left])
            out[left[hit]] = got[hit]
            on = (got >= 0) & ~hit
            left, at = left[on], at[on]
        return out


def count_keys(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sum of each weight array per key."""
    order = np.argsort(keys)
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(first)
    return (k[at], *(np.add.reduceat(w[order], at) if len(at) else w[:0] for w in weights))


def sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs; sorts ``keys`` in place."""
    keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.diff(np.append(at, len(keys)))
