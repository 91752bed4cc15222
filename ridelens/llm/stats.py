"""Document statistics for the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ridelens.llm.words import SPACE, powers, text_buffer, word_hashes

NAMES = (
    "log_words", "log_chars", "letter_share", "upper_share", "digit_share", "space_share", "newline_share",
    "punct_share", "symbol_share", "mark_share", "other_share", "mean_word", "sd_word", "long_word_share",
    "short_word_share", "distinct_word_share", "top_word_share", "repeat_run_share", "repeat_five_share", "mean_line",
    "sd_line", "short_line_share", "repeat_line_share", "double_symbol_share", "sentence_ends", "bar_words",
)

# Byte classes of the statistics.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[list(range(97, 123))] = 0
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[SPACE] = 3
_CLASS[list(b".,;:'\"()-?")] = 4
_CLASS[list(b"#$%&*+<=>@[\\]^_`{|}~/!")] = 5
_CLASS[list(range(128, 256))] = 7
_CLASS[10] = 8
_CLASS[list(range(128, 192))] = 9  # second and later bytes of a character


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: number of distinct keys and the count of the most frequent one."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(k)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, o[at], counts)
    return np.bincount(o[at], minlength=n), top


def document_stats(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text, over the whole text; an empty or null text gives zeros."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    counts = np.bincount(owner * 10 + kind, minlength=10 * n).reshape(n, 10).astype(float)
    chars = size - counts[:, 9]
    out = np.zeros((n, len(NAMES)))
    col = {name: i for i, name in enumerate(NAMES)}

    def put(name, values):
        out[:, col[name]] = values

    put("log_chars", np.log1p(chars))
    letters = counts[:, 0] + counts[:, 1] + counts[:, 7]
    put("letter_share", _share(letters, chars))
    put("upper_share", _share(counts[:, 1], letters))
    put("digit_share", _share(counts[:, 2], chars))
    put("space_share", _share(counts[:, 3], chars))
    put("newline_share", _share(counts[:, 8], chars))
    put("punct_share", _share(counts[:, 4], chars))
    put("symbol_share", _share(counts[:, 5], chars))
    put("other_share", _share(counts[:, 6], chars))
    put("mark_share", _share(np.bincount(owner, weights=data == 33, minlength=n), chars))
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (kind[1:] == 5) & (owner[1:] == owner[:-1])
    put("double_symbol_share", _share(np.bincount(owner, weights=same, minlength=n), chars))

    hashes, starts = word_hashes(column, lower=True)
    words = np.diff(starts)
    word_owner = np.repeat(np.arange(n), words)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    length = np.add.reduceat(np.append(inside & (kind != 9), False).astype(np.int64), at) if len(at) else np.zeros(0)
    put("log_words", np.log1p(words))
    mean = _share(np.bincount(word_owner, weights=length, minlength=n), words)
    put("mean_word", mean)
    put("sd_word", np.sqrt(np.maximum(
        _share(np.bincount(word_owner, weights=length ** 2, minlength=n), words) - mean ** 2, 0)))
    put("long_word_share", _share(np.bincount(word_owner, weights=length > 14, minlength=n), words))
    put("short_word_share", _share(np.bincount(word_owner, weights=length < 4, minlength=n), words))
    distinct, top = _repeats(hashes, word_owner, n)
    put("distinct_word_share", _share(distinct, words))
    put("top_word_share", _share(top, words))
    run = np.zeros(len(hashes), bool)
    run[1:] = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
    put("repeat_run_share", _share(np.bincount(word_owner, weights=run, minlength=n), words))
    if len(hashes) > 4:
        five = hashes[:-4] * np.uint64(3) + hashes[1:-3] * np.uint64(5) + hashes[2:-2] * np.uint64(7) \
            + hashes[3:-1] * np.uint64(11) + hashes[4:] * np.uint64(13)
        keep = word_owner[:-4] == word_owner[4:]
        kinds, _ = _repeats(five[keep], word_owner[:-4][keep], n)
        total = np.bincount(word_owner[:-4][keep], minlength=n)
        put("repeat_five_share", 1 - kinds / np.maximum(total, 1) - (total == 0))
    if len(at):
        put("bar_words", _share(np.bincount(word_owner, weights=data[at] == 124, minlength=n), words))
    put("sentence_ends", _share(np.bincount(owner, weights=(data == 46) | (data == 63), minlength=n), words))

    line_first = np.zeros(len(data), bool)
    if len(data):
        line_first[1:] = (data[:-1] == 10) | (owner[1:] != owner[:-1])
        line_first[0] = True
    la = np.flatnonzero(line_first)
    line_owner = owner[la]
    line_len = np.diff(np.append(la, len(data))).astype(float)
    lines = np.bincount(line_owner, minlength=n)
    mean = _share(np.bincount(line_owner, weights=line_len, minlength=n), lines)
    put("mean_line", np.log1p(mean))
    put("sd_line", np.log1p(np.sqrt(np.maximum(
        _share(np.bincount(line_owner, weights=line_len ** 2, minlength=n), lines) - mean ** 2, 0))))
    put("short_line_share", _share(np.bincount(line_owner, weights=line_len < 30, minlength=n), lines))
    weight = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weight ^= weight >> np.uint64(29)
    if len(la):
        key = np.zeros(len(la), np.uint64)
        step = powers(np.uint64(0x9E3779B97F4A7C15), 1 << 16)
        place = (np.arange(len(data)) - np.repeat(la, line_len.astype(np.int64))) & 0xFFFF
        key = np.add.reduceat(weight * step[place], la)
        kinds, _ = _repeats(key, line_owner, n)
        put("repeat_line_share", _share(lines - kinds, lines))
    return out
