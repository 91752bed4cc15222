"""License scans: exact set-similarity join of text blocks with license templates.

A template's distinct words are ordered by how often they occur in all documents, rarest first.  A
block that holds at least the share ``threshold`` of them holds one of the first
``size - need + 1`` (prefix filter; with that its first matching word at rank ``i`` leaves room for the
``need`` matches, the positional filter) and has at least ``need`` of them (length filter).  So only
blocks with a prefix word are counted; one starts at every template word, and every block that
meets the threshold is found.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.words import LOWER, hash_words, pieces, word_hashes

PART = 2 << 20

# Separators are all ASCII bytes but letters and digits; A-Z is lower-cased.
NORMAL = LOWER.copy()
for _b in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]:
    NORMAL[_b] = 0x20

# Base phrases with their labels, as the contract names them.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Short license notices and openings of license texts with their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http www apache org licenses LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "All rights reserved"),
)


def _words(text: str) -> list[str]:
    return text.encode().translate(NORMAL.tobytes()).decode().split()


def word_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word hash of ``vocabulary`` (bounded: the templates' words) occurs in all texts."""
    vocabulary = np.sort(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(len(vocabulary), np.int64)
        for part in pieces(batches, size=PART):
            h, _ = word_hashes(part.column("text"), table=NORMAL)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(vocabulary)), "n": total})

    got = docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    n = dict.fromkeys(range(len(vocabulary)), 0) | {r.i: r.n for r in got}
    return {int(vocabulary[i]): int(c) for i, c in n.items()}


class _Template:
    def __init__(self, label: str, text: str, threshold: float, frequency: Mapping[int, int]):
        h = sorted(set(hash_words(_words(text)).tolist()), key=lambda w: (frequency.get(w, 0), w))
        self.label, self.size = label, len(h)
        self.need = max(1, int(np.ceil(threshold * self.size - 1e-9)))
        self.ranked = np.array(h, np.uint64)
        self.prefix = self.ranked[:self.size - self.need + 1]
        self.block = 2 * len(_words(text))


def _find_blocks(template: _Template, at: np.ndarray, rank: np.ndarray, owner: np.ndarray, offsets: np.ndarray):
    """``(text, first word, matches)`` of each block that holds enough of the template's words.

    ``at`` are the positions of the template's words, ``rank`` their ranks.  A block of ``block`` words (shorter at
    its text's end) starts at each of these positions, so no passage is lost by its place.
    """
    first = np.flatnonzero(rank < len(template.prefix))
    stop = np.minimum(at + template.block, offsets[owner + 1])
    end = np.searchsorted(at, stop)
    # prefix filter: a prefix word in the block; length filter: enough hits in it
    ahead = np.searchsorted(first, np.arange(len(at)))
    near = np.append(first, len(at))[ahead] < end
    starts = np.flatnonzero(near & (end - np.arange(len(at)) >= template.need))
    count, distinct, lo, hi = np.zeros(template.size, np.int64), 0, 0, 0
    for k in starts.tolist():
        if k >= hi:  # nothing is shared with the block before
            count[:], distinct, lo, hi = 0, 0, k, k
        while hi < end[k]:
            distinct += count[rank[hi]] == 0
            count[rank[hi]] += 1
            hi += 1
        while lo < k:
            count[rank[lo]] -= 1
            distinct -= count[rank[lo]] == 0
            lo += 1
        if distinct >= template.need:
            yield int(owner[k]), int(at[k] - offsets[owner[k]]), int(distinct)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks`` for every row
    of ``docs`` (``doc_id, text``).

    Base places are where the words of a phrase of ``PHRASES`` stand consecutively.  ``blocks`` lists
    every block (label, first word, containment) that holds at least ``threshold`` of a template's
    distinct words; a template's blocks are twice its length and start at each of its words in the
    text.  ``labels`` joins base labels and blocks' labels; ``score`` is the largest containment, 1
    with a base place, 0 without any.  Null and empty texts have no words and no labels; a null id
    stays null; repeated rows give equal rows; other columns are ignored; an empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = np.unique(hash_words(sorted({w for _, t in templates for w in _words(t)})))
    frequency = word_frequencies(docs, vocabulary)
    made = [_Template(label, text, threshold, frequency) for label, text in templates]
    phrases = [(hash_words(p.split()), label) for p, label in PHRASES]
    block = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
              "score double, blocks array<struct<label:string,first_word:long,containment:double>>")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for part in pieces(batches, size=PART):
            n = part.num_rows
            h, offsets = word_hashes(part.column("text"), table=NORMAL)
            base = [set() for _ in range(n)]
            found: list[list] = [[] for _ in range(n)]
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            at = np.flatnonzero(vocabulary[at] == h)  # positions of template words; the phrases' words are among them
            for words, label in phrases:
                start = np.flatnonzero(h == words[0])
                start = start[start + len(words) <= len(h)]
                for j in range(1, len(words)):
                    start = start[h[start + j] == words[j]]
                if not len(start):
                    continue
                text = np.searchsorted(offsets, start, "right") - 1
                inside = start + len(words) <= offsets[text + 1]
                start, text = start[inside], text[inside]
                np.add.at(n_base, text, 1)
                np.minimum.at(first, text, start - offsets[text])
                np.maximum.at(last, text, start - offsets[text])
                for i in np.unique(text).tolist():
                    base[i].add(label)
            ha, owner = h[at], np.searchsorted(offsets, at, "right") - 1
            for t in made:
                order = np.argsort(t.ranked)
                place = np.minimum(np.searchsorted(t.ranked[order], ha), t.size - 1)
                hit = t.ranked[order][place] == ha
                rank = order[place[hit]]
                if (rank < len(t.prefix)).any():
                    for i, word, matches in _find_blocks(t, at[hit], rank, owner[hit], offsets):
                        found[i].append({"label": t.label, "first_word": word, "containment": matches / t.size})
            none = n_base == 0
            values = [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_base), pa.array(first, mask=none),
                      pa.array(last.astype(np.int64), mask=none), pa.array([",".join(sorted(b)) for b in base]),
                      pa.array([",".join(sorted(b | {f["label"] for f in fs})) for b, fs in zip(base, found)]),
                      pa.array([1.0 if b else max((f["containment"] for f in fs), default=0.0) for b, fs in zip(base, found)]),
                      pa.array(found, block)]
            yield pa.RecordBatch.from_arrays(values, names=names)

    return docs.mapInArrow(run, schema)
