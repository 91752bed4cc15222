"""What tasks of the substring dedup hold, and its helpers against plain loops."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ridelens.llm import substring


def batch(texts, first=0):
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts)), pa.int64()), pa.array(texts),
                                       pa.array([0] * len(texts), pa.int32())], names=["doc_id", "text", "text_key"])


def test_a_task_holds_few_bytes_for_each_occurrence(monkeypatch):
    """Beside its current piece a task keeps what it has settled so far: 24 bytes each, no Python objects."""
    monkeypatch.setattr(substring, "PART", 1 << 16)
    batches = [batch([" ".join(f"{b}x{d}x{i}" for i in range(2000)) for d in range(4)], 4 * b) for b in range(50)]
    run = substring._occurrences(20, 8)
    rows = sum(out.num_rows for out in run(iter(batches[:2])))  # the tables of powers are made once
    tracemalloc.start()
    try:
        found = run(iter(batches))
        held, rows = [], 0
        for out in found:
            rows += out.num_rows
            del out
            held.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert rows > 50_000
    assert (held[-1] - held[4]) / rows < 60


@pytest.mark.parametrize("limit", [1 << 20, 50])
def test_only_later_occurrences_are_settled(monkeypatch, limit):
    """Each occurrence that is settled comes after one of its group that is not; equal ones are not settled by each other."""
    monkeypatch.setattr(substring._Settled, "LIMIT", limit)
    rng = np.random.default_rng(3)
    settled, sent, lost = substring._Settled(), {}, []
    for _ in range(20):
        g, d, s = rng.integers(0, 90, 60).astype(np.uint64), rng.integers(0, 9, 60), rng.integers(0, 4, 60)
        known = settled.later(g, d, s)
        for k, row in zip(known, zip(g.tolist(), d.tolist(), s.tolist())):
            if k:
                lost.append(row)
            else:
                sent[row[0]] = min(sent.get(row[0], row[1:]), row[1:])
    assert len(lost) > 300 and all(sent[g] < (d, s) for g, d, s in lost)


def test_maximal_repeats():
    rng = np.random.default_rng(5)
    lists = [[{"start": int(s), "windows": int(n)} for s, n in zip(rng.integers(0, 400, k), rng.integers(1, 9, k))] for k in (7, 0, 1, 30, 3)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("windows", pa.int64())]))
    b = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array([0] * 5, pa.int32()), pa.array(lists, kind)], names=["doc_id", "text_key", "found"])
    for part in (b, b.slice(2, 2), b.slice(1, 1)):
        (out,) = substring._maximal(20)(iter([part]))
        for found, spans in zip(part.column("found").to_pylist(), out.column("spans").to_pylist()):
            words = sorted({w for f in found for w in range(f["start"], f["start"] + f["windows"] + 19)})
            assert [w for s in spans for w in range(s["first"], s["last"] + 1)] == words
            assert all(x["last"] + 1 < y["first"] for x, y in zip(spans, spans[1:]))
