"""Token-ID files: Parquet list columns with chosen encodings, row groups and page indexes.

``write_tokens`` deals the documents out by ranges of doc_id, tokenises each range in one pass and
lets Spark's Parquet writer commit the files, so a lost task or a second attempt leaves nothing
behind.  A row is ``doc_id, part, start, n_tokens, ids``: ``start`` counts the ids before it within its
part, and a table with one row per part holds how many ids lie before each part.  A reader that
wants metadata only never touches the pages of ``ids``; one that wants some documents skips row
groups and pages by the statistics of ``doc_id``, which ascends through each file.

A pre-token of a byte-level BPE never holds a space but as its first byte, so a text falls apart
at places where the bytes alone prove a pre-token's start (see ``_cuts``).  Equal chunks of a batch
are encoded once; the ids are those of the whole text.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.words import pieces, text_buffer
from ridelens.session import checkpoint_dir

END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 500
CHUNKS_PER_STEP = 1 << 20
CACHED_CHUNKS = 700_000
WORDS_PER_CALL = 4096
CACHED_BYTES = 64

_INK = np.zeros(256, bool)
_INK[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True

_tokenizers: dict[int, dict] = {}


def _tokenizer(spec: str, plain_special: bool) -> dict:
    """Tokenizer of this Python worker, the bytes that each id stands for, and the chunks it met before."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    key = hash((spec, plain_special))
    if key not in _tokenizers:
        made = Tokenizer.from_str(spec)
        made.encode_special_tokens = plain_special
        names = made.get_vocab(with_added_tokens=True)
        lengths = np.zeros(max(names.values(), default=0) + 1, np.int64)
        # the letters of a byte-level vocabulary stand for one byte each
        lengths[list(names.values())] = [len(w) for w in names]
        none = pa.array([], pa.large_binary())
        _tokenizers[key] = {"tok": made, "lengths": lengths, "words": none, "ids": none}
    return _tokenizers[key]


def _splittable(spec: str) -> bool:
    """Whether the cuts below hold: plain byte-level BPE with its usual pattern, and no prefix space."""
    import json
    said = json.loads(spec)
    pre = said.get("pre_tokenizer") or {}
    added = [t["content"] for t in said.get("added_tokens", [])]
    plain = all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in said.get("added_tokens", []))
    # an added token must hold no cut: neither white space nor a letter before another sign
    whole = all(not _cuts(np.frombuffer(b"x " + a.encode() + b" x", np.uint8))[3:-2].any() or a == "<|endoftext|>" for a in added)
    return (said.get("normalizer") is None and said.get("post_processor") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") is True and pre.get("add_prefix_space") is False and plain and whole)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Mask of bytes where a chunk may start: a space between two signs; a lone line end between two
    signs and what follows it; and an ASCII sign other than a letter, digit or bar after a letter."""
    cut = np.zeros(len(data), bool)
    if len(data) < 3:
        return cut
    left, here, right = data[:-2], data[1:-1], data[2:]
    latin = np.zeros(len(data), bool)
    latin[1:] = data[:-1] == 0xC3  # the second byte of U+00C0 to U+00FF
    before = _INK[left] | latin[:-2]
    after = _INK[right] | (right == 0xC3)
    cut[1:-1] = before & (here == 0x20) & after
    line = before & (here == 0x0A) & after
    cut[1:-1] |= line
    cut[2:] |= line
    sign = _INK & ~_LETTER
    sign[0x30:0x3A] = sign[0x7C] = False
    worded = _LETTER[data[:-1]] | (latin[:-1] & (data[:-1] != 0x97) & (data[:-1] != 0xB7))
    cut[1:] |= worded & sign[data[1:]]
    return cut


def _encode_words(tok, lengths: np.ndarray, words: list[bytes]) -> list[bytes]:
    """Ids of each chunk as bytes.  Chunks that start and end with a sign go to the library many at a time, in one text in
    which each is a chunk again; the bytes that each id stands for tell them apart."""
    out: list[bytes] = [b""] * len(words)
    joined, alone = [], []
    for k, w in enumerate(words):
        first, last = w[1 if w[0] == 0x20 and len(w) > 1 else 0], w[-1]
        (joined if (_INK[first] or first == 0xC3) and (_INK[last] or (len(w) > 1 and w[-2] == 0xC3)) else alone).append(k)
    for i in range(0, len(joined), WORDS_PER_CALL):
        step = joined[i:i + WORDS_PER_CALL]
        parts = [b"" if words[k][0] == 0x20 else b"\n" for k in step]
        parts[0] = b""
        ids = np.array(tok.encode_batch_fast([b"".join(x for k, p in zip(step, parts) for x in (p, words[k])).decode()],
                                             add_special_tokens=False)[0].ids, np.int32)
        gap = np.array([len(p) for p in parts])
        size = np.array([len(words[k]) for k in step])
        ends = np.cumsum(gap + size)
        at = np.append(0, np.cumsum(lengths[ids]))
        lo, hi = np.searchsorted(at, ends - size), np.searchsorted(at, ends)
        if not (at[lo] == ends - size).all() or not (at[hi] == ends).all():
            raise ValueError("the tokenizer's ids do not keep the chunks apart")
        whole = ids.tobytes()
        for k, x, y in zip(step, (4 * lo).tolist(), (4 * hi).tolist()):
            out[k] = whole[x:y]
    for i in range(0, len(alone), WORDS_PER_CALL):
        step = alone[i:i + WORDS_PER_CALL]
        for k, said in zip(step, tok.encode_batch_fast([words[k].decode() for k in step], add_special_tokens=False)):
            out[k] = np.array(said.ids, np.int32).tobytes()
    return out


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def encode_batch(column: pa.Array, spec: str, plain_special: bool = False, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order and where each text's ids start (n + 1 offsets)."""
    held = _tokenizer(spec, plain_special)
    data, offsets = text_buffer(column)
    if not split:
        made = [np.array(e.ids, np.int32) for t in column.fill_null("").to_pylist()
                for e in held["tok"].encode_batch_fast([t], add_special_tokens=False)]
        return np.concatenate([*made, np.zeros(0, np.int32)]), np.append(0, np.cumsum([len(m) for m in made])).astype(np.int64)
    starts = _cuts(data)
    starts[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(starts)
    bounds = np.append(at, len(data)).astype(np.int64)
    out, lengths = [], []
    for lo in range(0, len(at), CHUNKS_PER_STEP):
        part = bounds[lo:lo + CHUNKS_PER_STEP + 1]
        chunks = _binary(np.ascontiguousarray(data[part[0]:part[-1]]), part - part[0])
        if len(held["words"]) > CACHED_CHUNKS:
            held["words"], held["ids"] = held["words"][:0], held["ids"][:0]
        known = pc.index_in(chunks, value_set=held["words"])
        rest = chunks.filter(known.is_null())
        new = rest.unique()
        ids = pa.concat_arrays([held["ids"], pa.array(_encode_words(held["tok"], held["lengths"], new.to_pylist()), pa.large_binary())])
        place = np.array(known.fill_null(-1), np.int64)
        place[place < 0] = np.array(pc.index_in(rest, value_set=new), np.int64) + len(held["words"])
        taken = ids.take(pa.array(place))
        _, o, d = taken.buffers()
        o = np.frombuffer(o, np.int64)[taken.offset:taken.offset + len(taken) + 1]
        out.append(np.frombuffer(d, np.int32)[o[0] // 4:o[-1] // 4] if d is not None else np.zeros(0, np.int32))
        lengths.append(np.diff(o) // 4)
        keep = np.append(np.ones(len(held["words"]), bool), np.array(pc.less_equal(pc.binary_length(new), CACHED_BYTES)).astype(bool))
        held["words"] = pa.concat_arrays([held["words"], new]).filter(pa.array(keep))
        held["ids"] = ids.filter(pa.array(keep))
    ids = np.concatenate(out) if out else np.zeros(0, np.int32)
    ends = np.zeros(len(at) + 1, np.int64)
    if lengths:
        np.cumsum(np.concatenate(lengths), out=ends[1:])
    return ids, ends[np.searchsorted(at, offsets)]


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same with one end id after each text."""
    n = len(starts) - 1
    out = np.full(len(ids) + n, end_id, np.int32)
    moved = starts + np.arange(n + 1)
    inside = np.ones(len(out), bool)
    inside[moved[1:] - 1] = False
    out[inside] = ids
    return out, moved


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
                 page_rows: int = PAGE_ROWS, codec: str = "zstd", end_id: int = END_ID, plain_special: bool = False) -> None:
    """Writes ``folder/tokens`` (``doc_id, part, start, n_tokens, ids``) and ``folder/parts`` (``part, base, n_tokens, n_docs``).

    ``tokenizer`` is the path of a file of the tokenizers library, read by the driver.  ``encoding`` of
    ``ids`` is "dictionary" or "delta"; the other columns are delta-encoded.  A null text is empty and
    holds the end id alone; null ids come last, rows of equal id in the order of their texts' hashes;
    repeated rows are all written.  An empty table gives empty files.  Other columns are ignored.
    ``plain_special`` reads a special token's string as ordinary text.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding must be 'dictionary' or 'delta'")
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    split = _splittable(spec)
    shared = spark.sparkContext.broadcast(spec)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the last key only spreads repeated rows over several ranges
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("copy"))
    order = [F.col("doc_id").asc_nulls_last(), "key", "copy"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        at = 0
        for b in pieces(batches):
            ids, starts = with_end(*encode_batch(b.column("text"), shared.value, plain_special, split), end_id)
            counts = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array(starts[:-1] + at), pa.array(counts),
                 pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))], ["doc_id", "part", "start", "n_tokens", "ids"])
            at += int(starts[-1])

    out = dealt.mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids array<int>")
    writer = out.write.option("compression", codec).option("parquet.writer.version", "v2").option(
        "parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(PAGE_BYTES)).option(
        "parquet.page.row.count.limit", str(page_rows)).option("parquet.enable.dictionary", "false")
    if encoding == "dictionary":
        writer = writer.option("parquet.enable.dictionary#ids.list.element", "true")
    writer.parquet(f"{folder}/tokens")
    # one row per range of the write above, at most the number of shuffle partitions
    sums = spark.read.parquet(f"{folder}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")).collect()
    base, parts = 0, []
    for r in sorted(sums, key=lambda r: r["part"]):
        parts.append((r["part"], base, r["n_tokens"], r["n_docs"]))
        base += r["n_tokens"]
    spark.createDataFrame(parts, "part int, base long, n_tokens long, n_docs long").coalesce(1).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the written documents, those with ``first <= doc_id <= last`` alone where
    given.  Only the columns that are used further on are read, and a range only from the row groups and
    pages that can hold it."""
    tokens = spark.read.parquet(f"{folder}/tokens")
    if first is not None:
        tokens = tokens.where(F.col("doc_id") >= first)
    if last is not None:
        tokens = tokens.where(F.col("doc_id") <= last)
    parts = spark.read.parquet(f"{folder}/parts").select("part", "base")  # one row per range: bounded by the shuffle partitions
    return tokens.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows of ``read_tokens``, counted from the ids themselves."""
    def run(batches):
        for b in batches:
            lists = b.column("ids")
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            ids, off = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[lo:hi].tobytes()) for lo, hi in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(off).astype(np.int64)),
                                              pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, encoding: str = "dictionary") -> DataFrame:
    """Writes ``docs`` (``doc_id, text``) as token files and reads them back: ``doc_id, start, n_tokens, ids_crc32``, one row
    per document.  ``folder`` must be seen by all executors; by default it is a new one in the checkpoint folder."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer, encoding)
    return token_digests(read_tokens(spark, folder))
