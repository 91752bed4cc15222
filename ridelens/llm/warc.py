"""WARC archives: write, normalise to one gzip member per record with an offset index, read back.

Files go to a folder every executor sees (``pyarrow.fs`` resolves its URI).  Each task writes under a
name of its own, and only the names that successful tasks return are read on, so a repeated
task leaves no trace in the result.  Archives are read and written as streams, one record
at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.graph import may_contain, membership
from ridelens.session import checkpoint_dir, cut_lineage

CHUNK = 1 << 20
MIN_REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
URN = "urn:page:"

# Fixed value: the profile of revisit records with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with the payload, or a revisit record with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{name}>",
            f"WARC-Target-URI: {quote(url, safe=_SAFE) if url else URN + name}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


# Fixed value: characters that a target URI keeps as they are.
_SAFE = ":/?#[]@!$&'()*+,;=%-._~"


class _Inflated:
    """Bytes of a gzip file (one member or many) as a stream."""

    def __init__(self, source):
        self.source, self.inflate, self.held = source, zlib.decompressobj(31), bytearray()
        self.rest = b""

    def _more(self) -> bool:
        data = self.rest or self.source.read(CHUNK)
        self.rest = b""
        if not data:
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.held += self.inflate.decompress(data)
        self.rest = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes | None:
        at, looked = self.held.find(mark), 0
        while at < 0:
            looked = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
            at = self.held.find(mark, looked)
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(source) -> Iterator[bytes]:
    """Every record of an archive, header and block and closing line ends."""
    stream = _Inflated(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        yield head + stream.take(int(headers(head)["content-length"])) + stream.take(4)


def parse(record: bytes) -> dict:
    """What a page record says of its payload; a response's payload is measured anew."""
    head, _, block = record.partition(b"\r\n\r\n")
    h = headers(head)
    http, _, payload = block[:int(h["content-length"])].partition(b"\r\n\r\n")
    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {h['warc-record-id']} does not have its digest")
    else:
        size = int(headers(http)["content-length"])
    number = lambda v: None if v is None or v.endswith("null>") else int(v.strip("<>").removeprefix(URN))
    return {"page_id": number(h["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": number(h.get("warc-refers-to"))}


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """``path, records``: one gzip stream of records per task from ``page_id, url, payload, digest, refers_to, revisit``."""
    def run(batches):
        fs, root = _open(folder)
        path, n = f"{root}/whole-{uuid.uuid4().hex}.warc.gz", 0
        out = squeeze = None
        for b in batches:
            for row in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit"))):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out, squeeze = fs.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                page, url, payload, digest, refers, revisit = row
                out.write(squeeze.compress(record_bytes(page.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(),
                                                        refers.as_py(), revisit.as_py())))
                n += 1
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})
    return cut_lineage(pages.mapInArrow(run, "path string, records long"))


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites each archive of ``path`` with every record as a gzip member of its own, next to an index
    file with one JSON line ``{offset, length, id, type}`` per record: ``path, index, records, bytes``."""
    def run(batches):
        fs, root = _open(folder)
        for b in batches:
            for source in b.column("path").to_pylist():
                name = f"{root}/records-{uuid.uuid4().hex}.warc.gz"
                at = n = 0
                with fs.open_input_stream(source, compression=None) as whole, fs.open_output_stream(name, compression=None) as out, \
                        fs.open_output_stream(f"{name}.idx", compression=None) as index:
                    for record in records(whole):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = squeeze.compress(record) + squeeze.flush()
                        h = headers(record[:record.find(b"\r\n\r\n")])
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "id": h.get("warc-record-id"),
                                                "type": h.get("warc-type")}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"path": [name], "index": [f"{name}.idx"], "records": pa.array([n], pa.int64()),
                                                  "bytes": pa.array([at], pa.int64())})
    return cut_lineage(_one_per_task(archives.select("path")).mapInArrow(run, "path string, index string, records long, bytes long"))


def _one_per_task(paths: DataFrame) -> DataFrame:
    n = max(1, paths.count())
    return paths.repartition(min(n, 10_000), "path")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record, each read by its offset and length in the index."""
    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        fs, _ = _open(folder)
        for b in batches:
            for path, index in zip(b.column("path").to_pylist(), b.column("index").to_pylist()):
                rows = []
                with fs.open_input_file(path) as archive, fs.open_input_stream(index, compression=None) as lines:
                    for line in _lines(lines):
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        rows.append(parse(zlib.decompress(archive.read(entry["length"]), 31)))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)
    return _one_per_task(archives.select("path", "index")).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(CHUNK):
        *done, rest = (rest + chunk).split(b"\n")
        yield from done
    if rest:
        yield rest


def _maybe_repeated(bits, wanted: bool):
    def run(batches):
        for b in batches:
            hit = may_contain(bits.value, b.column("digest_key").to_numpy()) == wanted
            if hit.any():
                yield b.filter(pa.array(hit))
    return run


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to, revisit``: of payloads of at least ``min_bytes`` that are
    equal, all but the one with the smallest page_id revisit it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("digest_key", F.xxhash64("digest"))
    long_rows = rows.where(F.octet_length("payload") >= min_bytes)
    groups = cut_lineage(long_rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        "digest", "first"))
    bits = membership(groups, F.xxhash64("digest"))
    ddl = "page_id long, url string, payload binary, digest string, digest_key long"
    single = rows.mapInArrow(_maybe_repeated(bits, False), ddl).select(
        "page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    some = rows.mapInArrow(_maybe_repeated(bits, True), ddl).join(groups, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    some = some.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return single.unionByName(some)


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes ``pages`` (``page_id, url, html``) as WARC archives, normalises them and reads them back:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, one row per row of ``pages``.

    The payload is the html in UTF-8 (null: empty); its size and digest are those of the full payload
    for revisits too.  Payloads under ``min_bytes`` are all responses.  Rows that repeat the smallest
    page_id of their payload are responses as well.  A null page_id is no smallest one, revisits like
    others and is read back as null; a null or empty url is written as a URN.  An empty table writes
    no archive and gives an empty result.  Other columns are ignored.  ``folder`` must be seen by all
    executors; by default it is a new one in the checkpoint folder.
    """
    folder = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    whole = write_monolithic(with_revisits(pages, min_bytes), folder)
    return read_archives(normalise(whole, folder), folder)
