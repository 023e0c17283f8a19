"""WARC archives (operator 8): a monolithic-gzip normaliser with a sidecar offset index.

``write_archives`` writes pages as WARC 1.1 records into whole-file gzip streams, many files in parallel, each of
bounded size. ``normalise_archives`` inflates each such stream once, from front to back in bounded memory, rewrites every
record as a gzip member of its own and notes (file, offset, length) of each member in an index table. ``read_records``
reads records back through that index: every task opens its archives and seeks to the members that it was dealt.

Equal payloads of at least ``revisit_bytes`` are stored once: the page with the largest id is the response, the others
are revisit records that name it and carry the digest and the size of the full payload.

Archives are written through ``pyarrow.fs`` into the shared folder, under a name of the task attempt; only attempts
whose rows reached the index table count, so a repeated task leaves an unused file and no half-read one.

Defined results: null html is an empty payload; pages of the same id and payload are one record each and stay so; a page
without id is a record named "none", counts as smaller than any other, and is read back with a null id; a payload of fewer
bytes than the bound is always response.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Scratch

REVISIT_BYTES = 1000
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str):
    where, inside = fs.FileSystem.from_uri(path)
    return where, inside


# ------------------------------------------------------------------ records


def record_bytes(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; ``payload`` is stored for responses only."""
    block = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return _VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), block and HTTP payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return {"headers": headers, "block": block, "payload": block.partition(b"\r\n\r\n")[2] if block else b""}


class RecordStream:
    """Whole records out of an inflating stream, of any kind of WARC file, in memory bounded by the largest record."""

    def __init__(self, source, chunk: int = 1 << 18):
        self.source, self.chunk, self.buffer = source, chunk, bytearray()
        self.inflate, self.done = zlib.decompressobj(31), False

    def _more(self) -> bool:
        while not self.done:
            left = self.inflate.unconsumed_tail or self.inflate.unused_data
            if self.inflate.eof:  # files of several members are read too
                self.inflate = zlib.decompressobj(31)
            raw = left or self.source.read(self.chunk)
            if not raw:
                self.done = True
                if len(self.buffer) and not self.buffer.strip():
                    self.buffer.clear()
                return False
            out = self.inflate.decompress(raw, self.chunk * 4)
            if out:
                self.buffer += out
                return True
        return False

    def __iter__(self):
        while True:
            at = self.buffer.find(b"\r\n\r\n")
            while at < 0:
                if not self._more():
                    if self.buffer:
                        raise ValueError("the archive ends within a record")
                    return
                at = self.buffer.find(b"\r\n\r\n")
            size = None
            for line in bytes(self.buffer[:at]).split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length":
                    size = int(value)
            if size is None:
                raise ValueError("a record without Content-Length")
            end = at + 4 + size + 4
            while len(self.buffer) < end:
                if not self._more():
                    raise ValueError("the archive ends within a record")
            yield bytes(self.buffer[:end])
            del self.buffer[:end]


# ------------------------------------------------------------------ Spark jobs


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, record_type, refers_to: which page stores a payload."""
    scratch = scratch or Scratch(pages.sparkSession, "warc-plan")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("_sha"))
    large, small = digests.where(F.col("payload_bytes") >= revisit_bytes), digests.where(F.col("payload_bytes") < revisit_bytes)
    # shared payloads only: the grouped maximum is pre-aggregated, and a payload of one page needs no join partner
    shared = scratch.settle(large.groupBy("_sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    columns = ["page_id", "url", "html", "payload_digest", "payload_bytes"]
    joined = large.join(shared, "_sha", "left").select(*columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))
    return joined.unionByName(small.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))


def write_archives(records: DataFrame, folder: str, file_bytes: int = 64 << 20) -> DataFrame:
    """Write monolithic gzip archives under ``folder``; the lazy result has one row (path, records) per archive.

    An archive is closed when ``file_bytes`` of records went into it. The result must be settled before its use.
    """

    def run(batches):
        where, inside = _open(folder)
        where.create_dir(inside, recursive=True)
        sink = packer = None
        done, size, count, name = [], 0, 0, ""

        def close():
            nonlocal sink
            if sink is not None:
                sink.write(packer.flush())
                sink.close()
                done.append((f"{folder}/{name}", count))
                sink = None

        for batch in batches:
            for r in batch.to_pylist():
                if sink is None:
                    name, size, count = f"mono-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink, packer = where.open_output_stream(f"{inside}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                payload = b"" if r["record_type"] == "revisit" else (r["html"] or "").encode()
                raw = record_bytes(r["page_id"], r["url"], r["record_type"], payload, r["payload_digest"], r["payload_bytes"], r["refers_to"])
                sink.write(packer.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([{"path": p, "records": n} for p, n in done], schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    # only what a record stores travels on
    lean = records.withColumn("html", F.when(F.col("record_type") == "response", F.col("html")))
    return lean.mapInArrow(run, "path string, records long")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``archives`` (path) record by record; the lazy result is the offset index.

    One row per record: path, offset, length of its gzip member, record_id.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, inside = _open(path)
                to, target = _open(folder)
                to.create_dir(target, recursive=True)
                name, rows, at = f"norm-{uuid.uuid4().hex}.warc.gz", [], 0
                with where.open_input_stream(inside, compression=None) as source, to.open_output_stream(f"{target}/{name}", compression=None) as sink:
                    for raw in RecordStream(source):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        sink.write(member)
                        head = raw[: raw.index(b"\r\n\r\n")].decode("utf-8", "replace")
                        record = next((x.partition(":")[2].strip() for x in head.split("\r\n") if x.lower().startswith("warc-record-id:")), None)
                        rows.append({"path": f"{folder}/{name}", "offset": at, "length": len(member), "record_id": record})
                        at += len(member)
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 10_000], schema=_INDEX)

    return archives.select("path").mapInArrow(run, "path string, offset long, length long, record_id string")


_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _urn(value: str | None) -> int | None:
    number = value.strip("<>").rpartition(":")[2] if value else "none"
    return None if number == "none" else int(number)


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` points to, each read by seeking to its member.

    A stored payload whose digest or size differs from its headers is an error.
    """

    def run(batches):
        path, source = None, None
        for batch in batches:
            rows = []
            for r in sorted(batch.to_pylist(), key=lambda r: (r["path"], r["offset"])):
                if r["path"] != path:
                    path = r["path"]
                    where, inside = _open(path)
                    source = where.open_input_file(inside)
                source.seek(r["offset"])
                record = parse_record(zlib.decompress(source.read(r["length"]), 31))
                h = record["headers"]
                digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                if h["warc-type"] == "response" and (hashlib.sha1(record["payload"]).hexdigest() != digest or len(record["payload"]) != size):
                    raise ValueError(f"{path}: a payload differs from its digest")
                rows.append({
                    "page_id": _urn(h["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"],
                    "refers_to": _urn(h.get("warc-refers-to")), "url": h.get("warc-target-uri"), "payload": record["payload"] if with_payload else None,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return index.select("path", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive_round_trip(pages: DataFrame, *, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = 64 << 20, read_bytes: int = 4 << 20) -> DataFrame:
    """Write, normalise and read back all pages: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "warc")
    records, mono, norm = plan_records(pages, revisit_bytes, scratch), scratch.path("mono"), scratch.path("norm")
    archives = scratch.settle(write_archives(records, mono, file_bytes), "archives")
    # both tables are small beside what they point to, so their rows are dealt by number and not by their own size
    spread = archives.repartition(max(1, archives.count()), "path")
    index = scratch.settle(normalise_archives(spread, norm), "index")
    scratch.remove(mono)
    stored = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.repartition(int(stored // read_bytes) + 1, "path", F.floor(F.col("offset") / read_bytes))
    result = scratch.last(read_records(dealt, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    scratch.remove(norm)
    return result


def records_of(raw: bytes) -> list[bytes]:
    """All records of an archive held in memory (for tools and tests)."""
    return list(RecordStream(io.BytesIO(raw)))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, encode(coalesce(html, '')) AS b FROM pages
), k AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keeper IS DISTINCT FROM page_id AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper IS DISTINCT FROM page_id AND keeper IS NOT NULL THEN keeper END AS refers_to
FROM k
"""
