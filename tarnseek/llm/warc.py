"""WARC archives with an index: one gzip member per record, read back by byte ranges.

The index is written along with the archives: file, offset, length, URL and digest of every
record. Reading starts from index rows: they are sorted by file and offset, ranges that lie close
together are fetched as one, and records are cut out of them.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnseek.llm.arrow_groups import by_bytes
from tarnseek.llm.common import shared_uri, text_of, written

#: Payloads of fewer bytes are always written in full.
MIN_SHARED_BYTES = 100
#: An archive is closed once it is this long; ranges at most this far apart are read as one, up to this many bytes.
FILE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Bytes of archives for each reading task, about.
TASK_BYTES = 128 << 20
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"


def assigned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, record_type and refers_to of each page.

    Of pages with equal payloads of at least MIN_SHARED_BYTES, those with the smallest page_id are responses and the
    others revisit it. Pages without an id revisit it too; if none of them has one, all are responses. Rows that
    share the smallest id are all responses. A null html is an empty payload.
    """
    payload = F.encode(text_of("html"), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    shared = rows.where(F.col("size") >= MIN_SHARED_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written first, so that the planner knows how many there are: few are broadcast, many are sort-merged with skew split.
    shared = written(shared.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "shared-payloads")
    rows = rows.join(shared, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def _record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page} {digest}')}>"


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One record, not yet compressed. A revisit (no payload) has the HTTP head only, with the full payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if payload is None:
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one record. Raises ValueError if its lengths don't fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"not a whole WARC record: {head[:200]!r}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and len(payload) != size:
        raise ValueError(f"payload of {len(payload)} bytes, not {size}")
    return {
        "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload_bytes": size,
        "payload": None if revisit else payload,
        "refers_to": int(fields["X-Refers-To-Page-ID"]) if revisit else None,
    }


_INDEX = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("refers_to", pa.int64()),
])


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write all pages as records and return the index, itself a table in the shared folder.

    Each task writes archives under names of its own; those of failed attempts aren't in the index. An
    empty table writes none. ``folder`` is any place that all executors reach. Line breaks in URLs, which would end a
    header, are written as ``%0D`` and ``%0A``, and so they are read back.
    """
    folder = folder or shared_uri(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            for rows in by_bytes(batch, "payload", READ_BYTES):
                found = []
                for r in rows.to_pylist():
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = fs.open_output_stream(f"{path}/{name}", compression=None), 0
                    data = gzip.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["size"], r["refers_to"], date), 6, mtime=0)
                    out.write(data)
                    found.append((r["page_id"], r["url"], f"{folder}/{name}", at, len(data), r["digest"], r["size"], r["record_type"], r["refers_to"]))
                    at += len(data)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()

    return written(assigned(pages).mapInArrow(run, INDEX), "warc-index")


def _coalesced(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs (first row, row after the last) of one file's rows that are read at once."""
    start, end = 0, None
    first = 0
    for i, (offset, length) in enumerate(zip(offsets, lengths)):
        if end is not None and (offset - end > GAP_BYTES or offset + length - first > READ_BYTES):
            yield start, i
            start, end = i, None
        if end is None:
            first = offset
        end = max(end or 0, offset + length)
    if end is not None:
        yield start, len(offsets)


def read_records(index: DataFrame) -> DataFrame:
    """The records of ``index`` rows: page_id, url, record_type, payload_digest, payload_bytes, payload and refers_to.

    ``index`` is the whole index or any selection of its rows. payload is null for revisits. There is a task for each
    TASK_BYTES of the selected records, so tasks don't grow with the archives.
    """
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, (index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)
    near = F.floor(F.col("offset") / READ_BYTES)
    rows = index.select("file", "offset", "length").repartition(tasks, "file", near).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            start = 0
            for uri, same in groupby(uris):
                stop = start + sum(1 for _ in same)
                offset, length = offsets[start:stop], lengths[start:stop]
                start = stop
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as file:
                    for first, last in _coalesced(offset, length):
                        cuts = list(zip(offset[first:last], length[first:last]))
                        base = cuts[0][0]
                        data = file.read_at(max(o + n for o, n in cuts) - base, base)
                        yield pa.RecordBatch.from_pylist([parse(zlib.decompress(data[o - base : o - base + n], 31)) for o, n in cuts], schema=_RECORD)

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, payload binary, refers_to long"
    return rows.mapInArrow(run, schema)
