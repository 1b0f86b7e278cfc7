"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of
frames with a seek table in a skippable frame at its end, as in the public
seekable format, so any reader of Zstandard can decompress it and a record is
reached by decompressing one frame.  An index maps record identifiers to frame
number, offset in the frame and length.

Bundles are rows of a Parquet table in the shared folder: Spark writes and
commits them, and any executor can read them.

Equal payloads of at least ``LEAST`` bytes are written once: the row with the
smallest page_id is the response, the others are revisits that refer to it.

Results: a null payload is empty.  Rows that share the smallest page_id are all
responses; a row without page_id is never the smallest unless all are, and then
it is a response.  Characters that would break a header line are
percent-encoded in it; a null url is an empty one.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory  # noqa: F401  freed buffers go back to the system
from .workspace import written

LEAST = 100
#: Bytes of records in a frame, and of frames in a bundle, at which the next one begins.
FRAME = 256 << 10
BUNDLE = 4 << 20
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the formats.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def _header(value: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; first: the page_id of the response that a revisit refers to."""
    name = lambda i: f"<{_ID}{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header(url)}"]
    if first is not None:
        lines += [f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames, and frames into one bundle."""

    def __init__(self, frame: int = FRAME, level: int = 3):
        self.frame, self.pack = frame, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = self.bytes = 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, name: str, record: bytes) -> None:
        self.index.append((name, len(self.frames), self.held_bytes, len(record)))
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= self.frame:
            self._close()

    def _close(self) -> None:
        if self.held:
            data = self.pack.compress(b"".join(self.held))
            self.frames.append(data)
            self.sizes.append((len(data), self.held_bytes))
            self.bytes += len(data)
            self.held, self.held_bytes = [], 0

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes | memoryview) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    table = bundle[-9 - n * width : -9]
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes | memoryview, frame: tuple[int, int, int]) -> bytes:
    at, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


def read_record(bundle: bytes | memoryview, frame: int, offset: int, length: int) -> bytes:
    """One record by its index entry; only its frame is decompressed."""
    return read_frame(bundle, seek_table(bundle)[frame])[offset : offset + length]


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def page_id(self) -> int | None:
        return _page(self.headers["warc-record-id"])

    @property
    def refers_to(self) -> int | None:
        return _page(self.headers["warc-refers-to"]) if "warc-refers-to" in self.headers else None


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix(_ID)
    return int(number) if number else None


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in block.decode().split("\r\n")[1:])
    return {k.lower(): v for k, _, v in pairs}


def decode_records(data: bytes) -> Iterator[Record]:
    """The records of one decompressed frame."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at)
        headers = _fields(data[at:body])
        body += 4
        end = body + int(headers["content-length"])
        split = data.index(b"\r\n\r\n", body, end)
        yield Record(headers, _fields(data[body:split]), data[split + 4 : end])
        at = end + 4


def decisions(pages: DataFrame, *, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest and first: the response's page_id for a revisit, else null."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = F.octet_length("html") >= least
    copies = (
        rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("_digest"), "first")
    )
    joined = rows.join(copies, (F.col("digest") == F.col("_digest")) & long, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("first"))


def write_bundles(rows: DataFrame, *, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """(name, data, index) of each bundle; rows as decisions() gives them."""

    def run(batches):
        task, n, out = TaskContext.get().partitionId(), 0, BundleWriter(frame)

        def close():
            data = out.finish()
            index = [{"record_id": r, "frame": f, "at": o, "length": k} for r, f, o, k in out.index]
            return pa.RecordBatch.from_pylist([{"name": f"part-{task:05d}-{n:05d}.warc.zst", "data": data, "index": index}], schema=schema)

        schema = pa.schema([("name", pa.string()), ("data", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("length", pa.int64())])))])
        for batch in batches:
            for page_id, url, text, digest, first in zip(*batch.columns, strict=True):
                payload = text.as_py().encode()
                page_id, first = page_id.as_py(), first.as_py()
                out.add(f"{_ID}{'' if page_id is None else page_id}", encode_record(page_id, url.as_py(), payload, digest.as_py(), first))
                if out.bytes >= bundle:
                    yield close()
                    n, out = n + 1, BundleWriter(frame)
        if out.index:
            yield close()

    return rows.mapInArrow(run, "name string, data binary, index array<struct<record_id: string, frame: int, at: long, length: long>>")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row per record, in page terms; a response's payload is checked against its digest."""

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_buffer()
                view = memoryview(data)
                for part in seek_table(view):
                    rows = []
                    for r in decode_records(read_frame(view, part)):
                        digest, kind = r.headers["warc-payload-digest"].removeprefix("sha256:"), r.headers["warc-type"]
                        if kind == "response" and hashlib.sha256(r.payload).hexdigest() != digest:
                            raise ValueError(f"record {r.page_id}: the payload does not match its digest")
                        rows.append((r.page_id, int(r.http["content-length"]), digest, kind, r.refers_to))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                    )

    return bundles.select("data").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages to bundles in the shared folder; the table of bundles."""
    return written(write_bundles(decisions(pages)), "warc")
