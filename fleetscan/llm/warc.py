"""Seekable Zstandard WARC bundles (operator 8).

Records are grouped into frames that decompress on their own; a bundle ends with a seek
table in a skippable frame, in the public seekable format, which any Zstandard reader
passes over.  The index maps a record's id to its bundle, frame and place in the frame,
so a reader fetches the footer and one frame for a record.

Pages with equal payloads are planned by digest: the one with the smallest id is written
as a response, the others as revisits that name it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, open_fs, ship, spread

#: Uncompressed bytes of a frame and of a bundle (about), and the compression level.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 9
#: Payloads of fewer bytes are always responses.
MIN_REVISIT_BYTES = 100
#: Fixed values of the seekable format: skippable-frame magic, footer magic.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1

#: Bytes of records that one task reads back, about.
READ_BYTES = 64 << 20

RECORD = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()))
INDEX = "page_id long, bundle string, frame int, at int, size int, record_type string"


def plan_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = MIN_REVISIT_BYTES, digest: str = "payload_digest", refers: str = "refers_to") -> DataFrame:
    """``pages`` with ``digest`` (SHA-256) and ``refers`` (null for responses), which must be
    new columns' names.

    Null payloads are empty. Rows that share the smallest id of their payload are all
    responses; rows with a null id are responses. Only digests are aggregated, and only
    those of repeated payloads are kept: a written table of known size, which Spark
    broadcasts below its threshold. Beyond it the join deals pages by digest, of which each
    is there once, so that adaptive execution can split a common payload's pages.
    """
    first, n = fresh(pages, "__first"), fresh(pages, "__n")
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.withColumn(digest, F.sha2(raw, 256))
    long = rows.where(F.octet_length(raw) >= least)
    shared = materialize(long.groupBy(digest).agg(F.min(key).alias(first), F.count("*").alias(n)).where(F.col(n) > 1).select(digest, first), "first")
    return rows.join(shared, digest, "left").withColumn(refers, F.when(F.col(key) > F.col(first), F.col(first))).select(*pages.columns, digest, refers)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def block(head: list[str], content: bytes) -> bytes:
    """A WARC 1.1 record of header lines and content."""
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(content)}", "", ""]).encode() + content + b"\r\n\r\n"


def about(name: str, date: str) -> bytes:
    """The warcinfo record that opens a bundle."""
    return block(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:bundle:{name}>", f"WARC-Filename: {name}", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A page's record: an HTTP response with the payload, or a revisit with its head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is None:
        return block(head, http + payload)
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return block(head, http)


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields of a head, its first line aside."""
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = fields_of(head)
    return fields, rest[: int(fields["Content-Length"])]


class BundleWriter:
    """Writes frames to one file and the seek table at its end."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        self.uri, self.frame_bytes = uri, frame_bytes
        fs, path = open_fs(uri)
        self.file = fs.open_output_stream(path, compression=None)  # the name alone would add a codec
        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.buffer = bytearray()
        self.total = 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """Frame number, place in the frame and size of the record."""
        if self.buffer and len(self.buffer) + len(raw) > self.frame_bytes:
            self.flush()
        at = len(self.buffer)
        self.buffer += raw
        self.total += len(raw)
        return len(self.frames), at, len(raw)

    def flush(self) -> None:
        if self.buffer:
            packed = self.zip.compress(bytes(self.buffer))
            self.file.write(packed)
            self.frames.append((len(packed), len(self.buffer)))
            self.buffer = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, FOOTER)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, packed size, plain size) of each frame, from the end of a bundle."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != FOOTER:
        raise ValueError("the file has no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - count * width)
    table, out, at = file.read(count * width), [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, least: int = MIN_REVISIT_BYTES, date: str | None = None) -> DataFrame:
    """Write a record for every row into bundles below ``folder`` and return the index
    (page_id, bundle, frame, at, size, record_type), itself a written table.

    Every try of a task writes bundles of its own names, and the index names only those of
    the try that Spark committed: a lost executor leaves unreferenced files, never a wrong
    index. An empty table gives an empty index and no bundle. ``date`` of the records (as
    2020-01-31T00:00:00Z) is that of the call by default. A payload of any length is one
    record, in a frame of its own where it is longer than ``frame_bytes``. Other columns
    aren't written, whatever their names.
    """
    ship(pages.sparkSession)
    stamp = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("html"))
    source = plan_revisits(rows, least=least).select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), "payload_digest", "refers_to")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            found = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is not None and out.total > bundle_bytes:
                    out.close()
                    out = None
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = BundleWriter(f"{folder}/{name}", frame_bytes, level)
                    out.add(about(name, stamp))
                found.append((r[0], out.uri, *out.add(record(*r, stamp)), "response" if r[4] is None else "revisit"))
            cols = list(zip(*found, strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "bundle", "frame", "at", "size", "record_type"])
        if out is not None:
            out.close()

    return materialize(source.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, payloads: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (of the full
    payload) and payload (null for revisits, left out without ``payloads``) of the index's
    records, read from the bundles.

    Tasks get whole frames, about ``read_bytes`` of records each: every frame is fetched
    and decompressed once, and the digest of a response is checked against its bytes.
    """
    ship(index.sparkSession)
    placed = spread(index, "size", read_bytes, "bundle", "frame").sortWithinPartitions("bundle", "frame", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, table, now, plain = None, None, [], None, b""
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for page, bundle, frame, at, size in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if bundle != name:
                    if file is not None:
                        file.close()
                    fs, path = open_fs(bundle)
                    file, name, now = fs.open_input_file(path), bundle, None
                    table = seek_table(file, file.size())
                if frame != now:
                    file.seek(table[frame][0])
                    plain, now = unzip.decompress(file.read(table[frame][1]), max_output_size=table[frame][2]), frame
                fields, content = parse(plain[at : at + size])
                http, _, content = content.partition(b"\r\n\r\n")
                if fields["WARC-Record-ID"] != record_id(page):
                    raise ValueError(f"the index is wrong at {bundle}, frame {frame}, {at}")
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                original = fields.get("WARC-Refers-To")
                if original is None and hashlib.sha256(content).hexdigest() != digest:
                    raise ValueError(f"damaged record of page {page} in {bundle}")
                out.append((page, fields["WARC-Target-URI"], fields["WARC-Type"], original and int(original[10:-1]), int(fields_of(http)["Content-Length"]), digest, content if original is None else None))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, RECORD[: 6 + payloads], strict=False)], names=[n for n, _ in RECORD[: 6 + payloads]])
        if file is not None:
            file.close()

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    return placed.mapInArrow(run, schema + (", payload binary" if payloads else ""))
