"""WARC archives as seekable Zstandard bundles.

Records are gathered into frames of about ``frame_bytes``; each frame is compressed on its own, and a seek table
in a skippable frame (the public seekable format) closes the file, so any frame can be read with two small
reads. An index maps every record to its archive, frame and offset within the frame's raw bytes.

Tasks write archives to a shared folder under names of their own and report them only when they are closed;
the index is committed by Spark, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawstat.llm.common import keep, slots
from drawstat.streaming.storage import shared_folder

# The public seekable Zstandard format and the WARC 1.1 profile of revisits.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 28
DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of capture
INDEX = "archive string, frame int, raw_bytes bigint, records array<struct<record_id: string, at: bigint, length: bigint>>"


def record_id(page_id: int | None) -> str:
    return "<urn:page:" + ("none" if page_id is None else str(page_id)) + ">"


def page_of(ident: str | None) -> int | None:
    text = (ident or "none>").rsplit(":", 1)[-1][:-1]
    return None if text == "none" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a whole response, or a revisit that holds only the response's header."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date),
              ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class ArchiveWriter:
    """Frames and the closing seek table of one file."""

    def __init__(self, uri: str, level: int = 3):
        store, path = pa.fs.FileSystem.from_uri(uri)
        self.uri, self._out, self._sizes = uri, store.open_output_stream(path, compression=None), []
        self._compressor = zstandard.ZstdCompressor(level=level)
        self.written, self.rows, self._raw, self._records = 0, [], bytearray(), []

    def add(self, ident: str, raw: bytes, frame_bytes: int) -> None:
        self._records.append({"record_id": ident, "at": len(self._raw), "length": len(raw)})
        self._raw += raw
        if len(self._raw) >= frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self._records:
            return
        packed = self._compressor.compress(bytes(self._raw))
        self._out.write(packed)
        self.rows.append({"archive": self.uri, "frame": len(self._sizes), "raw_bytes": len(self._raw), "records": self._records})
        self._sizes.append((len(packed), len(self._raw)))
        self.written += len(packed)
        self._raw, self._records = bytearray(), []

    def close(self) -> list[dict]:
        self._flush()
        entries = b"".join(struct.pack("<II", *s) for s in self._sizes)
        footer = struct.pack("<IBI", len(self._sizes), 0, SEEKABLE_MAGIC)
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self._out.close()
        return self.rows


class ArchiveReader:
    """Random access to the frames of one file through its seek table."""

    def __init__(self, uri: str):
        store, path = pa.fs.FileSystem.from_uri(uri)
        self._file = store.open_input_file(path)
        size = self._file.size()
        count, _, magic = struct.unpack("<IBI", self._file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = self._file.read_at(8 * count, size - 9 - 8 * count)
        self._sizes = list(struct.iter_unpack("<II", table))
        self._at = [0]
        for packed, _ in self._sizes:
            self._at.append(self._at[-1] + packed)

    def __len__(self) -> int:
        return len(self._sizes)

    def frame(self, number: int) -> bytes:
        packed, raw = self._sizes[number]
        return zstandard.ZstdDecompressor().decompress(self._file.read_at(packed, self._at[number]), max_output_size=raw)

    def close(self) -> None:
        self._file.close()


def with_decisions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to). Of equal payloads of at least ``min_bytes`` the one with the
    largest page_id is stored, the others revisit it.

    A null html is an empty payload. A null page_id is never the largest unless all are null; rows that repeat
    the stored page_id are stored as well. Payloads are equal when SHA-1 and length are."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # one row per digest however often it occurs; only shared ones go on
    shared = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.count("*").alias("n"), F.max("page_id").alias("stored")).filter("n > 1")
    shared = keep(shared.select(F.col("digest").alias("shared"), "stored"), "shared")
    revisit = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    return rows.join(shared, F.col("digest") == F.col("shared"), "left").select(
        "page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("stored")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                   min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are ignored) as archives below ``folder`` and return
    the committed index, one row per frame. A record larger than a frame fills one of its own. An empty
    table writes no archive."""
    folder = folder or shared_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("frame", pa.int32()), ("raw_bytes", pa.int64()),
                            ("records", pa.list_(pa.struct([("record_id", pa.string()), ("at", pa.int64()), ("length", pa.int64())])))])
        writer = None
        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*batch.columns):
                if writer is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    store, path = pa.fs.FileSystem.from_uri(folder)
                    store.create_dir(path)
                    writer = ArchiveWriter(uri)
                page = page_id.as_py()
                writer.add(record_id(page), record(page, url.as_py(), payload.as_py(), revisit.as_py(), refers_to.as_py(), date), frame_bytes)
                if writer.written >= archive_bytes:
                    yield pa.RecordBatch.from_pylist(writer.close(), schema)
                    writer = None
        if writer is not None:
            yield pa.RecordBatch.from_pylist(writer.close(), schema)

    return keep(with_decisions(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")


RECORDS = ("record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
           "payload_digest string, payload binary")


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record the index names, read back by archive, frame and offset. The digest of a stored payload
    is computed anew and must equal the recorded one. Revisits have no payload of their own."""
    spark = index.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        reader = uri = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != uri:
                    if reader:
                        reader.close()
                    uri, reader = row["archive"], ArchiveReader(row["archive"])
                raw, out = reader.frame(row["frame"]), []
                for r in row["records"]:
                    fields, http, payload = parse(raw[r["at"]:r["at"] + r["length"]])
                    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{uri}: the payload of {r['record_id']} differs from its digest")
                    out.append((fields["WARC-Record-ID"], page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"],
                                page_of(fields.get("WARC-Refers-To")), int(http["Content-Length"]), digest,
                                payload if with_payload and not revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if reader:
            reader.close()

    spread = index.repartition(slots(spark), "archive", "frame").sortWithinPartitions("archive", "frame")
    return spread.mapInArrow(run, RECORDS)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records named by ``wanted`` (record_id); only the frames that hold them are read."""
    places = index.select("archive", "frame", "raw_bytes", F.explode("records").alias("r"))
    found = places.join(wanted.select(F.col("record_id").alias("wanted_id")).distinct(), F.col("r.record_id") == F.col("wanted_id"))
    return read_archives(found.groupBy("archive", "frame").agg(F.max("raw_bytes").alias("raw_bytes"), F.collect_list("r").alias("records")))
