"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``;
a bundle closes with a skippable frame, the seek table of the public seekable
format: the compressed and the whole size of each frame.  The index, a table,
maps each record to (bundle, frame, offset in the frame, length), so one record
costs the read of one frame.

Equal payloads of at least ``least`` bytes are stored once: the record with the
smallest page_id is the response, the others are revisits that refer to it and
carry its digest and length.  Pages meet the response of their payload in parts
of a digest, so the copies of one payload do not meet in one task.

Bundles go to a folder that all executors share.  A bundle is written under a
name of its task attempt and counts once the index names it, so lost executors
and repeated tasks leave at most files that nothing refers to.

Defined results: a null payload is empty; payloads below ``least`` bytes are
all responses; equal rows, as all rows of one page_id with the payload's
smallest id, are all responses; a null page_id is never referred to; a payload
longer than a frame has a frame of its own; control characters of an url are
percent-encoded; an empty table has an empty index and no bundle; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm._shared import materialize, shared_path, tidy

#: Bytes of records in a frame, and of frames in a bundle, about.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 64 << 20
#: Bytes of records that a task reads, about, and frames that are dealt to one task together.
READ_BYTES, READ_FRAMES = 32 << 20, 16
# Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*:", uri) else (pafs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", *([f"WARC-Target-URI: {target}"] if url is not None else []), "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The row of RECORD of one record; an error if its payload has another digest."""
    head, _, body = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    payload = body[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda key: int(x) if (x := fields.get(key, "<urn:page:>")[10:-1]) else None
    size = int(fields["Payload-Length"])
    if fields["WARC-Type"] == "response":
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} has another digest")
    return page("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], size, digest, page("WARC-Refers-To"), payload if fields["WARC-Type"] == "response" else None


class Bundle:
    """Writes one bundle: add() returns a record's frame, offset and length."""

    def __init__(self, folder: str, name: str):
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.out = f"{folder}/{name}", self.fs.open_output_stream(f"{path}/{name}", compression=None)
        self.codec, self.frames, self.open, self.size = zstandard.ZstdCompressor(level=3, write_checksum=True), [], [], 0
        self.written = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        if self.size and self.size + len(data) > FRAME_BYTES:
            self._flush()
        at = len(self.frames), self.size, len(data)
        self.open.append(data)
        self.size += len(data)
        return at

    def _flush(self) -> None:
        if self.open:
            packed = self.codec.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.open, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Reads frames of one bundle."""

    def __init__(self, path: str):
        fs, where = filesystem(path)
        self.file = fs.open_input_file(where)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entries = list(struct.iter_unpack("<II", self.file.read_at(8 * count, end - 9 - 8 * count)))
        self.frames, at = [], 0
        for packed, whole in entries:
            self.frames.append((at, packed, whole))
            at += packed
        self.codec, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def close(self) -> None:
        self.file.close()

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            at, packed, whole = self.frames[frame]
            self.last = frame, self.codec.decompress(self.file.read_at(packed, at), max_output_size=whole)
        return self.last[1][offset : offset + length]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, seq, bundle = TaskContext.get(), 0, None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if bundle is None:
                    bundle = Bundle(folder, f"{context.partitionId():06d}-{seq:04d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst")
                    seq += 1
                rows.append((x["page_id"], bundle.path, *bundle.add(record(x["page_id"], x["url"], (x["payload"] or "").encode(), x["digest"], x["refers_to"]))))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return run


def archive(pages: DataFrame, least: int = 100, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the index, a written table."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    payload = F.coalesce("html", F.lit(""))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("page_id"), F.lit(parts)).alias("part")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest")).select("*", part)
    long = F.octet_length("payload") >= least
    some = rows.where(long).groupBy("digest", "part").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = some.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1 and first is not null")
    first = some.select("digest", "part").join(first.select("digest", "first"), "digest")
    known = rows.join(first.hint("merge"), ["digest", "part"], "left")
    refers = F.when(long & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return materialize(known.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(tidy(_write(folder)), INDEX))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, reader = None, None
    try:
        for batch in batches:
            rows, size = [], 0
            for x in batch.to_pylist():
                if x["bundle"] != path:
                    if reader is not None:
                        reader.close()
                    path, reader = x["bundle"], Reader(x["bundle"])
                rows.append(parse(reader.read(x["frame"], x["offset"], x["length"])))
                size += x["length"]
                if size >= 8 << 20:
                    yield _records(rows)
                    rows, size = [], 0
            if rows:
                yield _records(rows)
    finally:
        if reader is not None:
            reader.close()


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read(index: DataFrame) -> DataFrame:
    """The records that rows of an index name, read from their bundles, in tasks of about READ_BYTES of records."""
    tasks = (index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES + 1  # the index is narrow: its own bytes say nothing
    near = index.repartition(tasks, "bundle", F.expr(f"frame div {READ_FRAMES}")).sortWithinPartitions("bundle", "frame", "offset")
    return near.mapInArrow(tidy(_read), RECORD)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, from archives written and read back."""
    return read(archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
