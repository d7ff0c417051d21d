"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a skippable frame at the
end of a bundle is its seek table (the published seekable format: sizes and checksum of
each frame). The list of bundles' records maps a record id to its frame and the offset
inside the frame, so one record is read with two short range reads.

Records with equal payloads are written once: the one with the largest id is a
response, the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrow
from caseloom.session import new_folder, stored

FRAME_BYTES = 1 << 20  # of records in a frame, before compression
BUNDLE_BYTES = 256 << 20  # of records in a bundle, before compression
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
DATE = "1970-01-01T00:00:00Z"  # the table has no fetch time
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW = "page_id bigint, bundle string, frame int, offset bigint, length bigint"
_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
_NAMES = ("page_id", "bundle", "frame", "offset", "length")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    if record is None:
        return None
    name = record.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers: bool, refers_to: int | None) -> bytes:
    """A WARC record: an HTTP response, or a revisit with the HTTP header alone."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode().split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in pairs}


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """WARC and HTTP headers and the payload of the record at ``at``, and where it ends."""
    stop = data.index(b"\r\n\r\n", at)
    head = _headers(data[at:stop])
    block = data[stop + 4 : stop + 4 + int(head["content-length"])]
    split = block.index(b"\r\n\r\n")
    return head, _headers(block[:split]), block[split + 4 :], stop + 8 + len(block)


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, out: pa.NativeFile, frame_bytes: int, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.written, self.table = [], 0, 0, []

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset inside it, and length of the record."""
        place = len(self.table), self.size, len(data)
        self.held.append(data)
        self.size += len(data)
        self.written += len(data)
        if self.size >= self.frame_bytes:
            self._frame()
        return place

    def _frame(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.compressor.compress(raw)
            self.out.write(packed)
            self.table.append(struct.pack("<3I", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def finish(self) -> None:
        self._frame()
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<2I", SKIPPABLE, len(body)) + body)


class BundleReader:
    """Frames of a bundle by number, through its seek table."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & CHECKSUMS else 8
        table = file.read_at(width * count, size - 9 - width * count)
        self.frames, at = [], 0
        for i in range(count):
            packed, raw, *check = struct.unpack_from("<3I" if width == 12 else "<2I", table, width * i)
            self.frames.append((at, packed, raw, check))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, raw, check = self.frames[number]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=raw)
        if len(data) != raw or check and check[0] != xxhash.xxh64_intdigest(data) & 0xFFFFFFFF:
            raise ValueError(f"frame {number} is damaged")
        return data


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and, for revisits, the page they repeat.

    Largest ids are found from digests alone; the join that brings them back is split by
    AQE where one payload is very frequent.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "sha", F.sha2(F.encode("html", "UTF-8"), 256)
    )
    large = F.octet_length("html") >= least_bytes
    best = keyed.where(large).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = best.where("n > 1").select("sha", "last")
    joined = keyed.join(repeated, "sha", "left")
    refers = large & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", refers.alias("refers"), F.when(refers, F.col("last")).alias("refers_to"))


def write_bundles(
    pages: DataFrame,
    folder: str | None = None,
    least_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write a record per page; return the stored list page_id, bundle, frame, offset, length.

    Each task writes bundles of its own rows. Bundles are named by this list, so what a
    lost or repeated task has left is never read.

    A null html is an empty payload, a null url leaves the target out. Among equal
    payloads of at least ``least_bytes`` bytes a page with the largest page_id is a
    response; rows that repeat that page_id with the same payload all are. A null page_id
    is never the largest unless all are null. Other columns are ignored.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")

    def write(batches):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        writer, out, path, rows = None, None, "", []

        def finished() -> pa.RecordBatch:
            writer.finish()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

        for batch in arrow.sliced(batches, "html"):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers", "refers_to")]
            for page_id, url, html, refers, refers_to in zip(*columns):
                if writer is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out = system.open_output_stream(path, compression=None)
                    writer, rows = BundleWriter(out, frame_bytes), []
                rows.append((page_id, path, *writer.add(record(page_id, url, html.encode(), refers, refers_to))))
                if writer.written >= bundle_bytes:
                    yield finished()
                    writer = None
        if writer is not None:
            yield finished()

    return stored(with_references(pages, least_bytes).mapInArrow(write, ROW), "warc-records")


def _described(data: bytes, at: int) -> tuple[tuple, int]:
    head, http, payload, end = parse(data, at)
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    response = head["warc-type"] == "response"
    if response and digest != payload_digest(payload):
        raise ValueError(f"payload of {head['warc-record-id']} is damaged")
    row = (
        page_of(head["warc-record-id"]), int(http["content-length"]), digest, head["warc-type"],
        page_of(head.get("warc-refers-to")), head.get("warc-target-uri"), payload if response else None,
    )
    return row, end


_READ_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
_READ_NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")


def _read_schema(payloads: bool) -> str:
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return schema + ", url string, payload binary" * payloads


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    n = len(_READ_NAMES) if payloads else 5
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[i], _READ_TYPES[i]) for i in range(n)], _READ_NAMES[:n])


def read_bundles(records: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """All records of the listed bundles, frame by frame; payload digests are checked.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, and with
    ``payloads`` also url and payload (null for revisits).
    """
    frames = records.groupBy("bundle", "frame").agg(F.count(F.lit(1)).alias("n"))

    def read(batches):
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, frame, n in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "n"))):
                with system.open_input_file(path) as file:
                    data = BundleReader(file).frame(frame)
                rows, at = [], 0
                while at < len(data):
                    row, at = _described(data, at)
                    rows.append(row)
                if len(rows) != n:
                    raise ValueError(f"frame {frame} of {path} lacks records")
                yield _batch(rows, payloads)

    return frames.mapInArrow(read, _read_schema(payloads))


def fetch(records: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """The records of the wanted page_ids, each by its frame and offset, with payloads.

    Frames are read once for all their wanted records. Ids that are not in the archive
    give no row, repeated ids count once.
    """
    wanted = records.join(ids.select("page_id").distinct(), "page_id")
    by_frame = wanted.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def read(batches):
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, frame, offsets in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offsets"))):
                with system.open_input_file(path) as file:
                    data = BundleReader(file).frame(frame)
                yield _batch([_described(data, at)[0] for at in offsets], True)

    return by_frame.mapInArrow(read, _read_schema(True))


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to bundles in the shared folder and read them back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, folder, least_bytes), folder)
