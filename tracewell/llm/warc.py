"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a
seek table (a skippable frame that lists each frame's compressed and
decompressed size, after the published seekable format).  The index maps a
record identifier to bundle, frame and offset within the decompressed frame, so
one record costs one ranged read and one frame.

Of records with equal payloads one is a response, the others are revisits that
refer to it.  Bundles get names of their own for each attempt of a task; the
index, written through Spark's committer, names only those of attempts that
succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, join_by_size, ready, table

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Payload that a task reads back, about.
READ_BYTES = 16 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the seekable format and the WARC standard.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_UNSAFE = re.compile(r"[\x00-\x1f\x7f%]")
_HEAD = re.compile(rb"([A-Za-z-]+): ?(.*?)\r\n", re.DOTALL)


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def record_id(page_id: str | None, digest: str) -> str:
    """The identifier of the record of a page with a payload of that digest."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}\0{digest}'.encode()).digest()[:16], version=5)}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def escaped(value: str) -> str:
    """value without what could end a header line; unescaped() turns it back."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def unescaped(value: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def make_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, is_revisit: bool) -> tuple[str, bytes]:
    """Identifier and bytes of one record."""
    own = record_id(page_id, digest)
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE)]
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{escaped(str(page_id))}"
    head += [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        head.append(("Page-ID", escaped(page_id)))
    if is_revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>")]
        if refers_to is not None:
            head.append(("Refers-To-Page-ID", escaped(refers_to)))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if is_revisit else payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return own, b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, dict, bytes, int]:
    """Headers, HTTP headers and payload of the record at that place, and where it ends; headers are dicts of bytes by lower-case name."""
    body = data.index(b"\r\n\r\n", at) + 4
    head = {k.lower().decode(): v for k, v in _HEAD.findall(data[data.index(b"\r\n", at) + 2 : body - 2])}
    stop = body + int(head["content-length"])
    start = data.index(b"\r\n\r\n", body) + 4
    http = {k.lower().decode(): v for k, v in _HEAD.findall(data[body : start - 2])}
    return head, http, data[start:stop], stop + 4


class BundleWriter:
    """Writes records to one bundle; add() gives the record's frame, offset and length."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES):
        fs, path = filesystem(uri)
        self.file, self.frame_bytes = fs.open_output_stream(path, compression=None), frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.frame: list[bytes] = []
        self.filled = self.written = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.filled and self.filled + len(record) > self.frame_bytes:
            self._end_frame()
        place = len(self.sizes), self.filled, len(record)
        self.frame.append(record)
        self.filled += len(record)
        return place

    def _end_frame(self) -> None:
        packed = self.compressor.compress(b"".join(self.frame))
        self.file.write(packed)
        self.sizes.append((len(packed), self.filled))
        self.written += len(packed)
        self.frame, self.filled = [], 0

    def close(self) -> None:
        if self.filled:
            self._end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.file.close()


class BundleReader:
    """Reads frames and records of a bundle by its seek table."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        entries = self.file.read_at(frames * width, size - 9 - frames * width)
        self.frames, at = [], 0
        for i in range(frames):
            packed, plain = struct.unpack_from("<II", entries, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def close(self) -> None:
        self.file.close()


def write_archive(pages: DataFrame, id_col: str, url_col: str, html_col: str, folder: str, *, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes pages to bundles in folder and returns the index: record_id, page_id (as text), bundle, frame, offset, length."""
    spark = ready(pages)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    rows = rows.withColumn("_sha", F.sha2("_html", 256))
    # Light rows decide; the largest id of a payload is its response.
    light = table(rows.select("_id", "_sha").distinct(), "warc-payloads")
    groups = table(light.groupBy(F.col("_sha").alias("_s")).agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).filter("_n > 1"), "warc-groups")
    revisits = join_by_size(light, "_sha", groups, "_s", "_n", light.count()).filter(~F.col("_id").eqNullSafe(F.col("_keep")))
    revisits = revisits.select(F.col("_id").alias("_r"), "_s", F.col("_keep").cast("string").alias("_keep"), F.lit(True).alias("_is"))
    joined = rows.join(revisits, F.col("_id").eqNullSafe(F.col("_r")) & (F.col("_sha") == F.col("_s")), "left")
    joined = joined.select(F.col("_id").cast("string").alias("id"), "_url", F.col("_html").cast("binary").alias("html"), "_keep", F.coalesce("_is", F.lit(False)).alias("is_revisit"))

    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches):
        writer, name = None, ""
        for b in batches:
            index = []
            for page, url, html, keep, is_revisit in zip(*(c.to_pylist() for c in b.columns)):
                if writer is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(f"{folder}/{name}", frame_bytes)
                own, record = make_record(page, url, html, digest_of(html), keep, is_revisit)
                index.append((own, page, name, *writer.add(record)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), schema)] if index else [pa.array([], f.type) for f in schema], schema=schema)
        if writer is not None:
            writer.close()

    index = joined.mapInArrow(write, "record_id string, page_id string, bundle string, frame int, offset long, length long")
    where = fresh_path(spark, "warc-index")
    index.write.parquet(where)
    return spark.read.schema(index.schema).parquet(where)


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """Reads the records that the index (or any part of it) names: page_id (as text), payload_bytes, payload_digest, record_type, refers_to (as text), record_id, url, payload (null for revisits).

    A frame is read once for all its records that are asked for, each cut out at
    its offset.  Tasks get frames by hash, as many as the records' bytes need.
    """
    spark = ready(index)
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // READ_BYTES)
    places = F.array_sort(F.collect_list(F.struct("offset", "length", "record_id")))  # a frame's records: a frame has FRAME_BYTES, or one record
    frames = index.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame").agg(places.alias("places"))
    string = pa.string()
    schema = pa.schema([("page_id", string), ("payload_bytes", pa.int64()), ("payload_digest", string), ("record_type", string), ("refers_to", string), ("record_id", string), ("url", string), ("payload", pa.binary())])

    def read(batches):
        text = lambda x: None if x is None else x.decode()
        name = lambda x: None if x is None else unescaped(x.decode())
        for b in batches:
            reader, opened = None, None
            for bundle, frame, places in sorted(zip(*(c.to_pylist() for c in b.columns)), key=lambda r: r[:2]):
                if bundle != opened:
                    if reader:
                        reader.close()
                    reader, opened = BundleReader(f"{folder}/{bundle}"), bundle
                data, found = reader.frame(frame), []
                for place in places:
                    head, http, payload, end = parse_record(data, place["offset"])
                    if (own := head["warc-record-id"].decode().strip("<>")) != place["record_id"] or end != place["offset"] + place["length"]:
                        raise ValueError(f"{bundle}, frame {frame}: the record at {place['offset']} isn't {place['record_id']}")
                    kind = head["warc-type"].decode()
                    # A revisit's payload is its response's; size and digest are in its headers.
                    size, digest = (len(payload), digest_of(payload)) if kind == "response" else (int(http["content-length"]), head["warc-payload-digest"].decode().removeprefix("sha1:"))
                    found.append((name(head.get("page-id")), size, digest, kind, name(head.get("refers-to-page-id")), own, text(head.get("warc-target-uri")), payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
            if reader:
                reader.close()

    return frames.mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, url string, payload binary")


def find_records(index: DataFrame, folder: str, record_ids: DataFrame) -> DataFrame:
    """read_archive() of the records named in the column record_id of record_ids: their frames alone are read."""
    return read_archive(index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi"), folder)


def archive_round_trip(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Writes pages to an archive in the shared folder and reads it back: one row per row of pages.

    Returns id_col, payload_bytes, payload_digest, record_type, refers_to,
    record_id.  A null html is an empty payload, a null url a URN of the id.
    Null ids count as smaller than all others.  Rows that repeat id and
    payload are written each, under one record id, and have one type.  An
    empty table gives an empty archive and an empty table.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    read = read_archive(write_archive(pages, id_col, url_col, html_col, folder), folder)
    return read.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "record_id")
