"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, written

#: The public seekable format: a skippable frame with a size pair for each frame, then count, flags and magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame and of frames in a bundle; a record larger than either has one of its own.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20

RECORDS = "page_id bigint, url string, payload binary, digest string, record_type string, refers_to bigint"
INDEX = "page_id bigint, record_type string, bundle string, frame int, frame_start bigint, frame_bytes bigint, record_offset bigint, record_bytes bigint"
READ = "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload binary, bundle string, frame int, record_offset bigint"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. Identifiers are URNs of page ids; a revisit has no block and names the response it repeats; blanks in a URL are percent-encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"\s", lambda m: quote(m.group(0)), url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """The records of one frame: headers, block and offset."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield head, data[start:stop], at
        at = stop + 4


def page_of(urn: str | None) -> int | None:
    value = urn[len("<urn:page:") : -1] if urn else "null"
    return None if value == "null" else int(value)


class Bundle:
    """A bundle in writing: independent frames, then the seek table."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, path = opened(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.bytes = 0

    def frame(self, data: bytes) -> tuple[int, int, int]:
        """Number, start and compressed size of the frame written."""
        packed = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))
        self.bytes += len(packed)
        return len(self.sizes) - 1, self.bytes - len(packed), len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(data: io.IOBase, size: int) -> list[tuple[int, int, int]]:
    """start, compressed and plain size of each frame, from a bundle's last bytes."""
    data.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", data.read(9))
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table without checksums at the end")
    data.seek(size - 9 - 8 * count)
    flat = struct.unpack(f"<{2 * count}I", data.read(8 * count))
    found, start = [], 0
    for packed, plain in zip(flat[::2], flat[1::2], strict=True):
        found.append((start, packed, plain))
        start += packed
    return found


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes records (columns RECORDS) to bundles in folder and returns the index (columns INDEX), one row a record.

    Every attempt of a task writes bundles of its own names; the index, itself written through Spark, lists those
    of the attempts that counted. Whoever reads by the index never sees the leavings of a lost executor.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, data, held = None, bytearray(), []
        names = [x.split()[0] for x in INDEX.split(", ")]
        schema = pa.schema([(n, pa.string() if n in ("record_type", "bundle") else pa.int32() if n == "frame" else pa.int64()) for n in names])

        def flush() -> pa.RecordBatch:
            nonlocal data, held
            frame, start, size = bundle.frame(bytes(data))
            rows = [(p, t, bundle.uri, frame, start, size, o, n) for p, t, o, n in held]
            data, held = bytearray(), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for page_id, url, payload, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or Bundle(folder)
                record = record_bytes(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), kind, refers, date)
                if data and len(data) + len(record) > frame_bytes:
                    yield flush()
                    if bundle.bytes >= bundle_bytes:
                        bundle.close()
                        bundle = Bundle(folder)
                held.append((page_id, kind, len(data), len(record)))
                data += record
        if held:
            yield flush()
        if bundle:
            bundle.close()

    columns = [x.split()[0] for x in RECORDS.split(", ")]
    date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())  # one for all records: pages have no time of their own
    return written(records.select(*columns).mapInArrow(write, INDEX), "warc-index")


def read_frames(frames: DataFrame) -> DataFrame:
    """The records (columns READ) of the frames named by bundle, frame, frame_start and frame_bytes, one row a frame."""
    names = [x.split()[0] for x in READ.split(", ")]
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "refers_to", "record_offset") else pa.int32() if n == "frame" else pa.binary() if n == "payload" else pa.string()) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, frame, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = opened(bundle)
                with store.open_input_file(path) as data:
                    data.seek(start)
                    plain = zstandard.ZstdDecompressor().decompress(data.read(size))
                for h, block, _ in parsed(plain):
                    if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != h["WARC-Payload-Digest"].partition(":")[2]:
                        raise ValueError(f"the payload of {h['WARC-Record-ID']} is damaged")
                rows = [(page_of(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], h["WARC-Payload-Digest"].partition(":")[2], page_of(h.get("WARC-Refers-To")), block, bundle, frame, at) for h, block, at in parsed(plain)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return frames.select("bundle", "frame", "frame_start", "frame_bytes").mapInArrow(read, READ)


def bundle_frames(bundles: DataFrame) -> DataFrame:
    """bundle, frame, frame_start, frame_bytes of every frame, from the bundles' own seek tables."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = opened(uri)
                with store.open_input_file(path) as data:
                    rows = [(uri, i, start, packed) for i, (start, packed, _) in enumerate(seek_table(data, data.size()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["bundle", "frame", "frame_start", "frame_bytes"])

    return bundles.select("bundle").mapInArrow(read, "bundle string, frame int, frame_start bigint, frame_bytes bigint")


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the given page_ids: by the index to their frames, each read once, and within them by offset."""
    wanted = index.join(ids.select("page_id").distinct(), "page_id")
    frames = read_frames(wanted.select("bundle", "frame", "frame_start", "frame_bytes").distinct())
    return frames.join(wanted.select("bundle", "frame", "record_offset"), ["bundle", "frame", "record_offset"], "left_semi")


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages as records (columns RECORDS): of equal payloads of at least `least` bytes the largest page_id's is the response.

    Payloads are told by SHA-1. Null html is an empty payload. Null page_ids are never referred to: equal payloads
    that all lack one are all responses. Rows repeated with the largest page_id are responses alike.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    best = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("best"))
    best = written(best, "warc-roles")  # so that both sides of the join are dealt anew and a frequent payload can be split
    rows = rows.join(best, "digest", "left")
    again = F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("best")).alias("refers_to"))


def archived(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes a record per page and reads the archives back: contract columns, url, bundle, frame and record_offset.

    What a response says is taken from its block as read; what a revisit says of its payload is taken from the
    response it refers to, whose digest must be the same. An empty table makes no bundles and no rows.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    index = write_bundles(with_roles(pages, least), folder)
    read = read_frames(bundle_frames(index.select("bundle").distinct()).repartition(partitions(spark), "bundle", "frame"))
    told = read.select("page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "bundle", "frame", "record_offset")
    told = written(told, "warc-read")
    responses = told.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest"), F.col("payload_bytes").alias("of_bytes")).distinct()
    revisits = told.where("record_type = 'revisit'").join(written(responses, "warc-responses"), (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    same = F.when(F.col("of").isNull(), F.raise_error(F.lit("a revisit without its response"))).otherwise(F.col("of_bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "bundle", "frame", "record_offset"]
    return told.where("record_type = 'response'").select(*columns).unionByName(revisits.withColumn("payload_bytes", same.cast("long")).select(*columns))
