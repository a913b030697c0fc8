"""WARC bundles in seekable Zstandard.

Records are grouped into independent Zstandard frames; a bundle ends in a skippable frame that holds the seek table
(compressed and decompressed size of each frame) and the format's footer. An index row maps each record to its bundle,
frame, and offset within the decompressed frame, so one record costs one ranged read and one small decompression.

Pages of equal payload share one ``response`` record, that of the largest page_id; the others are ``revisit`` records
without a payload. Writers name files by task attempt and the index comes from committed tasks only, so files of lost
attempts are never read. Workers reach the folder through pyarrow's file systems (local, HDFS, S3, GCS, Azure).

Defined results: null payloads are empty; null URLs are empty; payloads under ``least`` bytes are always stored; rows
that repeat the largest page_id are all responses.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import BATCH_ROWS, arrow_map, as_bytes, shared_dir, small_or_shuffled, written

FRAME_BYTES, BUNDLE_BYTES, LEAST = 1 << 18, 64 << 20, 1000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BROADCAST_DIGESTS = 100_000
#: Records carry the day the format's edition was published, so that equal pages give equal bundles.
DATE = "2017-01-01T00:00:00Z"


# --- records --------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = head + payload if refers_to is None else head
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes | None]:
    """Header fields (lower-case names) and the payload; a revisit has none."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC/1.1 record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if fields["warc-type"] == "revisit":
        return fields, None
    return fields, block.partition(b"\r\n\r\n")[2]


# --- bundles --------------------------------------------------------------------------------------------------------


class BundleWriter:
    """Appends records to a file object; :meth:`add` gives (frame, offset, length)."""

    def __init__(self, out, level: int = 3, frame_bytes: int = FRAME_BYTES) -> None:  # noqa: ANN001
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.open: list[bytes] = []
        self.size = self.written = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, raw: bytes) -> tuple[int, int, int]:
        if self.size and self.size + len(raw) > self.frame_bytes:
            self._close()
        place = (len(self.frames), self.size, len(raw))
        self.open.append(raw)
        self.size += len(raw)
        return place

    def _close(self) -> None:
        packed = self.compressor.compress(b"".join(self.open))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.open, self.size = [], 0

    def finish(self) -> None:
        if self.size:
            self._close()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Random access to the frames of a seekable file."""

    def __init__(self, source) -> None:  # noqa: ANN001
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        entry = 12 if flags & 0x80 else 8
        source.seek(size - 9 - n * entry)
        table = source.read(n * entry)
        self.at, self.sizes, at = [], [], 0
        for k in range(n):
            packed, full = struct.unpack_from("<II", table, k * entry)
            self.at.append((at, packed))
            self.sizes.append(full)
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, n = self.at[k]
            self.source.seek(at)
            self.last = (k, zstandard.ZstdDecompressor().decompress(self.source.read(n), max_output_size=self.sizes[k]))
        return self.last[1]

    def read(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


#: Schemes of Hadoop's connectors that pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pyarrow.fs.FileSystem.from_uri(f"file://{uri}")
    return pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


INDEX = "page_id long, bundle string, frame int, offset long, length long"


def write_bundles(
    pages: DataFrame, folder: str | None = None, *, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Write all pages below ``folder`` (by default one in the shared folder); returns the index."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = source.where(F.octet_length("payload") >= least)
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    first = small_or_shuffled(written(first, "payloads"), BROADCAST_DIGESTS)
    rows = source.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when((F.octet_length("payload") >= least) & (F.col("first") != F.col("page_id")), F.col("first")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        bundle, stream, path, made = None, None, "", 0
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                index = []
                columns = part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist()
                for page_id, url, payload, digest, refers_to in zip(*columns, strict=True):
                    if bundle is None:
                        path = f"{name}-{made:04d}.warc.zst"
                        stream = fs.open_output_stream(f"{root}/{path}", compression=None)
                        bundle, made = BundleWriter(stream), made + 1
                    index.append((page_id, f"{folder}/{path}", *bundle.add(record(page_id, url, payload, digest, refers_to))))
                    if bundle.written > BUNDLE_BYTES:
                        bundle.finish()
                        stream.close()
                        bundle = None
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in index], kind) for c, kind in enumerate(kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        if bundle is not None:
            bundle.finish()
            stream.close()

    return written(arrow_map(rows, run, INDEX), "warc-index")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index: DataFrame) -> DataFrame:
    """Fetch each indexed record from its bundle and describe it; digests are computed from payloads that are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        number = lambda urn: None if urn == "<urn:page:None>" else int(urn[10:-1])
        for batch in batches:
            rows = []
            for bundle, *place in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if bundle != name:
                    fs, path = _open(bundle)
                    name, reader = bundle, BundleReader(fs.open_input_file(path))
                fields, payload = parse(reader.read(*place))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(fields["x-payload-length"])
                if payload is not None:
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"a record of {bundle} is damaged")
                refers_to = fields.get("warc-refers-to")
                rows.append((number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(refers_to) if refers_to else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return arrow_map(index, run, RECORDS)


ORACLE = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= {LEAST} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= {LEAST}
"""
