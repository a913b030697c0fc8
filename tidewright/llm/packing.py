"""Sequence packing along a space-filling curve.

A document's hashed byte-gram vector is projected to three dimensions; its Hilbert key puts similar documents near each
other on a line. Keys are computed once and written with the texts. The curve is cut into ranges of about equal bytes, by
the bytes of its cells; a cell that holds more than a range (a large group of copies) is dealt to several partitions by
a hash of id and text. Each partition then tokenises its documents in curve order and cuts one continuous stream into
sequences of 1024 ids. What is left at a partition's end is cut into sequences whose lengths are powers of two, which
need no padding at all.

Defined results: null and empty texts are the single end id; strings of special tokens in a text become these tokens'
ids, as in the ``tokenizers`` library; repeated rows are packed as often as they stand; rows of one id but other texts
are packed each for itself; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import BATCH_ROWS, arrow_map, as_bytes, keyed, written

LENGTH, END = 1024, 0
DIMENSIONS, DEPTH, BUCKETS = 3, 10, 4096


# --- tokens ---------------------------------------------------------------------------------------------------------


class Tokens:
    """Ids of a byte-level BPE vocabulary file of the ``tokenizers`` library.

    The merges run in tiktoken, which gives the same ids several times faster; a text that it refuses, or that holds the
    string of a special token, goes to ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        import public_tokenizers

        raw = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        char = {chr(b): b for b in raw} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in raw)}
        added = {x["content"] for x in spec.get("added_tokens", [])}
        self.special = sorted(added)
        ranks = {bytes(char[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in added}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint32)
        if any(x in text for x in self.special):
            return self.reference_ids(text)
        try:
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        except Exception:  # noqa: BLE001  the regex engine's stack on odd texts
            return self.reference_ids(text)

    def reference_ids(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.cache
def tokens(name: str) -> Tokens:
    """One tokenizer a process. ``name``: a path, or the name of a file of the installed public tokenizers."""
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokens(name)


# --- the curve ------------------------------------------------------------------------------------------------------


@functools.cache
def _projection() -> np.ndarray:
    return np.random.default_rng(20240501).choice([-1.0, 1.0], size=(BUCKETS, DIMENSIONS))


def vector(text: bytes | None) -> np.ndarray:
    """The text's hashed four-byte grams, projected to a few dimensions and scaled to unit variance."""
    if not text or len(text) < 4:
        return np.zeros(DIMENSIONS)
    raw = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    gram = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    counts = np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS).astype(float)
    return counts @ _projection() / np.sqrt(counts @ counts)


def hilbert_keys(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n, d) with ``depth`` bits a coordinate (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for k in range(d):
            up = (x[k] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[k]) & p)
            x[0] ^= np.where(up, p, swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, d):
        x[k] ^= x[k - 1]
    t, q = np.zeros_like(x[0]), 1 << (depth - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for k in range(d):
            key = key << 1 | (x[k] >> bit & 1)
    return key


def curve_keys(texts: list[bytes | None]) -> np.ndarray:
    if not texts:
        return np.empty(0, dtype=np.int64)
    points = np.stack([vector(t) for t in texts])
    grid = np.clip((points + 3.0) / 6.0 * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64)
    return hilbert_keys(grid)


# --- packing --------------------------------------------------------------------------------------------------------

PIECE = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())),
]


class Packer:
    """Cuts a stream of documents' ids into sequences; pieces of a sequence are given out when it is full."""

    def __init__(self, first_id: int, length: int = LENGTH) -> None:
        self.sequence, self.length = first_id, length
        self.open: list[tuple[int, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        self.filled = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.length - self.filled]
            self.open.append((doc_id, at, len(ids), part))
            at += len(part)
            self.filled += len(part)
            if self.filled == self.length:
                self._close()

    def _close(self) -> None:
        offset = 0
        for doc_id, start, total, part in self.open:
            self.out.append((doc_id, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, self.sequence, offset, part))
            offset += len(part)
        self.sequence += 1
        self.open, self.filled = [], 0

    def finish(self) -> None:
        """Close what is left as sequences whose lengths are powers of two."""
        rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        k = 0
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            while want:
                doc_id, start, total, part = rest[k]
                took = part[:want]
                self.open.append((doc_id, start, total, took))
                want -= len(took)
                if len(took) == len(part):
                    k += 1
                else:
                    rest[k] = (doc_id, start + len(took), total, part[len(took) :])
            self._close()

    def taken(self, ids: bool) -> pa.RecordBatch:
        rows, self.out = self.out, []
        fields = PIECE if ids else PIECE[:-1]
        columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)]
        return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])


#: Bytes of text that a partition is to hold, and bits of a key that a cell of the curve leaves out.
PART_BYTES, CELL = 12 << 20, 16


def _dealt(on_curve: DataFrame, part_bytes: int) -> DataFrame:
    """The documents (doc_id, text, key) dealt to partitions along the curve, of about ``part_bytes`` each."""
    spark = on_curve.sparkSession
    cell = F.shiftright("key", CELL)
    sizes = on_curve.groupBy(cell.alias("cell")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n"))
    cells = sorted(sizes.collect())  # at most 1 << (DIMENSIONS * DEPTH - CELL)
    rows, at, filled = [], 0, 0
    for number, n in cells:
        parts = max(1, -(-n // part_bytes))
        if filled and filled + n > part_bytes:
            at, filled = at + 1, 0
        rows.append((number, at, parts))
        at, filled = (at + parts, 0) if parts > 1 else (at, filled + n)
    table = spark.createDataFrame(rows, "cell long, base int, parts int")
    mark = F.xxhash64("doc_id", "text")
    part = (F.col("base") + F.pmod(mark, F.col("parts").cast("long"))).cast("int")
    placed = on_curve.withColumn("cell", cell).join(F.broadcast(table), "cell").withColumn("part", part)
    dealt = placed.repartitionById(at + 1, "part")
    return dealt.sortWithinPartitions("key", "doc_id", mark).select("doc_id", "text")


def pack(
    df: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH, keep_ids: bool = True, part_bytes: int = PART_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if kept."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                keys = curve_keys(as_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.int64())], names=["doc_id", "text", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 36, length)
        ids_of = tokens(tokenizer).ids
        end = np.array([END], dtype=np.uint32)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.add(doc_id, np.concatenate((ids_of(text), end)))
                yield packer.taken(keep_ids)
        packer.finish()
        yield packer.taken(keep_ids)

    on_curve = written(arrow_map(keyed(df, id_col, text_col), key, "doc_id long, text string, key long"), "curve")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return arrow_map(_dealt(on_curve, part_bytes), cut, schema + (", ids array<int>" if keep_ids else ""))
