"""Media columns: byte payloads kept as lossless WebP pictures, and features computed from the decoded pixels.

Texts become grey pictures 64 samples wide (several pictures in a row above 1 MiB, so that memory stays bounded). The
stored bytes are always decoded again by :mod:`tidewright.llm.webp`; nothing is computed from the original.

Defined results: null and empty texts have a payload of 64 zero bytes; equal texts give equal values; rows are
independent, so repeated rows and any order are fine.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm import webp
from tidewright.llm.common import as_bytes, keyed, map_batches


def padded(raw: bytes) -> bytes:
    """``raw`` and zero bytes up to a positive multiple of 64."""
    return raw + b"\0" * (-len(raw) % webp.WIDTH or (0 if raw else webp.WIDTH))


def feature(samples: bytes) -> str:
    """Height, mean, deviation, entropy and an 8-sample column profile of a decoded picture."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts / len(x)
    mean = float(share @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, float(share @ np.arange(256) ** 2) - mean * mean)))
    known = share[share > 0]
    entropy = max(0.0, float(-(known @ np.log2(known))))
    columns = x.reshape(-1, webp.WIDTH).sum(axis=0, dtype=np.int64).reshape(8, -1).mean(axis=1) / (len(x) // webp.WIDTH)
    return f"h={len(x) // webp.WIDTH};mean={mean:.3f};dev={deviation:.3f};bits={entropy:.3f};cols=" + ",".join(f"{c:.1f}" for c in columns)


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as WebP; ``media`` may go to any table."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x or b"" for x in as_bytes(batch.column(1))]
        media = [webp.store(padded(x)) for x in raw]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
        )

    return map_batches(keyed(df, id_col, text_col), run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(stored: DataFrame) -> DataFrame:
    """Decode the media of :func:`store_media` and describe payload, stored form and pixels."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for media in batch.column(2).to_pylist():
            payload = webp.load(media)
            rows.append(
                (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
            )
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[x.split()[0] for x in FEATURES.split(", ")])

    return map_batches(stored, run, FEATURES)
