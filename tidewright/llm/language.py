"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of one to four characters (hashed). The kernel of two texts is the size of
the common set over the geometric mean of both sizes. Nyström landmarks are training texts; one-versus-rest kernel
ridge regression in the landmark space gives a weight matrix, and scoring is two batched matrix products.

Only training is bounded (``train_docs`` labelled texts, ``train_bytes`` of them, and ``landmarks``, in the order of a
hash of the id); scoring reads whole texts in one map over the documents.

Defined results: texts that are null or have no letter are ``und`` with score 0; without training rows all are; equal
texts give equal values; rows without an id are predicted, teach nothing, and their held_out is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import fold, map_batches, single_thread

WIDTH, ORDERS, GROUP = 1 << 14, 4, 128
UNKNOWN = "und"
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of all orders, repeats included."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, mixed = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(min(ORDERS, len(codes))):
        mixed = (mixed[: len(codes) - n] + codes[n:]) * np.uint32(_MULTIPLIERS[n])
        mixed ^= mixed >> np.uint32(15)
        out.append((mixed * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int32)


def presence(texts: list[str]) -> np.ndarray:
    """(n, WIDTH) zeros and ones."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for k, text in enumerate(texts):
        out[k][grams(text)] = 1
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Landmarks (as sets), their sizes, the weights by language, and the languages."""

    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def scores(self, texts: list[str]) -> np.ndarray:
        """(n, languages): probabilities."""
        margins = _kernel(presence(texts), self.landmarks) @ self.weights
        e = np.exp(6 * (margins - margins.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def _kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    common = x @ landmarks.T
    return common / np.sqrt(np.maximum(1, x.sum(axis=1))[:, None] * np.maximum(1, landmarks.sum(axis=1)))


def fit(rows: list[tuple[str, str]], landmarks: int = 96, ridge: float = 1e-3) -> Model | None:
    """Kernel ridge regression on (text, language) rows."""
    rows = [r for r in rows if has_letter(r[0])]
    languages = sorted({r[1] for r in rows})
    if not rows:
        return None
    by = {name: [t for t, x in rows if x == name] for name in languages}
    each = max(1, landmarks // len(languages))
    chosen = presence([t for name in languages for t in by[name][:each]])
    roots, vectors = np.linalg.eigh(_kernel(chosen, chosen).astype(float))
    good = roots > 1e-6
    whiten = vectors[:, good] / np.sqrt(roots[good])
    z = np.concatenate([_kernel(presence([t for t, _ in rows[k : k + GROUP]]), chosen) for k in range(0, len(rows), GROUP)]) @ whiten
    y = np.array([[1.0 if x == name else -1.0 for name in languages] for _, x in rows])
    w = np.linalg.solve(z.T @ z + ridge * len(rows) * np.eye(z.shape[1]), z.T @ y)
    return Model(chosen, (whiten @ w).astype(np.float32), languages)


def train(
    df: DataFrame, usable: Column, *, train_docs: int = 2000, train_bytes: int = 16 << 20, landmarks: int = 96, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> Model | None:
    """Fit on at most ``train_docs`` documents for which ``usable`` holds, and at most ``train_bytes`` of their texts; of
    rows that repeat an id the shortest is learnt from."""
    rows = df.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    # ids and sizes alone are ordered; the texts are fetched after
    heads = rows.select("i", F.octet_length("t").alias("n")).orderBy(F.xxhash64("i"), "i", "n").limit(train_docs).collect()
    size, chosen = 0, {}
    for r in heads:
        if r["i"] in chosen:
            continue
        if chosen and size + r["n"] > train_bytes:
            break
        chosen[r["i"]] = True
        size += r["n"]
    ids = df.sparkSession.createDataFrame([(i,) for i in chosen], rows.select("i").schema)
    one = F.min_by(F.struct("t", "l"), F.struct(F.octet_length("t"), F.xxhash64("t", "l"))).alias("x")
    found = rows.join(F.broadcast(ids), "i", "left_semi").groupBy("i").agg(one).select("i", "x.*").collect()
    found.sort(key=lambda r: (hash_of(r["i"]), r["t"]))
    return fit([(r["t"], r["l"]) for r in found], landmarks)


def hash_of(doc_id: int) -> int:
    return int(doc_id) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def identify(df: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        single_thread()
        own = shared.value
        texts = batch.column(1).to_pylist()
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        wanted = [k for k, t in enumerate(texts) if has_letter(t)] if own else []
        for at in range(0, len(wanted), GROUP):
            part = wanted[at : at + GROUP]
            p = own.scores([texts[k] for k in part])
            best = p.argmax(axis=1)
            for k, b, row in zip(part, best.tolist(), p, strict=True):
                names[k] = own.languages[b]
                scores[k] = min(1.0, float(row[b]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, run, "doc_id long, lang_pred string, score double")


def identify_held_out(df: DataFrame, **limits: int) -> DataFrame:
    """Train on documents outside fold 1 of 3 and predict all: doc_id, held_out, lang_pred, score."""
    model = train(df, fold(F.col("doc_id"), 3) != 1, **limits)
    out = identify(df, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
