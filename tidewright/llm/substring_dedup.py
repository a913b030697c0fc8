"""Substring deduplication by level-wise doubling of word windows.

A window of ``window`` (50) words is removed from every document but the one with the smallest id. Most windows stand
once, so the work goes by levels, for 50 words of 12, 25 and 50:

1. Each window names one of the windows of half its length in it, the one with the smallest hash, and that one names one
   of the next length below. Equal windows name equal ones, and only few are ever named: one word in thirteen starts a
   named window of 25 words, fewer one of 12.
2. At the shortest length the named windows are aggregated. Those that stand in one document only end here; only where
   one is repeated across documents are the windows of twice the length that named it aggregated in turn, and so on.
3. At full length all windows that named a repeated one are hashed (128 bits) and aggregated to the smallest document.
   A level that no candidate survives ends the search.

Documents with equal word sequences first shrink to the smallest id: the other copies are covered whole if they hold a
window. All keys are aggregated before they are joined, so a passage that a third of the corpus shares is one row a task.

Defined results: null, empty and word-less texts keep zero words; documents under ``window`` words are kept whole; rows
that repeat a doc_id do not remove one another and are each judged by their own text; rows without a doc_id lose nothing
and remove nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import as_bytes, keyed, map_batches, small_or_shuffled, written

WINDOW = 50
#: Covered stretches that may be broadcast (some 16 bytes each, and 50 a document); more are joined by a shuffle.
BROADCAST_RUNS = 500_000
BROADCAST_NAMES = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 14), base, dtype=np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if n <= 1 << 22:  # tables of very long texts aren't kept
            _POWERS[base] = have
    return have[:n]


_WORD = 0xA0761D6478BD642F
#: Words of the shortest windows, at least.
LEAST = 8


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[starts:ends], each mixed with its length."""
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * _powers(base, len(values)))))
    back = _powers(_inverse(base), len(values) + 1)
    return _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _ODD)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def levels(window: int) -> list[int]:
    """Lengths of windows, the full one first, each half of the one before."""
    out = [window]
    while out[-1] // 2 >= LEAST:
        out.append(out[-1] // 2)
    return out if len(out) > 1 else [window, max(1, window // 2)]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    at = np.arange(n)
    return _spans_hash(words, at, at + size, _WORD)


def named(below: np.ndarray, size: int, length: int) -> np.ndarray:
    """For each window of ``size`` words the start of the window of ``length`` words that it names."""
    reach = size - length + 1
    if len(below) < reach:
        return np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(below, reach)
    return view.argmin(axis=1) + np.arange(len(view))


def chain(words: np.ndarray, window: int) -> list[np.ndarray]:
    """Hashes of the named windows of each length below the full one, the longest first; those that stand at one place of
    the lists name each other. Repeats are left out."""
    lengths = levels(window)
    hashes = [window_hashes(words, n) for n in lengths[1:]]
    at = np.unique(named(hashes[0], window, lengths[1]))
    out = [hashes[0][at]]
    for k in range(1, len(hashes)):
        at = named(hashes[k], lengths[k], lengths[k + 1])[at]
        out.append(hashes[k][at])
    _, first = np.unique(out[0], return_index=True)
    return [x[first].view(np.int64) for x in out]


def _survey(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tx, n_words, sha256 of the words, names): chains of named windows."""
    depth = len(levels(window)) - 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, digests = [], []
        names: list[list[np.ndarray]] = [[] for _ in range(depth)]
        for text in as_bytes(batch.column(2)):
            words = text.split() if text else []
            n_words.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            found = chain(word_hashes(words), window) if len(words) >= window else [np.empty(0, dtype=np.int64)] * depth
            for k, x in enumerate(found):
                names[k].append(x)
        columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(digests, pa.string()), *(pa.array(x, pa.list_(pa.int64())) for x in names)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tx", "n_words", "digest", *(f"names{k}" for k in range(depth))])

    return map_batches(docs, run, "doc_id long, tx long, n_words long, digest string, " + ", ".join(f"names{k} array<long>" for k in range(depth)))


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, tx, z): texts under Zstandard, to be moved."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        packed = pa.array([pack(t or b"") for t in as_bytes(batch.column(2))], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "tx", "z"])

    return map_batches(docs, run, "doc_id long, tx long, z binary")


def _stretches(covered: DataFrame, window: int) -> DataFrame:
    """(doc_id, tx, first, past): word numbers where covered stretches start and end, from the starts of windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, past = [], []
        for starts in batch.column(2):
            at = np.sort(starts.values.to_numpy())
            breaks = np.flatnonzero(np.diff(at) > window)
            first.append(at[np.concatenate(([0], breaks + 1))])
            past.append(at[np.concatenate((breaks, [len(at) - 1]))] + window)
        columns = [batch.column(0), batch.column(1), pa.array(first, pa.list_(pa.int32())), pa.array(past, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tx", "first", "past"])

    rows = covered.groupBy("doc_id", "tx").agg(F.collect_set("at").alias("starts"))
    return map_batches(rows, run, "doc_id long, tx long, first array<int>, past array<int>")


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """(doc_id, tx, at, h1, h2) of the full windows that named a repeated window."""
    length = levels(window)[1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for doc_id, tx, z, keys in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
            words = word_hashes(unpack(z).split())
            half = window_hashes(words, length)
            at = np.flatnonzero(np.isin(half[named(half, window, length)], keys.values.to_numpy().view(np.uint64)))
            h1, h2 = (_spans_hash(x, at, at + window, _WORD).view(np.int64) for x in (words, _mix(words ^ _ODD)))
            for part, x in zip(parts, (np.full(len(at), doc_id), np.full(len(at), tx), at, h1, h2), strict=True):
                part.append(x)
        kinds = (np.int64, np.int64, np.int32, np.int64, np.int64)
        columns = [np.concatenate(x).astype(t) if x else np.empty(0, dtype=t) for x, t in zip(parts, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "tx", "at", "h1", "h2"])

    return map_batches(candidates, run, "doc_id long, tx long, at int, h1 long, h2 long")


def repeated_windows(docs: DataFrame, survey: DataFrame, window: int) -> DataFrame | None:
    """(doc_id, tx, first, past): stretches of windows that start in a smaller document too, among ``survey``'s documents;
    none if the candidates of some level end there."""
    depth = len(levels(window)) - 1
    rows = survey.where(F.size("names0") > 0)
    names = rows.select("doc_id", "tx", F.explode(F.arrays_zip(*(f"names{k}" for k in range(depth)))).alias("n")).select("doc_id", "tx", "n.*")
    for k in reversed(range(depth)):
        spread = names.groupBy(f"names{k}").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(f"names{k}")
        # written, so that a join has plain shuffles on both sides, whose hot keys Spark can split
        repeated = written(spread, "names")
        if repeated.isEmpty():
            return None
        names = names.join(small_or_shuffled(repeated, BROADCAST_NAMES), f"names{k}", "left_semi")
    wanted = names.groupBy("doc_id", "tx").agg(F.collect_set("names0").alias("names"))
    windows = written(_windows(_packed(docs).join(wanted, ["doc_id", "tx"]).select("doc_id", "tx", "z", "names"), window), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    covered = windows.join(written(first, "firsts"), ["h1", "h2"]).where("doc_id > lo").select("doc_id", "tx", "at")
    return _stretches(covered, window)


def _kept(text: bytes, first: np.ndarray, past: np.ndarray) -> tuple[list[bytes], int]:
    words = text.split()
    out, at = [], 0
    for a, b in zip(first.tolist(), past.tolist(), strict=True):
        out += words[at:a]
        at = b
    return out + words[at:], len(words)


def dedup_substrings(df: DataFrame, *, window: int = WINDOW, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text): kept words joined by spaces; text is null without ``keep_text``."""
    # a row is known by its id and a hash of its text: rows that agree in both have the same result
    docs = keyed(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tx"), "text")
    survey = written(_survey(docs, window), "survey")
    firsts = survey.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    of_firsts = survey.join(firsts, ["doc_id", "digest"], "left_semi")
    kind = "text string, " if keep_text else ""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, removed, digests = [], [], []
        for text, first, past in zip(as_bytes(batch.column(2)), batch.column(3), batch.column(4), strict=True):
            kept, total = _kept(text, first.values.to_numpy(), past.values.to_numpy())
            texts.append(b" ".join(kept).decode())
            removed.append(total - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        out = [batch.column(0), batch.column(1), *([pa.array(texts, pa.string())] if keep_text else []), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "tx", *(["text"] if keep_text else []), "n_removed", "sha"])

    # a document that is no first of its word sequence is covered whole
    rows = survey.select("doc_id", "tx", "n_words", "digest").join(firsts.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
    found = repeated_windows(docs, of_firsts, window)
    if found is None:
        rows = rows.withColumns({"n_removed": F.lit(None).cast("long"), "sha": F.lit(None).cast("string"), "cut_text": F.lit(None).cast("string")})
    else:
        runs = written(found, "runs")
        # the size of the stretches decides how their texts are found
        size = runs.agg(F.sum(F.size("first") + 3)).first()[0] or 0
        hit = docs.join(F.broadcast(runs) if size <= BROADCAST_RUNS else runs, ["doc_id", "tx"]).select("doc_id", "tx", "text", "first", "past")
        changed = map_batches(hit, cut, f"doc_id long, tx long, {kind}n_removed long, sha string")
        if keep_text:
            changed = changed.withColumnRenamed("text", "cut_text")
        rows = rows.join(changed.dropDuplicates(["doc_id", "tx"]), ["doc_id", "tx"], "left")
    whole = (F.col("n_words") >= window) & F.col("first").isNull() & F.col("doc_id").isNotNull()
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = rows.select(
        "doc_id", "tx", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, none).otherwise(F.coalesce("sha", "digest")).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("cut_text")).alias("cut_text")] if keep_text else []),
    )
    if not keep_text:
        return out.drop("tx")
    plain = F.trim(F.regexp_replace(F.coalesce("d.text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    same = F.col("o.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("o.tx") == F.col("d.tx"))
    joined = out.alias("o").join(docs.dropDuplicates(["doc_id", "tx"]).alias("d"), same, "left")
    return joined.select("o.doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce("cut_text", plain).alias("text"))


#: Windows of words whose sequence also starts in a document with a smaller id, by their text.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
g AS (
  SELECT doc_id, pos, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h,
    count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n
  FROM t
),
f AS (SELECT h, min(doc_id) AS lo FROM g WHERE n = 50 GROUP BY h HAVING min(doc_id) < max(doc_id)),
s AS (SELECT g.doc_id, g.pos FROM g JOIN f ON g.h = f.h WHERE g.n = 50 AND g.doc_id > f.lo),
c AS (SELECT t.*, max(s.pos) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM t LEFT JOIN s ON t.doc_id = s.doc_id AND t.pos = s.pos),
k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
