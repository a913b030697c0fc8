"""SimHash near-duplicates by multi-index hashing.

:func:`fingerprints` makes 64-bit fingerprints (one per lane) from word shingles. :func:`link_fingerprints` finds all
pairs within two bits: each fingerprint is cut into two 32-bit segments, of which one must agree up to one bit, so the
Hamming ball of radius one around each segment (33 keys) is enumerated, table matches are fetched, and complete
distances are verified. A segment value that more than ``HOT`` fingerprints share would give quadratic candidates; the
fingerprints that look there are linked by their shared neighbours at one bit instead (two fingerprints are within two
bits exactly if some 64-bit value is within one bit of both), which is exact, and no group then exceeds 65.

:func:`near_duplicates` serves filtering: the same fingerprints over five-word shingle sets give candidates, and MinHash
bands those that 64-bit fingerprints are too coarse for at a similarity of 0.8; the Jaccard similarity of the sets is
verified, and one document of each group leads.

Defined results: null, empty and word-less texts have fingerprint zero and link like any other; a text of fewer words
than a shingle is one shingle; equal rows have equal results; an empty table gives an empty one. In filtering, texts
without words are nobody's near-duplicates, rows without an id stay and lead nobody, and all rows of an id that follows
another one go.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import as_bytes, hot_join, keyed, map_batches, restored, small_or_shuffled, with_rest, written
from tidewright.llm.components import components

#: Fingerprints that may share a segment value before they are linked by shared neighbours.
HOT = 64
HOT_KEYS = 100_000
#: Ids (eight bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def shingles(text: bytes | None, size: int) -> list[bytes]:
    """Word shingles of the text, A-Z lower-cased, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return []
    return [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def shingle_hashes(text: bytes | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle; the shingles are slices of the words joined by spaces."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - size + 1)
    stops = ends[size - 1 :] - 1 if len(words) >= size else ends[-1:] - 1
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 250):  # counts of a block fit a byte
        counts += np.unpackbits(hashes[k : k + 250].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _spread(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits from each hash."""
    if lane == 0:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * lane & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def fingerprints(df: DataFrame, size: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp0, ...): one signed 64-bit fingerprint a lane."""
    names = [f"fp{k}" for k in range(lanes)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[int]] = [[] for _ in names]
        for text in as_bytes(batch.column(1)):
            hashes = shingle_hashes(text, size)
            for k in range(lanes):
                out[k].append(majority(_spread(hashes, k)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(_signed(x)) for x in out)], names=["doc_id", *names])

    return map_batches(keyed(df, id_col, text_col), run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _segment_keys(fp: Column, ball: bool) -> Column:
    """Keys (segment << 32 | value) of both 32-bit segments, with all values one bit away if ``ball``."""
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    marked = F.shiftleft(F.lit(1).cast("long"), 32)
    both = F.array(low, high.bitwiseOR(marked))
    if not ball:
        return both
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    return F.flatten(F.transform(both, lambda v: F.transform(flips, lambda x: v.bitwiseXOR(x))))


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """From distinct (fp, node): links (a, b) between nodes, of every pair within two bits at least a connecting path."""
    table = fps.select("fp", "node", F.explode(_segment_keys(F.col("fp"), False)).alias("key"))
    # few or no keys are hot, so both sides tell them apart by a small table
    hot_keys = small_or_shuffled(written(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), "hot"), HOT_KEYS)
    probes = fps.select(F.col("fp").alias("p"), F.col("node").alias("a"), F.explode(_segment_keys(F.col("fp"), True)).alias("key"))
    cold = table.join(hot_keys, "key", "left_anti")
    distance = F.bit_count(F.col("p").bitwiseXOR(F.col("fp")))
    near = probes.join(cold, "key").where((F.col("p") < F.col("fp")) & (distance <= 2)).select("a", F.col("node").alias("b"))
    hot = probes.join(hot_keys, "key", "left_semi").select("p", "a").distinct()
    ones = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k))
    around = hot.select("a", F.explode(F.concat(F.array("p"), F.transform(ones, lambda x: F.col("p").bitwiseXOR(x)))).alias("z"))
    stars = around.groupBy("z").agg(F.collect_set("a").alias("all"), F.min("a").alias("a")).where(F.size("all") > 1)  # at most 65
    return near.union(stars.select("a", F.explode("all").alias("b")).where("a <> b")).distinct()


def simhash_components(df: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): fingerprints that differ in at most two bits link; component_id is the smallest
    doc_id reachable."""
    docs = written(fingerprints(df, size, 1, id_col, text_col), "fingerprints").withColumnRenamed("fp0", "fp")
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "distinct")
    found = components(link_fingerprints(fps))
    of = fps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n")
    return hot_join(docs, of, ["fp"], docs.count()).select("doc_id", "fp", "component_id")


# --- filtering ------------------------------------------------------------------------------------------------------

#: Bands of a MinHash signature and values in each: two shingle sets of similarity s share a band with probability
#: 1 - (1 - s**ROWS)**BANDS, which is 0.998 at 0.8 and 0.9999 at 0.87; no pair that shares one is left unverified.
BANDS, ROWS = 16, 5
_MIX = np.array([xxhash.xxh64_intdigest(str(k), 7) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)
#: Shingles whose values under all functions are held at once.
BLOCK = 2048


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of distinct shingle hashes under each of the functions."""
    out = np.full(len(_MIX), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), BLOCK):
        np.minimum(out, (_MIX[:, None] * (hashes[k : k + BLOCK] ^ (_MIX[:, None] >> np.uint64(17)))).min(axis=1), out=out)
    return out


def signatures(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, h1, h2, fp, bands) of (doc_id, text): 128 bits of the shingle set, its SimHash fingerprint and a key of
    each band; texts without words are left out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, whole, prints, bands = [], [], [], []
        for k, text in enumerate(as_bytes(batch.column(1))):
            hashes = np.unique(shingle_hashes(text, size))
            if not len(hashes):
                continue
            least = signature(hashes).reshape(BANDS, ROWS)
            keep.append(k)
            whole.append(xxhash.xxh3_128_intdigest(hashes.tobytes()))
            prints.append(majority(hashes))
            bands.append(_signed([xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least)]))
        halves = [pa.array(_signed([w >> shift & 0xFFFFFFFFFFFFFFFF for w in whole])) for shift in (64, 0)]
        ids = batch.column(0).take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *halves, pa.array(_signed(prints)), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "fp", "bands"])

    return map_batches(df, run, "doc_id long, h1 long, h2 long, fp long, bands array<long>")


def _sets(ids: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, s): the hashed shingles of the texts with these ids (repeats are borne), written."""
    wanted = small_or_shuffled(written(ids.distinct(), "wanted"), BROADCAST_IDS)

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in as_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "s"])

    return written(map_batches(texts.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), sets, "doc_id long, s array<long>"), "sets")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have the Jaccard similarity."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and both >= similarity * (len(x) + len(y) - both):
                keep.append(k)
        return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])

    return map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), compare, "a long, b long")


def _within_two_bits(firsts: DataFrame) -> DataFrame:
    """From (doc_id, fp) of different sets: pairs (a, b), a < b, that connect all sets whose fingerprints differ in at most
    two bits."""
    fps = written(firsts.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "distinct")
    equal = hot_join(firsts.select("fp", F.col("doc_id").alias("b")), fps.where("n > 1"), ["fp"], firsts.count()).where("node < b").select(F.col("node").alias("a"), "b")
    return equal.union(link_fingerprints(fps.select("fp", "node")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _band_keys(firsts: DataFrame) -> DataFrame:
    return firsts.select("doc_id", F.explode("bands").alias("key"))


#: Least sizes of classes of sets whose sizes differ by some 5 %.
_CLASSES = [1]
while _CLASSES[-1] < 1 << 40:
    _CLASSES.append(max(_CLASSES[-1] + 1, _CLASSES[-1] * 21 // 20))


def prefixes(size: int, shared: np.ndarray, similarity: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(own class, partner's class, shingles) by each class of sizes that a similar set may have: of two sets of that
    similarity, one of the shingles of either stands among those of the other.

    ``shared`` are the set's shingles that other sets have, rarest first in an order that all sets agree on; the rest of
    its ``size`` come before them. A partner of ``m`` shingles has at least ``similarity / (1 + similarity) * (size + m)``
    of them, so it cannot miss all of the first ``size`` less that and one more.
    """
    own = bisect_right(_CLASSES, size) - 1
    least, most = math.ceil(similarity * size - 1e-6), math.floor(size / similarity + 1e-6)
    for other in range(bisect_right(_CLASSES, max(1, least)) - 1, bisect_right(_CLASSES, most)):
        both = math.ceil(similarity / (1 + similarity) * (size + max(least, _CLASSES[other])) - 1e-6)
        n = size - both + 1 - (size - len(shared))
        if n > 0:
            yield own, other, shared[:n]


def _candidates(sets: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of sets with different leaders, among them all that have the similarity: by the rarest of
    their shingles (:func:`prefixes`), so that sets which share much, but too little, don't meet."""
    tokens = sets.select("doc_id", F.size("s").alias("size"), F.explode("s").alias("t"))
    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    often = written(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shingles")
    ranked = hot_join(tokens, often, ["t"], total).groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("r"))
    ranked = ranked.join(small_or_shuffled(leaders, BROADCAST_IDS), "doc_id").select("doc_id", "leader", "size", F.col("r.t").alias("r"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, keys, sides = [], [], []
        for k, (size, r) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
            for own, other, some in prefixes(size, r.values.to_numpy(), similarity):
                mark = xxhash.xxh64_intdigest(f"{min(own, other)} {max(own, other)}", 11)
                keys.append(some.view(np.uint64) ^ np.uint64(mark))
                sides.append(np.full(len(some), (own > other) - (own < other), dtype=np.int8))
                at.append(np.full(len(some), k))
        where = pa.array(np.concatenate(at) if at else [], pa.int64())
        columns = [pa.array(np.concatenate(x) if x else np.empty(0, dtype), kind) for x, dtype, kind in (([k.view(np.int64) for k in keys], np.int64, pa.int64()), (sides, np.int8, pa.int8()))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *columns], names=["doc_id", "leader", "key", "side"])

    rows = written(map_batches(ranked, run, "doc_id long, leader long, key long, side byte"), "prefixes")
    split = rows.groupBy("key").agg(F.min("leader").alias("lo"), F.max("leader").alias("hi")).where("lo < hi").select("key")
    rows = written(rows.join(split, "key"), "members")
    # leaders first, so that members of one group don't meet
    groups = rows.select("key", "leader", "side").distinct()
    low = groups.where("side <= 0").select("key", "side", F.col("leader").alias("la"))
    across = low.join(groups.where("side >= 0").select("key", F.col("leader").alias("lb")), "key").where("la < lb OR side < 0 AND la > lb").select("key", "la", "lb")
    left = rows.where("side <= 0").select("key", F.col("leader").alias("la"), F.col("doc_id").alias("x"))
    right = rows.where("side >= 0").select("key", F.col("leader").alias("lb"), F.col("doc_id").alias("y"))
    return across.join(left, ["key", "la"]).join(right, ["key", "lb"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(df: DataFrame, *, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, leader): documents that follow another one, which stays.

    First, equal shingle sets follow their smallest id. Then sets meet whose SimHash fingerprints are within two bits; and,
    as such pairs are a part only of those at the similarity, each set meets the smallest id behind each of its MinHash
    bands, so that large groups of near copies shrink to few leaders without their pairs being made. Last, of all sets
    that share a band but not yet a leader those meet whose rarest shingles allow the similarity, followers included.
    Links hold at a Jaccard similarity of ``similarity``; groups are the components of all of them.
    """
    texts = keyed(df, id_col, text_col).where("doc_id IS NOT NULL")
    prints = written(signatures(texts, size), "prints")
    firsts = prints.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "fp", "bands")).alias("f"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.select("h1", "h2", "f.*", "n"), "firsts")
    several = firsts.where("n > 1").select("h1", "h2", F.col("doc_id").alias("a"), "n")
    same = hot_join(prints.select("h1", "h2", F.col("doc_id").alias("b")), several, ["h1", "h2"], prints.count()).where("a <> b").select("a", "b")

    keys = _band_keys(firsts)
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    shared = written(keys.join(heads, "key"), "keys")
    star = shared.where("a < doc_id").select("a", F.col("doc_id").alias("b"))
    star = written(_within_two_bits(firsts.select("doc_id", "fp")).union(star).distinct(), "candidates")
    links1 = written(_similar(star, _sets(star.select(F.explode(F.array("a", "b")).alias("doc_id")), texts, size), similarity), "links")
    round1 = written(components(links1), "round1")

    members = shared.select("key", "doc_id").join(round1.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    members = written(members.select("key", "doc_id", F.coalesce("component", "doc_id").alias("leader")), "members")
    split = members.groupBy("key").agg(F.min("leader").alias("lo"), F.max("leader").alias("hi")).where("lo < hi").select("key")
    loose = written(members.join(split, "key").select("doc_id", "leader").distinct(), "loose")
    sets = _sets(loose.select("doc_id"), texts, size)
    pairs = written(_candidates(sets, loose, similarity).join(star, ["a", "b"], "left_anti"), "candidates")
    links2 = _similar(pairs, sets, similarity)
    found = components(same.union(links1).union(links2)).where("node <> component")
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("leader"))


def drop_near_duplicates(df: DataFrame, *, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that follow another one; all columns stay."""
    gone = written(near_duplicates(df, size=size, similarity=similarity, id_col=id_col, text_col=text_col).select("doc_id").distinct(), "gone")
    kept = with_rest(df, id_col, text_col).join(small_or_shuffled(gone, BROADCAST_IDS), "doc_id", "left_anti")
    return restored(kept, df, id_col, text_col)
