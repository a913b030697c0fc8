"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words feed one automaton. Each document streams through it once; the state tells the longest
suffix of what has been read that occurs in some item. Where that length reaches the window (10 words), or the suffix
holds the whole of a shorter item, the words are hit. Documents never move: the only pass is a map over them.

Defined results: null or empty texts have no words and no hits; items without words are ignored; repeated items all
count; the words of an item without an id are hit like any other's, but it has no name to list; ids are kept as they are,
repeated document rows give one result row each; an empty benchmark hits nothing.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import ALNUM_LOWER, as_bytes, discard, keyed, map_batches, restored, with_rest, written

#: Words of test items that one automaton may hold (some 100 bytes each on the driver and every executor). A larger
#: benchmark goes through the documents block by block; what one block finds is written before the next is collected.
BLOCK_WORDS = 400_000
SPAN_SCHEMA = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII bytes."""
    return text.translate(ALNUM_LOWER).split() if text else []


class ItemAutomaton:
    """Suffix automaton of many word sequences; ``window`` words of an item, or all of a shorter one, make a hit."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        whole: dict[int, list[tuple[int, str]]] = {}
        seen: list[set[str]] = [set()]
        self.shortest = window
        ends: list[tuple[str, list[int]]] = []
        for name, words in items:
            if not words:
                continue
            self.shortest = min(self.shortest, len(words))
            last, path = 0, []
            for word in words:
                last = self._extend(last, self.vocab.setdefault(word, len(self.vocab)))
                path.append(last)
            ends.append((name, [self.vocab[w] for w in words]))
        n = len(self.next)
        order = sorted(range(n), key=self.length.__getitem__)
        #: the ancestor (or self) whose strings include the one of `window` words
        self.at_window = [-1] * n
        for v in order[1:]:
            up = self.link[v]
            if self.length[v] >= window:
                self.at_window[v] = self.at_window[up] if self.length[up] >= window else v
        seen = [set() for _ in range(n)]
        for name, ids in ends:
            v = 0
            if len(ids) < window:
                for w in ids:
                    v = self.next[v][w]
                whole.setdefault(v, []).append((len(ids), name))
                continue
            length = 0
            for w in ids:
                v, length = self.next[v][w], length + 1
                if length >= window:
                    seen[self.at_window[v]].add(name)
        self.items = [tuple(x) for x in seen]
        self.whole: list[tuple[tuple[int, str], ...]] = [()] * n
        for v in order[1:]:
            self.whole[v] = self.whole[self.link[v]] + tuple(whole.get(v, ()))

    def _extend(self, last: int, w: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if w in nexts[last]:
            q = nexts[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        return copy

    def matching_lengths(self, words: list[bytes]) -> list[int]:
        """At each word, the length of the longest suffix read so far that occurs in an item."""
        out, v, n = [], 0, 0
        for word in words:
            w = self.vocab.get(word, -1)
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            v, n = (self.next[v][w], n + 1) if w in self.next[v] else (0, 0)
            out.append(n)
        return out

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (start, end excluded) of hit words, and the items whose windows occur."""
        if len(words) < self.shortest:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        nexts, link, length, window, whole = self.next, self.link, self.length, self.window, self.whole
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < self.shortest:  # a match never holds a word that no item has
                continue
            v = n = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while v and w not in nexts[v]:
                    v = link[v]
                    n = length[v]
                if w in nexts[v]:
                    v, n = nexts[v][w], n + 1
                if n >= window:
                    spans.append((i + 1 - window, i + 1))
                    found.update(self.items[self.at_window[v]])
                for k, name in whole[v]:
                    if k <= n:
                        spans.append((i + 1 - k, i + 1))
                        found.add(name)
        spans.sort()
        merged: list[tuple[int, int]] = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[tuple[list[tuple[str | None, list[bytes]]], bool]]:
    """The items in blocks of bounded size, one collected at a time, and whether it is the last; usually there is one."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / 2 / block_words))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = items.where((part == k) & F.col("text").isNotNull()).collect()
        yield [(r["item"], words_of(r["text"].encode())) for r in rows], k == blocks - 1


def contamination(
    documents: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, keep_text: bool = True,
    carry: bool = False, max_coverage: float | None = None,
) -> DataFrame:
    """Per document: text (null without ``keep_text``), n_words, spans of hit words and the items they come from; with ``carry`` the other columns
    in a struct ``rest``. With ``max_coverage`` the last pass also cuts the spans from the text, and leaves out documents
    over that share of whose words are hit."""
    spark = documents.sparkSession
    source = (with_rest if carry else keyed)(documents, id_col, text_col)
    rest = f", rest {source.schema['rest'].dataType.simpleString()}" if carry else ""
    out = source.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"),
        *(["rest"] if carry else []),
    )
    for block, last in _blocks(benchmark, item_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast(ItemAutomaton(block, window))

        def scan(batch: pa.RecordBatch, shared=shared, last=last) -> pa.RecordBatch:
            automaton = shared.value
            n_words, spans, items = [], [], []
            before = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for text, had, named in zip(as_bytes(batch.column(1)), *before, strict=True):
                words = words_of(text)
                got, found = automaton.hits(words)
                hit = {(x["start"], x["end"]) for x in had} | set(got)
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in _merge(hit)])
                items.append(sorted(x for x in found.union(named) if x is not None))
            if last and max_coverage is not None:
                return _cut(batch, n_words, spans, items, max_coverage)
            text = batch.column(1) if keep_text or not last else pa.nulls(batch.num_rows, pa.string())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), text, pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), *batch.columns[5:]],
                names=batch.schema.names,
            )

        before, out = out, map_batches(out, scan, SPAN_SCHEMA + rest)
        if not last:
            out = written(out, "scanned")
            discard(before)
            shared.destroy()
    return out


def _merge(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(ALNUM_LOWER))]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batch: pa.RecordBatch, n_words: list[int], spans: list[list[dict]], items: list[list[str]], max_coverage: float) -> pa.RecordBatch:
    """The batch without its hit spans and without documents that they cover too far."""
    keep, texts = [], []
    for k, (text, n, hit) in enumerate(zip(batch.column(1).to_pylist(), n_words, spans, strict=True)):
        pairs = [(x["start"], x["end"]) for x in hit]
        if pairs and sum(e - s for s, e in pairs) > max_coverage * n:
            continue
        keep.append(k)
        texts.append(cut_spans(text, pairs) if pairs else text)
    kept = pa.array(keep, pa.int64())
    own = [pa.array([n_words[k] for k in keep], pa.int64()), pa.array([spans[k] for k in keep], _SPANS), pa.array([items[k] for k in keep], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(kept), pa.array(texts, pa.string()), *own, *(c.take(kept) for c in batch.columns[5:])], names=batch.schema.names
    )


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, *, window: int = 10, max_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents' columns: hit spans removed; documents with over ``max_coverage`` of their words hit go."""
    found = contamination(
        documents, benchmark, window=window, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, carry=True,
        max_coverage=max_coverage,
    )
    return restored(found, documents, id_col, text_col)


def _grams(n: int) -> str:
    words = ", ".join(["word", *(f"lead(word, {k}) OVER w" for k in range(1, n))])
    return (
        f"SELECT doc_id, pos, {n} AS n, concat_ws(' ', {words}) AS g, lead(pos, {n - 1}) OVER w AS past FROM t "
        "WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    )


_SQL_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
#: Every n-gram of the documents for the lengths that windows have, joined to the items' windows by text.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
x AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)
),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
p AS ({" UNION ALL ".join(f"SELECT * FROM ({_grams(n)}) WHERE past IS NOT NULL AND EXISTS (SELECT 1 FROM x WHERE n = {n})" for n in range(1, 11))}),
h AS (SELECT p.doc_id, p.pos, p.n, x.item FROM p JOIN x ON p.n = x.n AND p.g = x.g),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
