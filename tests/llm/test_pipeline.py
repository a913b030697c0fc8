"""The corpus pipeline on documents with planted cases, each stage against what it must do on its own input."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import decontamination, packing, toxicity
from tidewright.llm.common import fold, shared_dir, written

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice(["ka", "lo", "mi", "ren", "tos", "ve", "du", "sha"]) for _ in range(rng.randrange(2, 4))) for _ in range(900)]
INSULTS = ["numbskull", "blockhead", "dimwit"]


def prose(n: int) -> list[str]:
    return [rng.choice(VOCABULARY) for _ in range(n)]


def lines(words: list[str]) -> str:
    return ".\n".join(" ".join(words[k : k + 20]) for k in range(0, len(words), 20)) + "."


@pytest.fixture(scope="module")
def corpus(spark_session: SparkSession, tmp_path_factory) -> tuple[str, dict]:  # noqa: ANN001
    rows, labels, kinds = [], [], {}

    def add(kind: str, text: str | None, toxic: int | None = None) -> int:
        k = len(rows)
        rows.append((k, text, "en", f"src{k % 15}", len(text or "")))
        kinds.setdefault(kind, []).append(k)
        if toxic is not None:
            labels.append((k, 1, toxic))
        return k

    passages = [" ".join(prose(40)) for _ in range(3)]
    for k in range(160):
        add("clean", lines(prose(rng.randrange(60, 200))), 0)
    for k in range(60):
        w = prose(100)
        for _ in range(4):
            w[rng.randrange(100)] = rng.choice(INSULTS)
        add("toxic", lines(w), 1 if k < 50 else None)
    for k in range(30):
        add("footer", lines(prose(80)) + f"\nsubscribe to our letter\n{' '.join(prose(3))}", 0)
    for k in range(5):
        base = prose(300)
        add("leader", lines(base), 0)
        add("copy", lines(base), 0)
        base[150] = "changed"
        add("copy", lines(base))
    for p in passages:
        add("leak", lines(prose(60)) + "\n" + p + "\n" + lines(prose(60)))
        add("all leak", p)
    add("empty", None)
    add("empty", "")
    folder = tmp_path_factory.mktemp("corpus")
    spark_session.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark_session.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark_session.createDataFrame([(k, p) for k, p in enumerate(passages)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), kinds | {"passages": passages, "texts": {r[0]: r[1] for r in rows}}


def test_stages(spark: SparkSession, corpus: tuple[str, dict]) -> None:
    folder, kinds = corpus
    docs: DataFrame = spark.read.parquet(f"{folder}/documents.parquet")
    state: dict[str, dict[int, str]] = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, folder))
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            state[name] = {r["doc_id"]: r["text"] for r in out.collect()}
            assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in out.collect())
        else:
            tokens = {r["doc_id"]: r["doc_tokens"] for r in out.collect()}
            assert set(tokens) == set(state["decontamination"])
        docs = out
    assert not set(kinds["toxic"]) & set(state["toxicity"]), "all toxic documents go"
    clean = set(kinds["clean"] + kinds["footer"])
    assert len(clean & set(state["toxicity"])) >= 0.97 * len(clean)
    kept = state["line_dedup"]
    assert set(kept) == set(state["toxicity"])
    assert not [k for k in kinds["footer"] if "subscribe" in kept.get(k, "")]
    assert all(kept[k] == state["toxicity"][k] for k in kinds["clean"] + kinds["leader"] + kinds["copy"] if k in kept)
    near = state["near_duplicates"]
    assert not set(kinds["copy"]) & set(near) and set(kinds["leader"]) <= set(near) and clean & set(kept) <= set(near)
    done = state["decontamination"]
    assert not set(kinds["all leak"]) & set(done) and set(kinds["leak"]) <= set(done)
    for k, p in zip(kinds["leak"], kinds["passages"], strict=True):
        assert p not in done[k] and len(done[k]) >= len(near[k]) - len(p) - 5
    assert all(done[k] == near[k] for k in near if k in done and k not in kinds["leak"])


def test_run(spark: SparkSession, corpus: tuple[str, dict]) -> None:
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    per = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] == 1024 or r[1] & (r[1] - 1) == 0 for r in per)


def split_words(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())


def near_groups(texts: dict[int, str]) -> dict[int, int]:
    """Every document's smallest id among those linked by a Jaccard similarity of 0.8 on five-word shingles."""
    sets = {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        if w:
            sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    label = {k: k for k in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(label[a], label[b])
            if (label[a], label[b]) != (least, least):
                label[a] = label[b] = least
                changed = True
    return label


def test_run_against_plain_version(spark: SparkSession, corpus: tuple[str, dict]) -> None:
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    scores = toxicity.Scorer(model).scores([t for t, _ in rows.values()])
    texts = {k: t for (k, (t, _)), s in zip(rows.items(), scores, strict=True) if s < 0.5}
    # lines of ten sites, not counting followers among the documents that hold such lines
    site = {k: rows[k][1] for k in texts}
    blank = lambda x: not x.strip(" ")
    lines_of = {k: (t or "").split("\n") for k, t in texts.items()}
    sites: dict[str, set[str]] = {}
    for k, lines in lines_of.items():
        for x in lines:
            sites.setdefault(x, set()).add(site[k])
    wide = {x for x, s in sites.items() if len(s) >= 10 and not blank(x)}
    holders = {k: texts[k] for k, lines in lines_of.items() if wide & set(lines)}
    leaders = near_groups(holders)
    counted = {x: {site[k] for k in holders if leaders[k] == k and x in lines_of[k]} for x in wide}
    gone = {x for x, s in counted.items() if len(s) >= 10}
    texts = {k: t if t is None else "\n".join(x for x in lines_of[k] if x not in gone) for k, t in texts.items()}
    leaders = near_groups({k: t or "" for k, t in texts.items()})
    texts = {k: t for k, t in texts.items() if leaders[k] == k}
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = split_words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    want = {}
    for k, t in texts.items():
        w, hit = split_words(t or ""), set()
        for i in range(len(w) - 9):
            if tuple(w[i : i + 10]) in windows:
                hit.update(range(i, i + 10))
        if 2 * len(hit) > len(w):
            continue
        spans = [(min(g), max(g) + 1) for g in ([x[1] for x in g] for _, g in itertools.groupby(enumerate(sorted(hit)), lambda x: x[1] - x[0]))]
        text = decontamination.cut_spans(t, spans) if spans else t or ""
        want[k] = np.append(packing.tokens("byte_bpe_50k.json").reference_ids(text), 0).astype("<u4")
    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want) and len(want) > 150
    for k, ids in want.items():
        at = 0
        for r in sorted(got[k], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)


def test_run_leaves_little_behind(spark: SparkSession, corpus: tuple[str, dict]) -> None:
    files = Path(shared_dir(spark).removeprefix("file://"))
    before = set(files.iterdir())
    corpus_pipeline.run(spark, corpus[0]).count()
    assert {p.name.split("-")[1] for p in set(files.iterdir()) - before} <= {"stage", "curve"}
