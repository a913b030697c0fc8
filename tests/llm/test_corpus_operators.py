"""Each operator against a brute-force version, over texts with every awkward case."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import (
    common,
    decontamination,
    language,
    licenses,
    line_dedup,
    media,
    packing,
    queries,
    simhash,
    substring_dedup,
    toxicity,
    warc,
    webp,
)

SMALL = "/root/testdata/sf0.001"
rng = random.Random(5)
WORDS = ["the", "of", "Harbour", "tide", "stone", "ring", "éclat", "wind", "Ömer", "x1"]


def prose(n: int, words: list[str] = WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


PASSAGE, BASE = prose(60), prose(300)
BASE_WORDS = BASE.split()
TEXTS = [
    None, "", "   \n\t ", "one", "two words", BASE, BASE, BASE.upper(), " ".join([*BASE_WORDS[:150], "changed", *BASE_WORDS[151:]]), PASSAGE, prose(20) + " " + PASSAGE + " " + prose(30),
    prose(5) + "\n" + PASSAGE, prose(49), prose(50), "%%% *** !!!", "a" * 3000, prose(20_000), "line\n\nline\nother line\n", " words apart ", "<|endoftext|> \x00\x01 odd",
    "Licensed under the MIT License. CC-BY-NC 4.0; Apache License, Version 2.0", "cc by nc cc by nc", PASSAGE, prose(300),
]


@pytest.fixture(scope="module")
def docs(spark_session: SparkSession) -> DataFrame:
    rows = [(k, t, ["en", "de", None][k % 3], f"src{k % 4}", None if t is None else len(t)) for k, t in enumerate(TEXTS)]
    rows.append(rows[9])  # a repeated row
    # names that the operators use inside, too
    df = spark_session.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"key": F.lit(1), "component_id": F.lit("x"), "rest": F.lit("r"), "n_words": F.lit(2.0), "fp": F.lit(0), "_id": F.lit(7)})


@pytest.fixture(scope="module")
def empty(docs: DataFrame) -> DataFrame:
    return docs.where("false")


def rows_of(df: DataFrame, key: str = "doc_id") -> dict:
    out = {}
    for r in df.collect():
        d = r.asDict()
        k = d.pop(key)
        assert out.setdefault(k, d) == d, f"repeated rows differ: {k}"
    return out


# --- 1


def fingerprint(text: str | None, size: int = 3) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict[int, int], radius: int = 2) -> dict[int, int]:
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if label[b] < label[a] and bin(fps[a] ^ fps[b]).count("1") <= radius:
                    label[a], changed = label[b], True
    return label


def test_simhash(docs: DataFrame) -> None:
    got = rows_of(simhash.simhash_components(docs))
    fps = {k: fingerprint(t) for k, t in enumerate(TEXTS)}
    assert {k: v["fp"] & (2**64 - 1) for k, v in got.items()} == fps
    assert {k: v["component_id"] for k, v in got.items()} == brute_components(fps)


@pytest.mark.parametrize("hot", [1, 64])
def test_links_of_chains_and_hot_segments(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, hot: int) -> None:
    monkeypatch.setattr(simhash, "HOT", hot)
    if hot == 1:  # so that stars go by the broadcast of their centres
        monkeypatch.setattr(common, "HOT_ROWS", 4)
        monkeypatch.setattr(common, "FEW_ROWS", 0)
    random.seed(3)
    fps = [random.getrandbits(64) for _ in range(40)]
    for k in range(60):  # chains, and many that share a half
        fps.append(fps[k] ^ 1 << random.randrange(64) ^ 1 << random.randrange(64))
    fps += [(fps[0] & 0xFFFFFFFF) | random.getrandbits(32) << 32 for _ in range(30)]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), k) for k, f in enumerate(fps)], "fp long, node long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.link_fingerprints(df)).collect()}
    want = {k: c for k, c in brute_components(dict(enumerate(fps))).items()}
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert found == {k: c for k, c in want.items() if sizes[c] > 1}


def test_components_of_a_large_star(spark: SparkSession) -> None:
    links = [(5000, k) for k in range(1000, 1900)] + [(k, k + 1) for k in range(30)] + [(1899, 30), (7000, 7001), (7, 7), (7001, 7000), (None, 3)]
    found = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in [5000, *range(1000, 1900), *range(31)]} | {7000: 7000, 7001: 7000}


def test_empty_tables_and_missing_ids(empty: DataFrame, spark: SparkSession) -> None:
    assert simhash.simhash_components(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.held_out_scores(empty, labels).count() == 0 and licenses.report(empty).count() == 0
    text = prose(80, [f"w{k}" for k in range(300)])
    df = spark.createDataFrame([(None, text), (None, text), (4, text), (2, text), (2, "other words"), (7, "")], "doc_id long, text string")
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in simhash.drop_near_duplicates(df).collect())
    assert kept == sorted([(-1, text), (-1, text), (2, text), (2, "other words"), (7, "")])


def test_near_duplicates_keep_one_of_each_group(docs: DataFrame) -> None:
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    gone = set(range(len(TEXTS))) - kept
    assert gone == {6, 8, 11, 22}, gone  # equal, one word changed, the passage with a few words more, equal passage
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_many_near_copies_have_one_leader(spark: SparkSession) -> None:
    words = prose(400, [f"w{k}" for k in range(900)]).split()
    rows = []
    for k in range(60):
        own = list(words)
        for _ in range(2):
            own[rng.randrange(400)] = f"new{k}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, prose(400, [f"z{k}_{j}" for j in range(50)])) for k in range(20)]
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left >= {100 + k for k in range(20)}
    assert len(left) <= 22


def changed(words: list[str], at: int, n: int, mark: str) -> list[str]:
    return [*words[:at], *(f"{mark}{k}" for k in range(n)), *words[at + n :]]


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = (set(zip(*(w[k:] for k in range(5)), strict=False)) for w in (a, b))
    return len(x & y) / len(x | y)


def test_links_through_followers_hold(spark: SparkSession) -> None:
    rows, want = [], set()
    for k in range(150):
        first = [f"c{k}w{j}" for j in range(400)]
        middle = changed(first, 20, 34, f"m{k}x")
        last = changed(middle, 200, 34, f"l{k}x")
        assert jaccard(first, middle) >= 0.8 <= jaccard(middle, last) and jaccard(first, last) < 0.8
        rows += [(1000 + 3 * k + n, " ".join(w)) for n, w in enumerate((first, middle, last))]
        # smaller ids that share buckets with the middle, but aren't near any
        near = [changed(middle, at, 150, f"u{k}x{at}") for at in (100, 240)]
        assert max(jaccard(n, w) for n in near for w in (first, middle, last, near[0] if n is near[1] else [])) < 0.8
        rows += [(2 * k + n, " ".join(w)) for n, w in enumerate(near)]
        want |= {1001 + 3 * k, 1002 + 3 * k}
    gone = {r["doc_id"]: r["leader"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(gone) <= want and len(want) - len(gone) <= 2
    assert all(leader in (1000 + (i - 1000) // 3 * 3, i - 1) for i, leader in gone.items())


@pytest.mark.parametrize(("words", "least"), [(38, 0.8), (27, 0.85), (16, 0.9)])
def test_recall_by_similarity(spark: SparkSession, words: int, least: float) -> None:
    rows = []
    for k in range(400):
        first = [f"p{k}w{j}" for j in range(400)]
        second = changed(first, rng.randrange(10, 340), words, f"q{k}x")
        assert least <= jaccard(first, second) < least + 0.02
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(second))]
        rows.append((1000 + k, " ".join(changed(first, 100, 60, f"r{k}x"))))  # under 0.8
    gone = {r["doc_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone <= set(range(1, 800, 2)) and len(gone) >= 0.98 * 400


def test_fingerprints_give_near_duplicates_of_their_own(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(simhash, "_band_keys", lambda firsts: firsts.select("doc_id", F.lit(0).cast("long").alias("key")).where("false"))
    rows = {}
    for k in range(60):
        first = prose(500, [f"s{k}w{j}" for j in range(400)]).split()
        rows[2 * k], rows[2 * k + 1] = " ".join(first), " ".join(changed(first, 250, 1, "y"))
    fps = {k: simhash.majority(np.unique(simhash.shingle_hashes(t.encode(), 5))) for k, t in rows.items()}
    want = {k + 1: k for k in rows if k % 2 == 0 and bin(fps[k] ^ fps[k + 1]).count("1") <= 2}
    assert len(want) >= 20
    gone = simhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["leader"] for r in gone} == want


def test_sets_that_share_much_but_too_little_do_not_all_meet(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    counts = []
    compare = simhash._similar

    def counted(pairs: DataFrame, *others) -> DataFrame:  # noqa: ANN002
        counts.append(pairs.count())
        return compare(pairs, *others)

    monkeypatch.setattr(simhash, "_similar", counted)
    words = [f"b{j}" for j in range(400)]
    rows = [(k, " ".join(changed(words, 20 + k % 300, 60, f"u{k}x"))) for k in range(300)]  # about 0.7 of each other at most
    rows += [(1000 + k, " ".join(changed(words, k, 4, f"v{k}x"))) for k in range(200)]
    gone = {r["doc_id"]: r["leader"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(gone.get(k) == 1000 for k in range(1001, 1200)) and not [k for k in gone if k < 1000]
    assert sum(counts) <= 30 * len(rows), counts


def test_prefixes_hold_a_shingle_of_every_similar_pair() -> None:
    random.seed(5)
    for _ in range(3000):
        size, similarity = random.choice([3, 7, 20, 60, 200]), random.choice([0.5, 0.8, 0.9])
        x = set(random.sample(range(size * 3), size))
        y = set(random.sample(sorted(x), random.randrange(size // 2, size + 1))) | {10_000 + k for k in range(random.randrange(1 + size // 3))}
        if len(x & y) < similarity * len(x | y):
            continue
        seen = []
        for one, other in ((x, y), (y, x)):
            shared = np.array(sorted(k for k in one if k in other or k % 3), dtype=np.int64)  # some are held by third sets
            seen.append({(min(a, b), max(a, b), k) for a, b, some in simhash.prefixes(len(one), shared, similarity) for k in some.tolist()})
        assert seen[0] & seen[1], (len(x), len(y), len(x & y))


# --- 2


def test_toxicity(spark: SparkSession) -> None:
    insults = ["blockhead", "numbskull", "dimwit"]
    clean = [f"{prose(12)}. {prose(10)}." for _ in range(120)]
    bad = [f"{prose(8)} {rng.choice(insults)} {prose(3)} {rng.choice(insults)}. {prose(9)}." for _ in range(60)]
    rows = [(t, 0) for t in clean] + [(t, 1) for t in bad]
    model = toxicity.fit(rows)
    score = toxicity.Scorer(model).scores
    assert min(score(["what a blockhead and dimwit", "such a b.l.o.c.k.h.e.a.d and dimwiit"])) > 0.5
    assert max(score(["the tide of wind", "", None, "???"])) < 0.5
    assert toxicity.fit([("a", 0)]) is None
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)] + [(900, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    got = rows_of(toxicity.held_out_scores(df, labels))
    right = [got[k]["predicted"] == y for k, (_, y) in enumerate(rows) if got[k]["held_out"]]
    assert sum(right) >= 0.9 * len(right) and len(got) == len(rows) + 2
    assert all(v["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in got.items())
    assert {v["score"] for v in rows_of(toxicity.held_out_scores(df, labels.where("false"))).values()} == {0.0}
    kept = toxicity.drop_toxic(df.withColumn("score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "score"] and 0 < kept.count() < df.count()


def test_subsequence_kernel_is_exact() -> None:
    def brute(word: str) -> dict[str, float]:
        s, out = f"<{word}>", defaultdict(float)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    words = ["banana", "scum", "s.cum", "é", "", "aaaaaaa"]
    number, _, weight, norms = toxicity.subsequences(words)
    for n, word in enumerate(words):
        want = sorted(brute(word).values())
        assert np.allclose(sorted(weight[number == n]), want)
        assert np.isclose(norms[n], np.sqrt(np.sum(np.square(want))) or 1.0)


@pytest.fixture(scope="module")
def insulted() -> list[tuple[str, int]]:
    own = random.Random(8)
    some = lambda n: " ".join(own.choice(WORDS) for _ in range(n))
    rows = [(f"{some(12)}. {some(10)}.", 0) for _ in range(120)]
    return rows + [(f"{some(8)} {own.choice(['blockhead', 'numbskull', 'dimwit'])} {some(3)} {own.choice(['blockhead', 'numbskull', 'dimwit'])}. {some(9)}.", 1) for _ in range(60)]


def test_toxicity_reads_the_whole_of_long_runs(insulted: list[tuple[str, int]]) -> None:
    score = toxicity.Scorer(toxicity.fit(insulted)).scores
    around = "harbour", "stone", "wind", "tide", "ring"
    for sign in ",/|-_":
        run = sign.join([*around, "blockhead", "numbskull", *around])
        assert len(run) > toxicity.LONGEST and score([run])[0] > 0.5 > score([sign.join([*around, *around, *around])])[0], sign
    assert score(["harbour" * 6 + "blockhead" + "stone" * 6])[0] > 0.5 > score(["harbour" * 6 + "stone" * 9])[0]
    # no spaces, other full stops
    plain = "今天天气很好我们去海边看船和灯塔然后回家吃饭看书睡觉"
    rows = [(f"{plain[k % 9:]}，{plain}。{plain[::-1]}。", 0) for k in range(60)] + [(f"{plain[k % 9:]}，大笨蛋王八，{plain}。", 1) for k in range(40)]
    score = toxicity.Scorer(toxicity.fit(rows)).scores
    assert score([f"{plain}{plain}，大笨蛋王八，{plain}{plain}。"])[0] > 0.5 > score([f"{plain}{plain}，{plain}{plain}。"])[0]


def test_toxicity_joins_spaced_words(insulted: list[tuple[str, int]]) -> None:
    score = toxicity.Scorer(toxicity.fit(insulted)).scores
    for text in ("what b l o c k h e a d", "such a b l o c k h e a d of the wind", "a num bsk ull", "the block head", "n u m b s k u l l"):
        assert score([text])[0] > 0.5, text
    assert max(score(["the tide of a w i n d", "a b c d e f g h", "the ring of the tide of the sea"])) < 0.5


def plain_kernel(a: str, b: str) -> float:
    def weights(word: str) -> dict[str, float]:
        s, out = f"<{word}>", defaultdict(float)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    norm = lambda z: math.sqrt(sum(v * v for v in z.values())) or 1.0
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / norm(x) / norm(y)


def plain_scores(model: toxicity.Model, texts: list[str]) -> list[float]:
    """The document scores by loops over sentences, tokens and landmarks."""
    triples = {m[k : k + 3] for m in (f"<{w}>" for w in model.landmarks.words) for k in range(len(m) - 2)}

    @functools.cache
    def one(word: str) -> float:
        near = [plain_kernel(word, w) for w in model.landmarks.words]
        return sum(c * x**toxicity.POWER for c, x in zip(model.weights.tolist(), near, strict=True) if x >= toxicity.NEAR)

    def margin(word: str) -> float:
        bare = "".join(filter(str.isalnum, word))
        return one(word) if bare == word else max(one(word), one(bare))

    held = lambda x: sum(x[k : k + 3] in triples for k in range(len(x) - 2))
    out = []
    for text in texts:
        sums = []
        for part in toxicity._SENTENCE.split(text):
            words = [toxicity.token(w) for w in part.split()]
            if not words:
                continue
            gains = [0.0]
            for a, b in zip(words, words[1:], strict=False):
                whole = f"<{a}{b}>"
                across = a and b and whole[len(a) - 1 : len(a) + 2] in triples and whole[len(a) : len(a) + 3] in triples
                if across and 2 * held(whole) >= len(a) + len(b):
                    gains.append(margin(a + b) - max(0.0, margin(a)) - max(0.0, margin(b)))
            for size in (1, toxicity.SHORT):
                for few, group in itertools.groupby(words, key=lambda w, size=size: len(w) <= size):
                    run = list(group)
                    if few and len(run) > 1 and "".join(run):
                        joined = "".join(run)
                        forms = [joined] if len(joined) <= toxicity.PIECES[-1] else toxicity._pieces(joined)
                        own = sum(max(0.0, margin(w)) for w in run)
                        gains += [margin(x) - own for x in forms if size == 1 or 2 * held(x) >= max(1, len(x) - 2)]
            sums.append(sum(map(margin, words)) + max(gains) + model.bias)
        strongest, all_of_them = toxicity.evidence(sums or [model.bias])
        out.append(1 / (1 + math.exp(-float(model.curve @ [strongest, all_of_them, 1.0]))))
    return out


def test_toxicity_scores_against_plain_loops(insulted: list[tuple[str, int]]) -> None:
    model = toxicity.fit(insulted)
    texts = [t for t, _ in insulted[:25] + insulted[-25:]] + ["", "???", "b l o c k h e a d", "a num bsk ull of the sea. block head", "Dim-wit! d.i.m.w.i.t", "numbskul blockheaad dimmwit tide"]
    want = plain_scores(model, texts)
    assert np.allclose(toxicity.Scorer(model).scores(texts), want, atol=1e-4) and min(want) < 0.3 < 0.7 < max(want)


def test_toxicity_training_is_the_same_over_a_cluster(spark: SparkSession, insulted: list[tuple[str, int]]) -> None:
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(insulted)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(insulted)], "doc_id long, toxic int")
    a, b = toxicity.train(df, labels, F.lit(True)), toxicity.fit(insulted)
    assert sorted(a.landmarks.words) == sorted(b.landmarks.words) and np.isclose(a.bias, b.bias, atol=1e-3) and np.allclose(a.curve, b.curve, atol=1e-2)
    few = toxicity.train(df, labels, F.lit(True), train_docs=60)
    less = toxicity.train(df, labels, F.lit(True), train_bytes=4000)
    assert few is not None and less is not None and toxicity.train(df, labels, F.lit(True), train_docs=0) is None
    for model in (few, less):
        assert model.landmarks.words != a.landmarks.words


# --- 3


def test_licenses(docs: DataFrame) -> None:
    got = rows_of(licenses.report(docs))
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = [(label, re.compile(f" (?:{x})(?= )", re.A), p, w) for label, _, x, p, w in licenses.rules()]
    for k, text in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        padded = f" {' '.join(words)} "
        found = [(padded.count(" ", 0, m.start()), padded.count(" ", 0, m.end()), label, p, w) for label, rx, p, w in rules for m in rx.finditer(padded)]
        kept = [d for d in found if d[3] == 0 or not any(o[0] <= d[0] and o[1] >= d[1] and (o[3] < d[3] or (o[3] == d[3] and o[1] - o[0] > d[1] - d[0])) for o in found)]
        assert got[k] == {
            "n_words": len(words), "n_base": len(places), "first_word": min((i for i, _ in places), default=None), "last_word": max((i for i, _ in places), default=None),
            "base_labels": ",".join(sorted({x for _, x in places})), "labels": ",".join(sorted({d[2] for d in kept})), "score": max((d[4] for d in kept), default=0.0),
        }, k
    assert got[20]["base_labels"] == "apache-2,cc-by-nc,mit" and got[21]["n_base"] == 2


def test_licenses_with_very_many_places(spark: SparkSession) -> None:
    text = " ".join(["cc by nc", "under the mit license x"][k % 7 == 3] for k in range(50_000))
    words = text.split()
    places = [i for phrase, _ in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    got = rows_of(licenses.report(spark.createDataFrame([(1, text)], "doc_id long, text string")))[1]
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(words), len(places), min(places), max(places))
    assert got["labels"] == "cc-by-nc,mit" and len(places) == 50_000
    assert licenses.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_license_rule_passes_the_gate() -> None:
    for _, keyword, expression, _, _ in licenses.rules():
        plain = re.sub(r"\(\?:([^|()]*)[^()]*\)\??", r"\1", expression)
        assert any(stem in expression or stem in plain or stem in keyword for stem in licenses.STEMS), expression


def shortest(parts: list) -> list[str]:
    """Shortest matches of a parsed expression, one for each choice of alternatives."""
    out = [""]
    for op, value in parts:
        match str(op):
            case "LITERAL":
                more = [chr(value)]
            case "IN":
                more = [chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])]
            case "BRANCH":
                more = [x for part in value[1] for x in shortest(part)]
            case "SUBPATTERN":
                more = shortest(value[-1])
            case _:
                assert str(op) == "MAX_REPEAT", op
                more = [""] if value[0] == 0 else [x * value[0] for x in shortest(value[2])]
        out = [a + b for a in out for b in more]
    return out


def test_every_license_alternative_holds_its_keyword(spark: SparkSession) -> None:
    for label, keyword, expression, _, _ in licenses.rules():
        for text in shortest(re._parser.parse(expression)):
            assert re.fullmatch(expression, text) and keyword in text and any(stem in f"{text} " for stem in licenses.STEMS), (label, keyword, text)
    texts = {
        "Licensed under the ODbL 1.0": "odbl-1", "SSPL license": "sspl-1", "released under the PSF license": "python-2",
        "under the terms; Open Software 3.0 license": "osl-3", "Open Software License 3.0 license": "osl-3", "Open Database License": "odbl-1",
    }
    got = rows_of(licenses.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[k]["labels"] for k in range(len(texts))] == list(texts.values())


# --- 4


def test_line_dedup(spark: SparkSession) -> None:
    rows = [(k, f"own {k}\nfooter line\nend {k}", f"s{k % 12}") for k in range(40)]
    rows += [(100 + k, "copied one\ncopied two\ncopied three", f"s{k}") for k in range(12)]  # copies: one context
    rows += [(200 + k, f"rare {k}\nfew sites", f"s{k % 9}") for k in range(30)]
    rows += [(300, None, "s1"), (301, "", "s2"), (302, "footer line", None), (303, "\n\n  \n", "s3"), (300, None, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(line_dedup.drop_boilerplate(df.withColumns({"n_lines": F.lit("z"), "r": F.lit(1), "parts": F.lit("p")})).select("doc_id", "text", "n_lines", "n_removed"))
    assert got[0] == {"text": "own 0\nend 0", "n_lines": 3, "n_removed": 1}
    assert got[100]["n_removed"] == 0 and got[200]["n_removed"] == 0
    assert got[300] == {"text": None, "n_lines": 0, "n_removed": 0} and got[302]["text"] == "" and got[303]["n_removed"] == 0
    assert line_dedup.drop_boilerplate(df.where("false")).count() == 0


def test_lines_inside_fixed_blocks_go(spark: SparkSession) -> None:
    rows = [(k, f"own {k}\nMenu A\nMenu B\nMenu C", f"s{k}") for k in range(20)]
    # a repeated id: each row loses its own lines only
    rows += [(3, "Menu B\nanother text\nand me", "s3"), (3, "first\nsecond\nMenu A", "s3"), (None, "Menu C\nno id", "s1"), (None, "keep\nthis", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.drop_boilerplate(df).collect())
    want = [(k or -1, f"own {k}") for k in range(20)] + [(3, "another text\nand me"), (3, "first\nsecond"), (-1, "no id"), (-1, "keep\nthis")]
    assert got == sorted(want)


def test_line_dedup_equals_its_sql(spark: SparkSession) -> None:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = {tuple(r) for r in queries.op4_line_dedup(spark, SMALL).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()}
    assert got == set(con.sql(queries.ORACLES["op4_line_dedup"]).fetchall())


def test_line_dedup_counts_blocks_and_spares_near_copies(spark: SparkSession) -> None:
    menu = "home page\nour products\nabout us all\ncontact form"
    rows = [(k, f"{menu}\n{' '.join(f'own{k}w{j}' for j in range(40))}", f"s{k:02d}") for k in range(12)]
    # the smallest site is the same in all contexts
    rows += [(100 + 2 * k + n, f"{' '.join(f'a{k}w{j}' for j in range(40 + 20 * n))}\nshared notice\nend {k}", "s00" if n else f"t{k:02d}") for k in range(11) for n in (0, 1)]
    story = [f"story line {j} has its own words" for j in range(60)]
    rows += [(200 + k, "\n".join([*story[:30], f"changed in copy {k}", *story[30:]]), f"s{k:02d}") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(line_dedup.drop_boilerplate(df, copies="near").select("doc_id", "n_removed"))
    assert {got[k]["n_removed"] for k in range(12)} == {4}
    assert {got[k]["n_removed"] for k in range(100, 122)} == {1}
    assert {got[k]["n_removed"] for k in range(200, 212)} == {0}


# --- 5


def test_language(docs: DataFrame, spark: SparkSession) -> None:
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "re", "st"], "cc": ["éa", "ñi", "lo"]}
    rows = []
    for k in range(300):
        name = ["aa", "bb", "cc"][k % 3]
        rows.append((k, " ".join("".join(rng.choices(syllables[name], k=3)) for _ in range(rng.randrange(3, 40))), name))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, "kalomi", None)]
    got = rows_of(language.identify_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    right = [got[k]["lang_pred"] == name for k, _, name in rows[:300] if got[k]["held_out"]]
    assert sum(right) >= 0.97 * len(right) > 0
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902))
    assert got[903]["lang_pred"] in syllables and all(0 <= v["score"] <= 1 for v in got.values())
    assert len(rows_of(language.identify_held_out(docs))) == len(TEXTS)
    assert language.identify_held_out(docs.where("false")).count() == 0


def test_language_scores_against_plain_sets(spark: SparkSession) -> None:
    own = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "re", "st"], "cc": ["éa", "ñi", "lo"]}
    rows = [(" ".join("".join(own.choices(syllables[x], k=3)) for _ in range(own.randrange(3, 30))), x) for x in sorted(syllables) * 30]
    model = language.fit(rows, landmarks=12)
    sets = lambda t: set(language.grams(t).tolist())
    marks = [{k for k in np.flatnonzero(row).tolist()} for row in model.landmarks]
    texts = [t for t, _ in rows[:20]] + ["kalomi", "x", "zust " * 400]
    got = model.scores(texts)
    for text, row in zip(texts, got, strict=True):
        a = sets(text)
        kernel = np.array([len(a & m) / math.sqrt(max(1, len(a)) * max(1, len(m))) for m in marks])
        e = np.exp(6 * (kernel @ model.weights - (kernel @ model.weights).max()))
        assert np.allclose(row, e / e.sum(), atol=1e-4)
    # n-grams of one to four characters, each by its own hash
    gram = lambda t: {g for n in range(1, 5) for k in range(len(t) - n + 1) for g in language.grams(t[k : k + n])[-1:].tolist()}
    assert all(sets(t) == gram(t) for t in ("kalomi", "ab", "éa ñi", "x"))


# --- 6


def test_packing(docs: DataFrame, empty: DataFrame) -> None:
    pieces = [r.asDict() for r in packing.pack(docs).collect()]
    ids_of = packing.tokens("byte_bpe_50k.json").reference_ids
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        by_doc[p["doc_id"]].append(p)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and len(p["ids"]) == p["length"] == len(p["ids"])
            at += p["length"]
        assert at == 1024 or (at < 1024 and at & (at - 1) == 0)
    for k, text in enumerate(TEXTS):
        want = np.append(ids_of(text or ""), 0).astype(np.uint32)
        copies = 2 if k == 9 else 1
        got = sorted(by_doc[k], key=lambda p: p["start"])
        assert sum(p["length"] for p in got) == copies * len(want)
        for p in got:
            part = want[p["start"] : p["start"] + p["length"]]
            assert p["doc_tokens"] == len(want) and p["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes()) and p["ids"] == part.tolist()
    assert packing.pack(empty).count() == 0


def test_hilbert_curve_visits_neighbours() -> None:
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_keys(points, depth=3)
    assert sorted(keys.tolist()) == list(range(512))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_deals_a_hot_cell_and_repeated_ids(spark: SparkSession) -> None:
    hot, ids_of = "the same words again " * 40, packing.tokens("byte_bpe_50k.json").reference_ids
    rows = [(k, hot) for k in range(60)] + [(7, "another text of that id"), (7, None), (None, "no id"), (100, prose(900)), (101, "mark <|endoftext|> mark")]
    pieces = [r.asDict() for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), part_bytes=8000).collect()]
    assert len({p["sequence_id"] >> 36 for p in pieces}) > 5
    got = defaultdict(int)
    for p in pieces:
        got[p["doc_id"], p["doc_tokens"]] += p["length"]
    want = defaultdict(int)
    for k, text in rows:
        n = len(ids_of(text or "")) + 1
        want[k, n] += n
    assert got == want
    assert 50256 in ids_of("mark <|endoftext|> mark")


def test_fast_tokens_are_those_of_the_library(spark: SparkSession) -> None:
    t = packing.tokens("byte_bpe_50k.json")
    more = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endof"]
    for text in [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [x for x in TEXTS if x] + more:
        assert (t.ids(text) == t.reference_ids(text)).all()


# --- 7


def test_substring_dedup(docs: DataFrame, empty: DataFrame) -> None:
    window = substring_dedup.WINDOW
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    first: dict[tuple, int] = {}
    for k, t in enumerate(TEXTS):
        w = split(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    got = rows_of(substring_dedup.dedup_substrings(docs))
    removed = 0
    for k, t in enumerate(TEXTS):
        w = split(t)
        hit = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                hit[i : i + window] = [True] * window
        kept = b" ".join(x for x, h in zip(w, hit, strict=True) if not h)
        removed += sum(hit)
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(w), sum(hit), hashlib.sha256(kept).hexdigest()), k
    assert removed > 500
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_dedup_by_row(spark: SparkSession) -> None:
    own = random.Random(4)
    words = [f"w{k}" for k in range(80)]
    passage = [f"p{k}" for k in range(230)]
    rows = [(1, words), (2, [*words, "tail"]), (2, [f"u{k}" for k in range(90)]), (None, words), (None, [*passage, "x"]), (4, passage), (5, ["a", *passage[3:], "b"]), (5, passage[60:140])]
    for k in range(40):  # pieces of all lengths around the levels
        at, n = own.randrange(150), own.randrange(8, 80)
        rows.append((10 + k % 25, [*(f"o{k}x{j}" for j in range(own.randrange(60))), *passage[at : at + n], *(f"q{k}x{j}" for j in range(own.randrange(60)))]))
    for window in (50, 24, 5):
        first: dict[tuple, int] = {}
        for i, w in rows:
            for k in range(len(w) - window + 1) if i is not None else ():
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
        want = []
        for i, w in rows:
            hit = {x for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for x in range(k, k + window)}
            kept = " ".join(x for k, x in enumerate(w) if k not in hit)
            want.append((i or -1, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest(), kept))
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
        got = [(r["doc_id"] or -1, *tuple(r)[1:]) for r in substring_dedup.dedup_substrings(df, window=window).collect()]
        assert sorted(got) == sorted(want), window
    assert substring_dedup.levels(50) == [50, 25, 12] and substring_dedup.levels(5) == [5, 2]
    alone = spark.createDataFrame([(k, " ".join(f"v{k}x{j}" for j in range(70))) for k in range(5)], "doc_id long, text string")
    assert {(r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(alone).collect()} == {(70, 0)}


@pytest.mark.parametrize("name", ["op7_substring_dedup", "op9_decontamination"])
def test_queries_equal_their_sql(spark: SparkSession, name: str) -> None:
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    assert {tuple(r) for r in queries.QUERIES[name](spark, SMALL).select(*want.columns).collect()} == set(want.fetchall())


# --- 8


def test_warc(spark: SparkSession) -> None:
    big, other = "<p>" + "x" * 2000 + "</p>", "é" * 600
    rows = [(1, "u1", big), (5, None, big), (3, "u3", big), (2, "u2", "short"), (4, "u4", "short"), (6, "u6", None), (7, "", ""), (8, "a b\r\nc", other), (9, "u", other), (9, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(2)})
    got = rows_of(warc.read_records(warc.write_bundles(pages)), "page_id")
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == hashlib.sha1(raw).hexdigest()
    assert {k: v["refers_to"] for k, v in got.items()} == {1: 5, 5: None, 3: 5, 2: None, 4: None, 6: None, 7: None, 8: 9, 9: None}
    assert {v["record_type"] for v in got.values()} == {"response", "revisit"}
    assert warc.read_records(warc.write_bundles(pages.where("false"))).count() == 0


def test_bundle_round_trip(tmp_path) -> None:  # noqa: ANN001
    import pyarrow.fs
    import zstandard

    records = [warc.record(k, "http://x", prose(k * 30).encode(), "d", None) for k in range(50)]
    with open(tmp_path / "b", "wb") as f:
        w = warc.BundleWriter(f, frame_bytes=5000)
        places = [w.add(r) for r in records]
        w.finish()
    assert places[-1][0] > 3
    reader = warc.BundleReader(pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "b")))
    for k in rng.sample(range(50), 50):
        assert reader.read(*places[k]) == records[k]
        assert warc.parse(records[k])[1] is not None
    # an ordinary decoder reads the frames in a row and skips the table
    with open(tmp_path / "b", "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records)


# --- 9


def test_decontamination(docs: DataFrame, spark: SparkSession) -> None:
    items = [(1, PASSAGE), (2, BASE), (3, "two words"), (4, ""), (5, None), (6, " ".join(BASE_WORDS[100:112])), (7, "cc-by nc"), (7, "stone ring?"), (8, PASSAGE), (None, "wind")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows: dict[tuple, set[str]] = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].update(() if i is None else {str(i)})
    sizes = {len(w) for w in windows}
    for blocks in (400_000, 40):
        got = rows_of(decontamination.contamination(docs, bench, block_words=blocks, keep_text=False))
        for k, t in enumerate(TEXTS):
            w = split(t)
            hit, named = set(), set()
            for n in sizes:
                for i in range(len(w) - n + 1):
                    if (found := windows.get(tuple(w[i : i + n]))) is not None:
                        hit.update(range(i, i + n))
                        named |= found
            spans = [x for s in got[k]["spans"] for x in range(s["start"], s["end"])]
            assert (got[k]["n_words"], set(spans), len(spans), got[k]["items"]) == (len(w), hit, len(hit), sorted(named)), k
    clean = decontamination.decontaminate(docs, bench.where("item_id = 1"))
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(TEXTS))) - {9, 11, 22} - ({10} if len(TEXTS[10].split()) < 120 else set())
    assert decontamination.decontaminate(docs, bench.where("false")).count() == len(TEXTS) + 1
    assert decontamination.contamination(docs.where("false"), bench).count() == 0


def test_automaton_lengths() -> None:
    a = decontamination.ItemAutomaton([("1", b"a b c a b d".split()), ("2", b"b d a".split())], 3)
    assert a.matching_lengths(b"x a b d a b c a q b d".split()) == [0, 1, 2, 3, 3, 2, 3, 4, 0, 1, 2]


def test_spans_are_cut_from_the_text() -> None:
    assert decontamination.cut_spans("Keep, cut-me now; keep.", [(1, 3)]) == "Keep,  now; keep."


# --- 10


def test_media(docs: DataFrame, empty: DataFrame) -> None:
    got = rows_of(media.media_features(media.store_media(docs)))
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (got[k]["n_bytes"], got[k]["payload_bytes"]) == (len(raw), len(payload))
        assert got[k]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[k]["tail_crc32"] == zlib.crc32(payload[-64:])
    assert got[5] == got[6] and got[0] == got[1]
    assert media.media_features(media.store_media(empty)).count() == 0


def plain_feature(payload: bytes) -> str:
    n, h = len(payload), len(payload) // 64
    mean = sum(payload) / n
    dev = max(0.0, sum(b * b for b in payload) / n - mean * mean) ** 0.5
    bits = sum(-c / n * math.log2(c / n) for c in Counter(payload).values())
    columns = [sum(sum(payload[x::64]) for x in range(8 * k, 8 * k + 8)) / 8 / h for k in range(8)]
    return f"h={h};mean={mean:.3f};dev={dev:.3f};bits={max(0.0, bits):.3f};cols=" + ",".join(f"{c:.1f}" for c in columns)


def test_media_features_against_plain_sums(docs: DataFrame) -> None:
    number = lambda text: [float(x) for x in re.findall(r"[-0-9.]+", text)]
    stored = rows_of(media.store_media(docs))
    got = rows_of(media.media_features(media.store_media(docs)))
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        own = bytes(stored[k]["media"])
        assert (got[k]["media_bytes"], got[k]["media_sha256"]) == (len(own), hashlib.sha256(own).hexdigest())
        assert webp.load(own) == payload
        assert np.allclose(number(got[k]["feature"]), number(plain_feature(payload)), atol=0.11), k


def test_media_of_long_texts(spark: SparkSession) -> None:
    long = ("é wind " * 200_000)[: 1_100_000]
    got = media.media_features(media.store_media(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string"))).collect()
    assert got[0][1:] == got[1][1:] and got[0]["n_bytes"] == len(long.encode()) > webp.PICTURE
    payload = media.padded(long.encode())
    assert got[0]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[0]["tail_crc32"] == zlib.crc32(payload[-64:])


def test_registered_queries_have_the_contract_columns(spark: SparkSession) -> None:
    columns = {
        "op1_simhash": "doc_id fingerprint component_id", "op2_toxicity": "doc_id held_out score predicted", "op3_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op5_language": "doc_id held_out lang_pred score", "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op7_substring_dedup": "doc_id n_words n_removed kept_sha256",
        "op8_warc": "page_id payload_bytes payload_digest record_type refers_to", "op9_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op10_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    }
    for name, want in columns.items():
        assert set(want.split()) <= set(queries.QUERIES[name](spark, SMALL).columns), name
