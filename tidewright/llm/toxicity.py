"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

Two tokens are as similar as the character subsequences of length three that they share, each weighted by the stretch
it takes in either token (up to six characters), so insults with inserted or left-out characters stay close to their
plain forms. Landmarks are training tokens: those most tied to toxic sentences, and common ones of clean sentences. A
sentence is the sum of its tokens' squared similarities to the landmarks (below ``NEAR`` they count as none), whitened
with the landmarks' own kernel matrix (Nyström). A linear support vector machine is trained on labelled sentences; as
labels stand on documents, the sentences of a toxic document are a bag of which the strongest is taken to be toxic,
and the choice is repeated with the fitted machine. A document's score is a logistic function of its strongest sentence
and of all its suspect sentences together.

Training is bounded by ``train_docs`` labelled documents and ``train_bytes`` of their texts, in the order of a hash of the
id, and uses all their sentences; scoring reads whole texts. Token counts and sentence features are made where the
texts are; the driver solves for some hundred weights. The machine is linear in the tokens, so a worker computes the
margin of each distinct token once.

Defined results: null and empty texts have no sentence and score as an empty one; without labels of both kinds every
score is 0; equal texts have equal scores; rows without an id are scored, teach nothing, and their held_out is null.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_map, fold, map_batches, restored, single_thread, with_rest, written

DECAY, SPAN, NEAR, POWER = 0.7, 6, 0.4, 2
#: Landmarks of each kind.
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 96, 8
#: Log odds from which a token counts as tied to the toxic label, in how many toxic documents it must stand, and what
#: share of them it must explain beyond chance (rarer ones are mostly words of one text that has copies).
TIED, LEAST, SHARE = 1.5, 3, 0.01
#: Tasks over the training documents.
TASKS = 16
#: Share of toxic documents that the scores are set for.
PRIOR = 0.3
#: Distinct tokens whose margins a worker remembers; then it starts anew.
REMEMBERED = 120_000
#: Characters of a token; longer runs are read in pieces of these sizes at every place.
LONGEST, PIECES = 40, (4, 6, 9, 12)
#: Characters of tokens that may be letters of a gapped word.
SHORT = 3
#: Stand before and after a token and count as characters, so that where a word starts and ends matters.
START, END = "<", ">"
_SENTENCE = re.compile(r"[.!?]+[\s]+|[。！？｡]+\s*|\n+")
_PART = re.compile(r"[^\W_]+")
_WEIGHTS = DECAY ** np.arange(1, SPAN + 1)


def token(raw: str) -> str:
    """Lower-cased, without what is no letter or digit at its ends."""
    word = raw.lower()
    if word.isalnum():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def clauses(word: str) -> list[list[str]]:
    """Pieces to score of a token over ``LONGEST`` characters, by run of letters and digits: the run itself, or
    overlapping pieces of a long one. Runs of few characters between signs also stand joined."""
    parts = _PART.findall(word)
    out = []
    for part in [*parts, *_joined(parts)]:
        out.append([part] if len(part) <= PIECES[-1] else _pieces(part))
    return out


def _pieces(run: str) -> list[str]:
    """All pieces of a run of the sizes ``PIECES``."""
    return list(dict.fromkeys(run[k : k + size] for size in PIECES for k in range(max(1, len(run) - size + 1))))


def _joined(words: list[str]) -> list[str]:
    """Runs of at least two neighbouring words of up to ``SHORT`` characters, joined; also those of single characters
    alone."""
    out = []
    for size in {1, SHORT}:
        run: list[str] = []
        for w in [*words, " " * (SHORT + 1)]:
            if len(w) <= size:
                run.append(w)
                continue
            if len(run) > 1:
                out.append("".join(run))
            run = []
    return list(dict.fromkeys(out))


def sentences(text: str | None) -> list[list[str]]:
    """Tokens of each sentence, long ones in pieces; sentences without tokens are left out."""
    out = []
    for part in _SENTENCE.split(text or ""):
        words = [w for w in map(token, part.split()) if w]
        if words:
            out.append([x for w in words for x in ([w] if len(w) <= LONGEST else [p for c in clauses(w) for p in c])])
    return [words for words in out if words]


def _occurrences(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every place of a subsequence as token number << 33 | hash << 3 | stretch - 1, and the tokens' lengths with marks."""
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 2
    marked = f"{START}{(END + START).join(tokens)}{END}" if tokens else ""
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(tokens)), sizes)
    keys = []
    for b in range(2, SPAN):
        n = len(codes) - b
        if n <= 0:
            continue
        inside = np.flatnonzero(of[:n] == of[b:])
        first, last, number = codes[inside] * np.uint64(0x9E3779B1), codes[inside + b], of[inside].astype(np.uint64) << np.uint64(33) | np.uint64(b)
        for a in range(1, b):
            h = (first + codes[inside + a]) * np.uint64(0x85EBCA77) + last
            h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(34)
            keys.append(number | h << np.uint64(3))
    return np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64), sizes


def _weighed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token number, subsequence, weight) without repeats, of at least one place."""
    key = np.sort(key)
    weight = _WEIGHTS[(key & np.uint64(7)).astype(np.int64)]
    key >>= np.uint64(3)
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    weight = np.add.reduceat(weight, heads)
    key = key[heads]
    return (key >> np.uint64(30)).astype(np.int64), (key & np.uint64((1 << 30) - 1)).astype(np.int64), weight


def subsequences(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token number, hashed subsequence, weight) without repeats, and each token's norm."""
    key, _ = _occurrences(tokens)
    if not len(key):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.empty(0), np.ones(len(tokens))
    number, h, weight = _weighed(key)
    norms = np.sqrt(np.bincount(number, weight * weight, minlength=len(tokens)))
    return number, h, weight, np.where(norms > 0, norms, 1.0)


def _least_norms(sizes: np.ndarray) -> np.ndarray:
    """What the norm of a token is at least, by its length with marks: that of one whose subsequences all differ."""
    return np.sqrt(sum((b - 1) * _WEIGHTS[b] ** 2 * np.maximum(0, sizes - b) for b in range(2, SPAN)))


class Landmarks:
    """Tokens to compare with; :meth:`near` gives squared normalised kernels, none below ``NEAR``."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        number, h, weight, norms = subsequences(words)
        self.known, column = np.unique(h, return_inverse=True)
        # by subsequence: the landmarks that hold it and its share in each
        order = np.argsort(column, kind="stable")
        self.first = np.searchsorted(column[order], np.arange(len(self.known) + 1))
        self.holder, self.share = number[order], (weight / norms[number])[order]
        self.most = np.maximum.reduceat(self.share, self.first[:-1]) if len(self.known) else np.empty(0)
        self.table = np.zeros(1 << 20, dtype=np.float32)  # the same by the low bits of a subsequence's hash
        np.maximum.at(self.table, self.known & 0xFFFFF, np.nextafter(self.most.astype(np.float32), np.float32(2)))
        own = self.near(words)[1]
        roots, vectors = np.linalg.eigh((own + own.T) / 2)
        good = roots > 1e-4
        self.whiten = vectors[:, good] / np.sqrt(roots[good])
        self.width = len(words)

    def near(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the tokens that are near some landmark, their rows of similarities)."""
        # most tokens go by the sum of what each of their subsequences could add to the landmark that holds most of it
        key, sizes = _occurrences(tokens)
        most = self.table[((key >> np.uint64(3)) & np.uint64(0xFFFFF)).astype(np.int64)]
        some = np.flatnonzero(most)
        key = key[some]
        bound = np.bincount((key >> np.uint64(33)).astype(np.int64), most[some] * _WEIGHTS[(key & np.uint64(7)).astype(np.int64)], minlength=len(tokens))
        possible = np.flatnonzero((bound >= NEAR * (1 - 1e-5) * _least_norms(sizes)) & (bound > 0))
        number, rows = self._near([tokens[k] for k in possible.tolist()])
        return possible[number], rows

    def _near(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number, h, weight, norms = subsequences(tokens)
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        hit = self.known[at] == h if len(self.known) else np.zeros(0, dtype=bool)
        number, at, weight = number[hit], at[hit], weight[hit]
        # no landmark is nearer than the shared subsequences weigh together (Cauchy-Schwarz), nor than the sum of what
        # each could add to the landmark that holds most of it
        n = len(tokens)
        bound = np.minimum(np.sqrt(np.bincount(number, weight * weight, minlength=n)), np.bincount(number, weight * self.most[at], minlength=n)) / norms
        want = np.flatnonzero(bound[number] >= NEAR)
        number, at, weight = number[want], at[want], weight[want]
        if not len(number):
            return np.empty(0, dtype=np.int64), np.zeros((0, len(self.words)))
        heads = np.concatenate(([True], number[1:] != number[:-1]))  # they ascend
        names, row = number[heads], np.cumsum(heads) - 1
        first = self.first[at]
        holders = self.first[at + 1] - first
        ends = np.cumsum(holders)
        place = np.arange(ends[-1]) + np.repeat(first - (ends - holders), holders)
        cell = np.repeat(row * len(self.words), holders)
        cell += self.holder[place]
        value = np.repeat(weight, holders)
        value *= self.share[place]
        flat = np.bincount(cell, value, minlength=len(names) * len(self.words))
        rows = flat.reshape(len(names), -1) / norms[names][:, None]
        some = (rows >= NEAR).any(axis=1)
        rows = rows[some]
        return names[some], np.where(rows >= NEAR, rows**POWER, 0.0)


@dataclass
class Model:
    """Landmarks, weights of their similarities, bias, and the sigmoid over a document's sentences."""

    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def margins(self, tokens: list[str]) -> np.ndarray:
        """What each token adds to its sentence."""
        out = np.zeros(len(tokens))
        number, rows = self.landmarks.near(tokens)
        out[number] = rows @ self.weights
        return out

    def score(self, margins: list[float]) -> float:
        strongest, all_of_them = evidence(margins or [self.bias])
        x = float(self.curve[0] * strongest + self.curve[1] * all_of_them + self.curve[2])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _three(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A hash of 20 bits of three characters."""
    h = ((a * np.uint32(0x9E3779B1) + b) * np.uint32(0x85EBCA77) + c) * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(12)).astype(np.int64)


class Scorer:
    """Scores texts with remembered token margins.

    A batch's tokens are numbered once; sums over sentences and the search for words that belong together across spaces
    run over arrays of these numbers.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        marked = [f"{START}{w}{END}" for w in model.landmarks.words]
        self.triples = {w[k : k + 3] for w in marked for k in range(len(w) - 2)}
        #: numbers of the first two and the last two characters that some landmark's threes begin or end with
        self.heads = {x: n for n, x in enumerate(sorted({t[1:] for t in self.triples}), 1)}
        self.tails = {x: n for n, x in enumerate(sorted({t[:2] for t in self.triples}), 1)}
        self.firsts = {x: n for n, x in enumerate(sorted({t[2] for t in self.triples}), 1)}
        self.lasts = {x: n for n, x in enumerate(sorted({t[0] for t in self.triples}), 1)}
        #: by (tail of the one word, first character of the next) and (last character, head): whether a landmark holds it
        self.over = np.zeros((len(self.tails) + 1, len(self.firsts) + 1), dtype=bool)
        self.under = np.zeros((len(self.lasts) + 1, len(self.heads) + 1), dtype=bool)
        for t in self.triples:
            self.over[self.tails[t[:2]], self.firsts[t[2]]] = True
            self.under[self.lasts[t[0]], self.heads[t[1:]]] = True
        self.threes = np.zeros(1 << 20, dtype=np.int32)
        for t in self.triples:
            self.threes[_three(*(np.array([ord(c)], dtype=np.uint32) for c in t))] = 1
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.words: list[str] = []  # by number, without signs at the ends
        self.value = np.zeros(0)
        self.traits = np.zeros((0, 7), dtype=np.int32)  # length, tail, first, last, head, and threes of characters in landmarks
        self.spans: dict[tuple[int, ...], float] = {}  # what joined tokens add beyond their own, by kind and numbers
        self.joined: dict[str, float] = {}

    def _worth(self, forms: list[str]) -> np.ndarray:
        """Margins of tokens; those over ``LONGEST`` characters by their pieces."""
        out = np.empty(len(forms))
        for k in range(0, len(forms), 5000):
            part = forms[k : k + 5000]
            long = {n: clauses(w) for n, w in enumerate(part) if len(w) > LONGEST}
            short = ["" if n in long else w for n, w in enumerate(part)]
            # gaps of other signs inside a token may also be left out
            plain = [w if w.isalnum() else "".join(filter(str.isalnum, w)) for w in short]
            value = self.model.margins(short)
            odd = [n for n, (a, b) in enumerate(zip(short, plain, strict=True)) if a != b]
            if odd:
                value[odd] = np.maximum(value[odd], self.model.margins([plain[n] for n in odd]))
            pieces = list({x for runs in long.values() for run in runs for x in run})
            worth: dict[str, float] = {}
            for at in range(0, len(pieces), 5000):
                some = pieces[at : at + 5000]
                worth.update(zip(some, self.model.margins(some).tolist(), strict=True))
            # of overlapping pieces the strongest, so that what two of them hold counts once
            for n, runs in long.items():
                value[n] = sum(max(worth[x] for x in run) for run in runs)
            out[k : k + 5000] = value
        return out

    def _learn(self, raw: list[str]) -> None:
        """Number tokens and remember their margins and what they meet their neighbours with."""
        forms = list(map(token, raw))
        at = len(self.words)
        self.number.update(zip(raw, range(at, at + len(raw)), strict=True))
        self.words += forms
        self.value = np.concatenate((self.value, self._worth(forms)))
        tail, first, last, head = self.tails.get, self.firsts.get, self.lasts.get, self.heads.get
        traits = [(len(w), tail((START + w)[-2:], 0), first(w[:1], 0), last(w[-1:], 0), head((w + END)[:2], 0)) if w else (0, 0, 0, 0, 0) for w in forms]
        inside = self._inside(forms)
        self.traits = np.concatenate((self.traits, np.hstack((np.array(traits, dtype=np.int32).reshape(-1, 5), inside))))

    def _inside(self, forms: list[str]) -> np.ndarray:
        """How many threes of characters of a token after ``START``, and of one before ``END``, stand in landmarks (by a
        hash of the threes)."""
        n = np.fromiter(map(len, forms), dtype=np.int64, count=len(forms)) + 2
        codes = np.frombuffer(f"{START}{(END + START).join(forms)}{END}".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        held = np.zeros(len(codes), dtype=np.int32)
        held[:-2] = self.threes[_three(codes[:-2], codes[1:-1], codes[2:])]
        ends = np.cumsum(n)
        total = np.concatenate(([0], np.cumsum(held)))
        starts = ends - n
        long = n > 2
        whole = np.where(long, total[np.maximum(ends - 2, starts)] - total[starts], 0)
        return np.stack((whole - np.where(long, held[np.maximum(ends - 3, 0)], 0), whole - np.where(long, held[starts], 0)), axis=1).astype(np.int32)

    def _numbers(self, flat: list[str]) -> np.ndarray:
        new = set(flat) - self.number.keys()
        if new:
            self._learn(list(new))
        return np.fromiter(map(self.number.__getitem__, flat), dtype=np.int64, count=len(flat))

    def margins(self, texts: list[str | None]) -> list[list[float]]:
        """Margins of each text's sentences."""
        if len(self.words) + len(self.spans) > REMEMBERED:
            self._forget()
        flat: list[str] = []
        sizes: list[int] = []  # tokens of each sentence
        counts = []  # sentences of each text
        for text in texts:
            n = len(sizes)
            for part in _SENTENCE.split(text) if text else ():
                words = part.split()
                if words:
                    flat += words
                    sizes.append(len(words))
            counts.append(len(sizes) - n)
        if not sizes:
            return [[] for _ in texts]
        ids = self._numbers(flat)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        sums = np.add.reduceat(self.value[ids], starts) + self.model.bias
        of = np.repeat(np.arange(len(sizes)), sizes)
        more = self._across(ids, of)
        for sentence, gain in more.items():
            sums[sentence] += gain
        ends = np.cumsum(counts)
        return [sums[a:b].tolist() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]

    def _across(self, ids: np.ndarray, of: np.ndarray) -> dict[int, float]:
        """By sentence, the most that a form joined across spaces adds beyond its tokens: runs of single characters,
        runs of short tokens and adjacent pairs, half of whose neighbouring threes of characters stand in landmarks (of
        a pair both across the space, too)."""
        length, tail, first, last, head, left, right = self.traits[ids].T
        near = of[1:] == of[:-1]
        pair = near & (length[:-1] > 0) & (length[1:] > 0) & self.over[tail[:-1], first[1:]] & self.under[last[:-1], head[1:]]
        both = length[:-1] + length[1:]
        pair &= (both <= LONGEST) & (2 * (left[:-1] + right[1:] + 2) >= both)
        places = [(k, k + 2, 0) for k in np.flatnonzero(pair).tolist()]
        for size in (1, SHORT):
            few = length <= size
            together = np.concatenate(([False], near & few[1:] & few[:-1], [False])).astype(np.int8)
            begin, end = np.flatnonzero(np.diff(together) == 1).tolist(), (np.flatnonzero(np.diff(together) == -1) + 1).tolist()
            places += [(a, b, size) for a, b in zip(begin, end, strict=True)]
        if not places:
            return {}
        numbers = ids.tolist()
        keys = [(size, *numbers[a:b]) for a, b, size in places]
        new = set(keys) - self.spans.keys()
        if new:
            forms = {key: self._forms("".join([self.words[n] for n in key[1:]]), key[0]) for key in new}
            wanted = list({x for some in forms.values() for x in some} - self.joined.keys())
            self.joined.update(zip(wanted, self._worth(wanted).tolist(), strict=True))
            for key, some in forms.items():
                own = sum(max(0.0, self.value[n]) for n in key[1:]) if some else 0.0
                self.spans[key] = max([0.0, *(self.joined[x] - own for x in some)])
        out: dict[int, float] = {}
        for gain, (a, _, _) in zip(map(self.spans.__getitem__, keys), places, strict=True):
            if gain:
                sentence = int(of[a])
                out[sentence] = max(gain, out.get(sentence, 0.0))
        return out

    def _forms(self, joined: str, size: int) -> list[str]:
        """What a joined run may be read as; size 0 marks a pair of words."""
        if not joined:
            return []
        if size == 0:
            return [joined]
        forms = [joined] if len(joined) <= PIECES[-1] else _pieces(joined)
        return [x for x in forms if size == 1 or 2 * sum(x[k : k + 3] in self.triples for k in range(len(x) - 2)) >= max(1, len(x) - 2)]

    def scores(self, texts: list[str | None]) -> list[float]:
        return [self.model.score(m) for m in self.margins(texts)]


# --- training -------------------------------------------------------------------------------------------------------


class Bags:
    """Sentences as sparse rows of landmark similarities: toxic documents keep theirs apart, those of clean documents
    are counted by value. Sentences near no landmark are rows without entries."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.toxic: list[list[bytes]] = []
        self.clean: Counter[bytes] = Counter()

    def add(self, y: int, rows: list[bytes], counts: list[int]) -> None:
        if y > 0:
            self.toxic.append(rows or [b""])
        else:
            for row, n in zip(rows, counts, strict=True):
                self.clean[row] += n


#: A sparse row: landmark and similarity.
_ENTRY = np.dtype([("i", "<u2"), ("v", "<f4")])


class Rows:
    """A sparse matrix; ``dense`` rows are made for few rows at a time."""

    def __init__(self, rows: list[bytes], width: int) -> None:
        self.width = width
        raw = np.frombuffer(b"".join(rows), dtype=_ENTRY)
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // _ENTRY.itemsize
        self.row, self.i, self.v, self.n = np.repeat(np.arange(len(rows)), sizes), raw["i"].astype(np.int64), raw["v"].astype(float), len(rows)

    def times(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.v * u[self.i], minlength=self.n)

    def dense(self, chosen: np.ndarray, at: int, upto: int) -> np.ndarray:
        """Rows number at:upto of those chosen (a mask)."""
        numbers = np.flatnonzero(chosen)[at:upto]
        place = np.full(self.n, -1)
        place[numbers] = np.arange(len(numbers))
        want = np.flatnonzero(place[self.row] >= 0)
        out = np.zeros((len(numbers), self.width))
        np.add.at(out, (place[self.row[want]], self.i[want]), self.v[want])
        return out


def _machine(x: Rows, whiten: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine over whitened rows with squared hinge loss, by Newton steps on the active set."""
    w = np.zeros(whiten.shape[1] + 1)
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (x.times(whiten @ w[:-1]) + w[-1]) < 1
        left, right = keep.copy(), np.zeros(len(w))
        for at in range(0, int(active.sum()), 8192):
            a = x.dense(active, at, at + 8192) @ whiten
            a = np.hstack((a, np.ones((len(a), 1))))
            c, t = cost[active][at : at + 8192], y[active][at : at + 8192]
            left += a.T @ (a * c[:, None])
            right += a.T @ (c * t)
        step = np.linalg.solve(left, right) - w
        w = w + step * (1.0 if np.abs(step).max() < 1 else 0.7)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _sigmoid(x: np.ndarray, label: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic fit over the columns of ``x`` and a constant; label 1 counts as if it were ``PRIOR`` of all."""
    weight = np.where(label > 0, PRIOR / max(1, (label > 0).sum()), (1 - PRIOR) / max(1, (label <= 0).sum()))
    x = np.hstack((x, np.ones((len(x), 1))))
    w, y = np.zeros(x.shape[1]), (label > 0).astype(float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-4 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def evidence(margins: list[float]) -> tuple[float, float]:
    """Of the sentences' margins: the strongest (within -2 and 4), and the log of all that reach beyond -1 together."""
    return min(4.0, max(-2.0, max(margins))), math.log1p(sum(m + 1 for m in margins if m > -1))


def _gapped(word: str) -> str:
    """The word with one character more, a repeated or a foreign one, at a place that depends on the word."""
    if len(word) < 4:
        return word
    n = zlib.crc32(word.encode())
    at = 1 + n % (len(word) - 1)
    return word[:at] + (word[at - 1] if n & 1024 else "x") + word[at:]


def token_counts(rows: list[tuple[str, int]]) -> tuple[Counter[str], Counter[str]]:
    """In how many toxic and in how many clean documents each token stands."""
    seen: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
    for text, y in rows:
        seen[y > 0].update({w for words in sentences(text) for w in words})
    return seen[True], seen[False]


def tie(in_toxic: int, in_clean: int, n_toxic: int, n_clean: int) -> tuple[float, float]:
    """A token's log odds, and the share of the toxic documents that it explains beyond chance."""
    odds = math.log((in_toxic + 0.5) / (n_toxic + 1) / ((in_clean + 0.5) / (n_clean + 1)))
    return odds, in_toxic / n_toxic - in_clean / n_clean


def bags_of(rows: list[tuple[str, int]], marks: Landmarks, tied: set[str]) -> list[tuple[int, list[bytes], list[int]]]:
    """(label 1 or -1, different sparse rows of the sentences, how often each stands) by document. Toxic documents stand
    once more with a character put into their tied tokens, so that the machine bears such forms."""
    docs = [(sentences(t), 1 if y > 0 else -1) for t, y in rows]
    docs += [([[_gapped(w) if w in tied else w for w in words] for words in parts], y) for parts, y in docs if y > 0]
    vocabulary = sorted({w for parts, _ in docs for words in parts for w in words})
    near: dict[str, np.ndarray] = {}
    for n in range(0, len(vocabulary), 5000):
        number, found = marks.near(vocabulary[n : n + 5000])
        near.update(zip([vocabulary[n + x] for x in number.tolist()], found, strict=True))
    out = []
    for parts, y in docs:
        seen: Counter[bytes] = Counter()
        for words in parts:
            close = [near[w] for w in words if w in near]
            row = np.sum(close, axis=0) if close else np.zeros(0)
            entries = np.empty(int(np.count_nonzero(row)), dtype=_ENTRY)
            entries["i"] = np.flatnonzero(row)
            entries["v"] = row[entries["i"]]
            seen[entries.tobytes()] += 1
        out.append((y, list(seen), list(seen.values())))
    return out


def solve(bags: Bags, marks: Landmarks, tied: int) -> Model:
    """The machine over all sentences: clean ones as they stand, of each toxic document the strongest: first the one
    nearest to the first ``tied`` landmarks, then chosen again with each fit."""
    clean, counts = list(bags.clean), np.array(list(bags.clean.values()), dtype=float)
    toxic = Rows([row for rows in bags.toxic for row in rows], marks.width)
    ends = np.cumsum([len(rows) for rows in bags.toxic])
    starts = np.concatenate(([0], ends[:-1]))
    every = [row for rows in bags.toxic for row in rows]
    n = len(bags.toxic)
    cost = np.concatenate((np.full(n, 0.5), n / 2 * counts / max(1.0, counts.sum())))
    y = np.concatenate((np.ones(n), -np.ones(len(clean))))
    margins = toxic.times((np.arange(marks.width) < tied).astype(float))
    for _ in range(4):
        strongest = [a + int(margins[a:b].argmax()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        x = Rows([every[k] for k in strongest] + clean, marks.width)
        w, bias = _machine(x, marks.whiten, y, cost, ridge=0.05)
        margins = toxic.times(marks.whiten @ w)
    return Model(marks, marks.whiten @ w, bias, np.zeros(3))


def _landmarks(tied: list[str], frequent: list[str], clean: int) -> Landmarks:
    return Landmarks(tied + frequent[: 8 * clean : 8])


def fit(rows: list[tuple[str, int]], toxic: int = TOXIC_LANDMARKS, clean: int = CLEAN_LANDMARKS) -> Model | None:
    """Train on (text, label) rows in this process; :func:`train` does the same over a cluster."""
    rows = [(t, 1 if y else -1) for t, y in rows]
    n_toxic, n_clean = sum(y > 0 for _, y in rows), sum(y < 0 for _, y in rows)
    if not n_toxic or not n_clean:
        return None
    in_toxic, in_clean = token_counts(rows)
    ranked = {w: tie(k, in_clean[w], n_toxic, n_clean) for w, k in in_toxic.items() if k >= LEAST}
    tied = sorted((w for w, (odds, share) in ranked.items() if odds >= TIED and share >= SHARE), key=lambda w: (-ranked[w][0] * ranked[w][1], w))[:toxic]
    frequent = sorted((w for w in in_clean if w not in set(tied) and len(w) > 2), key=lambda w: (-in_clean[w], w))
    marks = _landmarks(tied, frequent, clean)
    bags = Bags(marks.width)
    for bag in bags_of(rows, marks, set(tied)):
        bags.add(*bag)
    model = solve(bags, marks, len(tied))
    scorer = Scorer(model)
    model.curve = _sigmoid(np.array([evidence(m or [model.bias]) for m in scorer.margins([t for t, _ in rows])]), np.array([y for _, y in rows]))
    return model


def _sample(documents: DataFrame, labels: DataFrame, usable: Column, train_docs: int, train_bytes: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, int, int]:
    """(text, y) of the labelled documents to learn from, written; and the numbers of toxic and clean ones."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(usable & F.col("y").isNotNull())
    some = marked.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_docs)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # of rows that repeat an id one is learnt from
    one = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = written(one.select(F.xxhash64("doc_id").alias("h"), "y", "text").repartition(TASKS), "training")
    total, last, numbers = 0, None, Counter()
    for r in sorted(found.select("h", "y", F.octet_length("text").alias("n")).collect()):
        if total and total + r["n"] > train_bytes:
            break
        total, last = total + r["n"], r["h"]
        numbers[r["y"] != 0] += 1
    kept = found.where(F.col("h") <= last) if last is not None else found.where("false")
    return kept.select("text", F.when(F.col("y") != 0, 1).otherwise(-1).alias("y")), numbers[True], numbers[False]


def _in_groups(rows: DataFrame, fn: Callable[[list[tuple[str, int]]], pa.RecordBatch], schema: str, group: int = 200) -> DataFrame:
    """``fn`` over groups of (text, y) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        for batch in batches:
            for k in range(0, batch.num_rows, group):
                part = batch.slice(k, group)
                yield fn(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)))

    return arrow_map(rows, run, schema)


def train(
    documents: DataFrame, labels: DataFrame, usable: Column, *, train_docs: int = 5000, train_bytes: int = 32 << 20, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> Model | None:
    """Fit on at most ``train_docs`` labelled rows for which ``usable`` (over the column ``doc_id``) holds, and at most
    ``train_bytes`` of text, in the order of a hash of the id. Texts stay with the executors: the driver gets landmark
    tokens, sparse sentence rows and two numbers a document."""
    rows, n_toxic, n_clean = _sample(documents, labels, usable, train_docs, train_bytes, id_col, text_col, label_col)
    if not n_toxic or not n_clean:
        return None

    def count(part: list[tuple[str, int]]) -> pa.RecordBatch:
        a, b = token_counts(part)
        words = sorted(a.keys() | b.keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([a[w] for w in words], pa.int64()), pa.array([b[w] for w in words], pa.int64())], names=["w", "a", "b"])

    counts = _in_groups(rows, count, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = written(counts, "tokens")
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1) / ((F.col("b") + 0.5) / (n_clean + 1)))
    share = F.col("a") / n_toxic - F.col("b") / n_clean
    tied = [r["w"] for r in counts.where((F.col("a") >= LEAST) & (odds >= TIED) & (share >= SHARE)).orderBy((odds * share).desc(), "w").limit(TOXIC_LANDMARKS).collect()]
    common = counts.where((F.char_length("w") > 2) & (F.col("b") > 0) & ~F.col("w").isin(tied)).orderBy(F.desc("b"), "w").limit(8 * CLEAN_LANDMARKS)
    marks = _landmarks(tied, [r["w"] for r in common.collect()], CLEAN_LANDMARKS)
    context = documents.sparkSession.sparkContext
    shared = context.broadcast((marks, set(tied)))

    def features(part: list[tuple[str, int]]) -> pa.RecordBatch:
        got = bags_of(part, *shared.value)
        columns = [pa.array([x[k] for x in got], kind) for k, kind in enumerate((pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, names=["y", "rows", "counts"])

    bags = Bags(marks.width)
    for r in _in_groups(rows, features, "y int, rows array<binary>, counts array<long>").collect():
        bags.add(r["y"], [bytes(x) for x in r["rows"]], r["counts"])
    model = solve(bags, marks, len(tied))
    fitted = context.broadcast(model)

    def strength(part: list[tuple[str, int]]) -> pa.RecordBatch:
        own = Scorer(fitted.value)
        both = [evidence(m or [own.model.bias]) for m in own.margins([t for t, _ in part])]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in both]), pa.array([x[1] for x in both]), pa.array([y for _, y in part], pa.int32())], names=["top", "all", "y"])

    found = sorted(tuple(r) for r in _in_groups(rows, strength, "top double, all double, y int", 1000).collect())
    model.curve = _sigmoid(np.array([r[:2] for r in found]), np.array([r[2] for r in found]))
    shared.destroy()
    fitted.destroy()
    return model


def score(df: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, score), with ``carry`` also text and the other columns in a struct ``rest``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = with_rest(df, id_col, text_col)
    source = source if carry else source.drop("rest")
    rest = f", text string, rest {source.schema['rest'].dataType.simpleString()}" if carry else ""
    scorers: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        single_thread()
        if shared.value is None:
            found = [0.0] * batch.num_rows
        else:
            if not scorers:
                scorers.append(Scorer(shared.value))
            texts = batch.column(1).to_pylist()
            found = [x for k in range(0, len(texts), 500) for x in scorers[0].scores(texts[k : k + 500])]
        more = batch.columns[1:] if carry else []
        names = ["doc_id", "score", *(["text", "rest"] if carry else [])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), *more], names=names)

    return map_batches(source, run, "doc_id long, score double" + rest)


def held_out_scores(documents: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """Train on labels outside fold 0 of 5 and score all: doc_id, held_out, score, predicted."""
    model = train(documents, labels, fold(F.col("doc_id"), 5) != 0, **limits)
    out = score(documents, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, *, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score under ``limit``; all columns stay."""
    model = train(documents, labels, fold(F.col("doc_id"), 5) != 0, id_col=id_col, text_col=text_col)
    kept = score(documents, model, id_col=id_col, text_col=text_col, carry=True).where(F.col("score") < limit)
    return restored(kept, documents, id_col, text_col)
