"""Abusive, hateful and sexual passages, by a support vector machine over a gapped string kernel.

Two passages are alike by the subsequences of four characters that they share, where one character may stand between
them at a price (LAMBDA): an insult with an inserted or altered character keeps most of its subsequences. The machine is
trained on Nyström features: kernel values against landmark passages, whitened by the landmarks' own kernel matrix. As
both steps are linear, what is learnt folds into one weight for each of the 32^4 subsequences (4 MB, whatever the size of
the data), and scoring a passage is a sum of weights.

Training data are the labelled sentences of :mod:`toxic_examples` and a bounded sample of reviewed documents: at most
``MAX_LABELLED`` offending and as many harmless ones, chosen by hash, of each at most ``MAX_OF_DOCUMENT`` passages spread
over the whole text, cut by the executors; so the driver gets at most 2 * 1500 * 40 passages of about 150 characters,
however large the tables are. Reviews are by document, so the passages that offend in an offending document are found in
rounds: at first the best one and those that score above zero, then those that a machine trained on the other half of the
documents scores above zero. Of the passages of harmless documents a round takes the ``MAX_HARD`` that score highest and as many spread over the rest. Documents on which
raters tie are not used.

A document is cut into sentences, and long ones into overlapping windows, and scored by its worst passage: documents of
any length are read whole. Scoring is one pass without a shuffle.

Defined results: null, empty and blank texts score 0 and are no cases; without any reviews the labelled sentences alone
train the machine. Repeated documents score alike. Null sources are a source of their own. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import fold
from .toxic_examples import HARMLESS, OFFENSIVE

LAMBDA = 0.6
WINDOW, STEP = 100, 50
#: Bounds on the labelled rows that train the machine; scoring covers every row.
MAX_LABELLED = 1500
MAX_OF_DOCUMENT = 40
MAX_HARD = 1500
LANDMARKS = 256
ROUNDS = 2
LIMIT = 0.1
WEIGHT, COST = 2.0, 15.0
_SPLIT = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){2,}\w(?!\w)")
_MIXED = re.compile(r"[a-z@$!|]*[0-9@$|][a-z0-9@$!|]*")
_LEET = str.maketrans("0134579@$!|", "oieastgasil")
_TOUCHING = re.compile(r"[a-z][0-9@$|]|[0-9@$|][a-z]")
_RULE = re.compile(r"([^\w\s])\1{2,}")
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_SEPARATOR = 31


def passages(text: str | None) -> list[str]:
    """Sentences in canonical form; long ones as overlapping windows that end at word ends."""
    if not text or text.isspace():
        return []
    out = []
    for s in _SPLIT.split(canonical(text)):
        if len(s) <= WINDOW + STEP:
            if s and not s.isspace():
                out.append(s)
            continue
        at = 0
        while at < len(s):
            end = min(len(s), at + WINDOW)
            if end < len(s):
                space = s.find(" ", end)
                end = space if 0 <= space < end + 60 else end
            out.append(s[at:end])
            if end == len(s):
                break
            at += STEP
    return out


def canonical(text: str) -> str:
    """Folded, without hidden characters and ruled lines, spaced-out words closed up, digits that stand for letters
    replaced. Runs of a letter are cut to one when the passage is coded."""
    t = fold(_HIDDEN.sub("", text) if not text.isascii() else text)
    if _TOUCHING.search(t):
        t = _MIXED.sub(lambda m: m[0].translate(_LEET) if any("a" <= c <= "z" for c in m[0]) else m[0], t)
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), t)
    return _RULE.sub(lambda m: "***" if m[1] == "*" else "", t)


def _code_table() -> np.ndarray:
    """Characters to 5 bits: letters 1-26, white space 0, star 27, digits 28, other letters 29, the rest 30."""
    out = np.full(0x10000, 30, dtype=np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if "a" <= ch <= "z":
            out[c] = c - 96
        elif ch.isspace():
            out[c] = 0
        elif ch in "*_#":
            out[c] = 27
        elif ch.isdigit():
            out[c] = 28
        elif unicodedata.category(ch).startswith("L"):
            out[c] = 29
    return out


_CODES: np.ndarray | None = None
_GAPS = ((1, 2, 3, 1.0), (1, 2, 4, LAMBDA), (1, 3, 4, LAMBDA), (2, 3, 4, LAMBDA))


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All passages as one array of codes with separators, and the passage of each place."""
    global _CODES
    if _CODES is None:
        _CODES = _code_table()
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 7
    points = np.frombuffer("".join("\x01 " + t + " \x01\x01\x01\x01" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _CODES[np.minimum(points, 0xFFFF)].astype(np.int32)
    codes[points == 1] = _SEPARATOR
    once = np.ones(len(codes), dtype=bool)
    once[1:] = (codes[1:] != codes[:-1]) | (codes[1:] == 0) | (codes[1:] > 26)
    return codes[once], np.repeat(np.arange(len(texts)), lens)[once]


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places, subsequence numbers, weight) for each way to leave a gap."""
    n = len(codes) - 4
    bad = codes == _SEPARATOR
    for a, b, d, w in _GAPS:
        ok = ~(bad[:n] | bad[a : n + a] | bad[b : n + b] | bad[d : n + d])
        if d == 4:
            ok &= ~bad[4 - 1 : n + 3] & ~bad[1 : n + 1] & ~bad[2 : n + 2]
        at = np.nonzero(ok)[0]
        yield at, (codes[at] << 15) | (codes[at + a] << 10) | (codes[at + b] << 5) | codes[at + d], w


def score_passages(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    if not texts:
        return np.empty(0)
    codes, owner = _coded(texts)
    total, norm = np.zeros(len(texts)), np.zeros(len(texts))
    for at, number, w in _subsequences(codes):
        total += w * np.bincount(owner[at], weights[number], len(texts))
        norm += w * w * np.bincount(owner[at], minlength=len(texts))
    return total / np.sqrt(np.maximum(norm, 1)) + bias


class Machine:
    """weights of the subsequences and bias."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def __call__(self, texts: list[str]) -> np.ndarray:
        return score_passages(texts, self.weights, self.bias)


class Landmarks:
    """Kernel values against fixed passages; those of a passage are computed once, however many machines it trains."""

    def __init__(self, marks: list[str]) -> None:
        codes, owner = _coded(marks)
        parts = [(owner[at], number, np.full(len(at), w)) for at, number, w in _subsequences(codes)]
        who, what, much = (np.concatenate(x) for x in zip(*parts))
        self.numbers, column = np.unique(what, return_inverse=True)
        phi = np.zeros((len(self.numbers) + 1, len(marks)), dtype=np.float32)
        np.add.at(phi, (column, who), much)
        self.phi = phi / np.sqrt(np.maximum(np.bincount(who, much * much, len(marks)), 1)).astype(np.float32)
        self.place = np.full(1 << 20, len(self.numbers), dtype=np.int32)
        self.place[self.numbers] = np.arange(len(self.numbers))
        val, vec = np.linalg.eigh(self.phi[:-1].T.astype(np.float64) @ self.phi[:-1])
        keep = val > 1e-3 * val.max()
        self.white = vec[:, keep] / np.sqrt(val[keep])
        self.known: dict[str, np.ndarray] = {}

    def features(self, texts: list[str]) -> np.ndarray:
        fresh = [x for x in dict.fromkeys(texts) if x not in self.known]
        for lo in range(0, len(fresh), 256):
            part = fresh[lo : lo + 256]
            k = np.zeros((len(part), self.phi.shape[1]), dtype=np.float32)
            codes, owner = _coded(part)
            norm = np.zeros(len(part))
            for at, number, w in _subsequences(codes):
                norm += w * w * np.bincount(owner[at], minlength=len(part))
                column = self.place[number]
                some = column < len(self.numbers)
                rows, at = self.phi[column[some]], at[some]
                first = np.nonzero(np.diff(owner[at], prepend=-1))[0]
                if len(first):
                    k[owner[at][first]] += np.float32(w) * np.add.reduceat(rows, first, axis=0)
            k /= np.sqrt(np.maximum(norm, 1))[:, None].astype(np.float32)
            self.known.update(zip(part, k.astype(np.float64) @ self.white))
        return np.array([self.known[x] for x in texts])

    def fit(self, positive: list[str], negative: list[str]) -> Machine:
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        w, bias = _squared_hinge(self.features(positive + negative), y)
        weights = np.zeros(1 << 20, dtype=np.float32)
        weights[self.numbers] = self.phi[:-1].astype(np.float64) @ (self.white @ w)
        return Machine(weights, bias)


def _squared_hinge(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by Newton's method on the active set. Offending passages weigh WEIGHT
    times as much each as harmless ones."""
    z = np.hstack([x, np.ones((len(x), 1))])
    c = np.where(y > 0, WEIGHT, 1.0) * COST
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(y), dtype=bool)
    for _ in range(steps):
        za = z[active] * c[active, None]
        w = np.linalg.solve(ridge + za.T @ z[active], za.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _spread(items: list, most: int) -> list:
    """At most ``most`` of the items at equal distances."""
    return items[:: max(1, -(-len(items) // most))]


def train(documents: list[tuple[list[str], bool]]) -> Machine:
    """From (passages, offends) of reviewed documents and the labelled sentences."""
    base_p, base_n = [canonical(x) for x in OFFENSIVE], [canonical(x) for x in HARMLESS]
    bad = [p for p, o in documents if o and p]
    good = sorted({x for p, o in documents if not o for x in p})
    flat, sizes = [x for p in bad for x in p], np.array([len(p) for p in bad], dtype=np.int64)
    ends, fold_of = np.concatenate(([0], np.cumsum(sizes))), np.repeat(np.arange(len(bad)) % 2, sizes)

    def harmless(machine: Machine) -> list[str]:
        order = np.argsort(-machine(good), kind="stable") if good else []
        return base_n + [good[i] for i in order[:MAX_HARD]] + _spread([good[i] for i in order[MAX_HARD:]], MAX_HARD)

    machine = Landmarks(base_p + base_n + _spread(good, LANDMARKS // 2)).fit(base_p, base_n * 4 + _spread(good, MAX_HARD))
    if not bad:
        return machine
    score = machine(flat)
    chosen = score > 0
    for lo, hi in zip(ends, ends[1:]):
        chosen[lo + int(np.argmax(score[lo:hi]))] = True
    pick = lambda which: sorted({flat[i] for i in np.nonzero(which)[0]})
    marks = Landmarks(base_p + _spread(pick(chosen), LANDMARKS // 2) + base_n + _spread(harmless(machine), LANDMARKS // 2))
    machine = marks.fit(base_p + pick(chosen), harmless(machine))
    for _ in range(ROUNDS):
        # what one half of the documents teaches chooses the passages of the other, so that a reviewing error which
        # nothing else bears out does not confirm itself
        negative, after = harmless(machine), np.zeros(len(flat), dtype=bool)
        for half in (0, 1):
            other = marks.fit(base_p + pick(chosen & (fold_of == half)), negative)
            mine = fold_of != half
            after[mine] = other([x for x, m in zip(flat, mine) if m]) > 0
        chosen = after
        machine = marks.fit(base_p + pick(chosen), negative)
    return machine


def reviewed(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> list[tuple[list[str], bool]]:
    """The passages of at most MAX_LABELLED documents of either verdict, chosen by hash of their ids."""
    verdict = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.avg(F.col("toxic").cast("double")).alias("_m")).where("_m <> 0.5")
    pick = None
    for side in (F.col("_m") > 0.5, F.col("_m") < 0.5):
        some = verdict.where(side).orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
        pick = some if pick is None else pick.unionByName(some)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_spread(passages(t), MAX_OF_DOCUMENT) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], names=["h", "o", "p"])

    rows = documents.select(F.col(key).alias("_id"), F.col(text).alias("_t")).where(F.col("_t").isNotNull()).join(F.broadcast(pick), "_id")
    rows = rows.groupBy("_id").agg(F.min("_t").alias("_t"), F.min("_m").alias("_m")).select(F.xxhash64("_id").alias("h"), (F.col("_m") > 0.5).alias("o"), "_t")
    return [(list(r["p"]), r["o"]) for r in sorted(rows.mapInArrow(cut, "h long, o boolean, p array<string>").collect(), key=lambda r: (r["h"], r["p"]))]


def score_documents(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, score (0 to 1), offends and the number of offending passages of every document."""
    spark, kind = documents.sparkSession, documents.schema[key].dataType.simpleString()
    machine = train(reviewed(documents, labels, key, text))
    shared, bias = spark.sparkContext.broadcast(machine.weights), machine.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                cut = [passages(t) for t in part.column(2).to_pylist()]
                margin = score_passages([x for p in cut for x in p], weights, bias)
                best, many, at = np.full(len(cut), -np.inf), np.zeros(len(cut), dtype=np.int64), 0
                for i, p in enumerate(cut):
                    if p:
                        s = margin[at : at + len(p)]
                        best[i], many[i] = s.max(), int((s > LIMIT).sum())
                        at += len(p)
                with np.errstate(over="ignore"):
                    score = 1 / (1 + np.exp(-4 * (best - LIMIT)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array(best > LIMIT), pa.array(many)], names=[key, "source", "score", "offends", "passages"])

    return documents.select(key, F.col(source).alias("source"), text).mapInArrow(run, f"`{key}` {kind}, source string, score double, offends boolean, passages long")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, offending ones and their share for each source."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("offends").alias("offending")).withColumn("rate", F.col("offending") / F.col("documents"))
