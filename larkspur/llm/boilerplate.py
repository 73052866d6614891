"""Main body of a page by minimum-cut labelling of its lines.

Every non-blank line is a node. A logistic line classifier (trained here on the hand-labelled lines of
:mod:`line_examples`) gives each node its terminal capacities; lines that stand next to each other, and more so lines
of the same shape that stand close to each other as the items of one list would in the page's tree, are joined by
smoothness edges. The minimum cut between the two terminals is the labelling. It is found exactly: a node whose
terminal capacity is at least the sum of its edges keeps its preferred side in some minimum cut, so such nodes are
settled first, for whole Arrow batches at once, and what they say is passed on to their neighbours. On the rest the
maximum flow is that of a strip, as edges reach two lines at most, and one pass over the lines gives its minimum cut
(`_chain_sides`); graphs with longer edges go through augmenting paths, which also check that pass in the tests.

One pass over the rows, nothing is shuffled; the model is trained once, on the driver, and sent to the executors (its size
follows from the examples, not from the data).

Defined results: pieces of pages (piece column not null), null and blank contents and keyword spam have no cases; blank
lines are none; a page of one line is labelled by the classifier alone; without a source the site's name is taken from
the url's host, else no name is assumed. Repeated rows are each labelled. Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_examples import ARTICLE, BOILERPLATE
from .spam import verdict

ADJACENT = 0.35
SAME_SHAPE = 0.9
CLIP = 5.0
_TOKEN = re.compile(r"\{[bx]\}|[^\W\d_]+|0")
_NUMBER = re.compile(r"\d+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", re.I)


def site_name(source: str | None, url: str | None) -> str:
    """The words of the first label of the host, joined by single spaces."""
    host = source or ""
    if not host and url and (m := _HOST.match(url)):
        host = m[1]
    host = host.strip().lower()
    host = host[4:] if host.startswith("www.") else host
    return re.sub(r"[-_]+", " ", host.split(".")[0]).strip()


def name_pattern(name: str) -> re.Pattern | None:
    return re.compile(r"\b" + r"[^\w\n]*".join(map(re.escape, name.split(" "))) + r"\b") if name else None


def tokens(line: str) -> list[str]:
    """Words, numbers (as 0) and the marks {b} and {x} of a line in lower case with its numbers replaced by 0."""
    return _TOKEN.findall(line)


def shape(line: str, n_words: int) -> int:
    """A coarse kind of line: lines of one list, table, menu or run of links have the same."""
    s = line.strip()
    if s.count("|") >= 2:
        return 1
    if re.match(r"^(?:[-*•»>]+|\d+[.)])\s", s):
        return 2
    if s.startswith("["):
        return 3
    if n_words <= 4 and s[-1:] not in ".!?:":
        return 4
    if ": " in s and n_words <= 12:
        return 5
    if n_words <= 12 and s[-1:] not in ".!?":
        return 6
    return 7 if n_words > 12 else 8


def traits(line: str, n: int) -> list[int]:
    """What a line shows besides its words, as places among the last weights of a model."""
    out = [0 if n < 2 else 1 if n < 4 else 2 if n < 7 else 3 if n < 12 else 4 if n < 18 else 5]
    core = line.rstrip(" »-!.…*•") if line.endswith(("»", "-", "!", "...", "…")) else line
    if n > 6 and core.endswith((".", "?")):
        out.append(6 if "{b}" in line else 7)
        if n > 30:  # that a line is a long text must not be lost among its many words
            out += [out[-1]] * (n // 6)
    if line.count("|") >= 2:
        out.append(8)
    if line.count("»") + line.count(">") + line.count("·") + line.count("[") + line.count(" / ") >= 2:
        out.append(9)
    return out


N_TRAITS = 10


class _Ids(dict):
    """Word places; words in no example share place 0."""

    def __missing__(self, word: str) -> int:
        return 0


class LineModel:
    """Logistic regression over words, pairs of neighbouring words and traits, fitted by gradient descent from zero.

    Words that are in no example share one place, numbers another. The score of a line is the sum of its weights over
    the root of their number, so that long lines do not outweigh short ones."""

    def __init__(self, boilerplate: list[str], article: list[str], rounds: int = 900, rate: float = 0.5, decay: float = 1e-3) -> None:
        lines = [*boilerplate, *article]
        self.ids = _Ids({"{x}": 0, "0": 1, "{b}": 2})
        for x in lines:
            for t in tokens(x):
                self.ids.setdefault(t, len(self.ids))
        self.size = len(self.ids) + 2  # and the two line ends
        y = np.array([1.0] * len(boilerplate) + [0.0] * len(article))
        word, pair, _, line = self._places([self.encode(tokens(x)) for x in lines])
        pairs, pair = np.unique(pair, return_inverse=True)
        n_w, n_p = self.size, len(pairs)
        x = np.zeros((len(lines), n_w + n_p + N_TRAITS))
        np.add.at(x, (line[0], word), 1)
        np.add.at(x, (line[1], n_w + pair), 1)
        for i, t in enumerate(lines):
            x[i, [n_w + n_p + k for k in traits(t, len(tokens(t)))]] = 1
        x /= np.sqrt(x.sum(axis=1, keepdims=True))
        weight = np.where(y == 1, 0.5 / len(boilerplate), 0.5 / len(article)) * 8
        w, bias = np.zeros(x.shape[1]), 0.0
        for _ in range(rounds):
            off = weight * (1 / (1 + np.exp(-(x @ w + bias))) - y)
            w -= rate * (x.T @ off + decay * w)
            bias -= rate * float(off.sum())
        self.words, self.bias, self.traits = w[:n_w], bias, w[n_w + n_p :]
        self.pairs = np.zeros((self.size, self.size))
        self.pairs.reshape(-1)[pairs] = w[n_w : n_w + n_p]
        self.seen = np.zeros((self.size, self.size), dtype=bool)
        self.seen.reshape(-1)[pairs] = True

    def encode(self, toks: list[str]) -> list[int]:
        return [self.size - 2, *map(self.ids.__getitem__, toks), self.size - 1]

    def _places(self, coded: list[list[int]]):
        """Word places, pair places, lengths and the line of each, for lines with both ends marked."""
        lens = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        flat = np.fromiter((i for c in coded for i in c), dtype=np.int64, count=int(lens.sum()))
        line = np.repeat(np.arange(len(coded)), lens)
        inner = flat < self.size - 2
        two = line[1:] == line[:-1]
        return flat[inner], (flat[:-1] * self.size + flat[1:])[two], lens, (line[inner], line[1:][two])

    def log_odds(self, coded: list[list[int]], shown: list[list[int]]) -> np.ndarray:
        """For many lines at once; positive for boilerplate. Pairs met in no example count neither way."""
        n = len(coded)
        word, pair, _, (of_word, of_pair) = self._places(coded)
        known = self.seen.reshape(-1)[pair]
        total = np.bincount(of_word, self.words[word], n) + np.bincount(of_pair[known], self.pairs.reshape(-1)[pair[known]], n)
        count = np.bincount(of_word, minlength=n) + np.bincount(of_pair[known], minlength=n)
        of_trait = np.repeat(np.arange(n), [len(s) for s in shown])
        flat = np.fromiter((t for s in shown for t in s), dtype=np.int64)
        total += np.bincount(of_trait, self.traits[flat], n)
        count += np.bincount(of_trait, minlength=n)
        return total / np.sqrt(np.maximum(count, 1)) + self.bias


@functools.lru_cache(maxsize=1)
def line_model() -> LineModel:
    return LineModel(BOILERPLATE, ARTICLE)


def _max_flow_sides(u: dict[int, float], edges: dict[int, dict[int, float]]) -> dict[int, bool]:
    """Minimum cut of a small graph by augmenting paths. u > 0 ties a node to the boilerplate terminal. True: boilerplate."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i, v in u.items():
        cap.setdefault(i, {})
        if v > 0:
            cap[source][i] = v
            cap[i].setdefault(source, 0.0)
        elif v < 0:
            cap[i][sink] = -v
            cap[sink].setdefault(i, 0.0)
        for j, w in edges.get(i, {}).items():
            cap[i][j] = cap[i].get(j, 0.0) + w
            cap.setdefault(j, {}).setdefault(i, 0.0)
    while True:
        parent, queue = {source: source}, deque([source])
        while queue and sink not in parent:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 1e-12 and b not in parent:
                    parent[b] = a
                    queue.append(b)
        if sink not in parent:
            return {i: i in parent for i in u}
        flow, b = float("inf"), sink
        while b != source:
            flow, b = min(flow, cap[parent[b]][b]), parent[b]
        b = sink
        while b != source:
            a = parent[b]
            cap[a][b] -= flow
            cap[b][a] = cap[b].get(a, 0.0) + flow
            b = a


def _flow_sides(u: np.ndarray, left: np.ndarray, right: np.ndarray, w: np.ndarray, side: np.ndarray) -> None:
    """Settle the open nodes, one connected part after the other, by maximum flow."""
    near: dict[int, dict[int, float]] = {}
    for a, b, c in zip(left.tolist(), right.tolist(), w.tolist()):
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + c
        near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0.0) + c
    seen: set[int] = set()
    for start in near:
        if start in seen:
            continue
        part, queue = {start}, deque([start])
        while queue:
            for b in near[queue.popleft()]:
                if b not in part:
                    part.add(b)
                    queue.append(b)
        seen |= part
        for i, boiler in _max_flow_sides({i: float(u[i]) for i in part}, {i: near[i] for i in part}).items():
            side[i] = 1 if boiler else -1


def _chain_sides(u: np.ndarray, left: np.ndarray, right: np.ndarray, w: np.ndarray, side: np.ndarray) -> None:
    """The same where edges join lines at most two apart, as they do on a page. There the maximum flow is that of a strip,
    whose minimum cut one pass over the lines gives: the state is what the last two lines are. Linear in the lines."""
    inner = np.zeros(len(u), dtype=bool)
    inner[left] = inner[right] = True
    nodes = np.nonzero(inner)[0]
    one, two = np.zeros(len(u)), np.zeros(len(u))
    lo, gap = np.minimum(left, right), np.abs(right - left)
    np.add.at(one, lo[gap == 1] + 1, w[gap == 1])
    np.add.at(two, lo[gap == 2] + 2, w[gap == 2])
    for part in np.split(nodes, np.nonzero(np.diff(nodes) > 2)[0] + 1):
        first, n = int(part[0]), int(part[-1] - part[0]) + 1
        # a settled line between open ones has no edges left, so that either side is free of cost there
        pref, b1, b2 = np.where(inner[first : first + n], u[first : first + n], 0.0).tolist(), one[first : first + n].tolist(), two[first : first + n].tolist()
        # costs by (line before the last, last line); 0: article, 1: boilerplate
        aa = ba = 0.0 if pref[0] <= 0 else pref[0]
        ab = bb = 0.0 if pref[0] >= 0 else -pref[0]
        back: list[tuple[bool, bool, bool, bool]] = []
        for i in range(1, n):
            cost_a, cost_b = (pref[i], 0.0) if pref[i] > 0 else (0.0, -pref[i])
            e1, e2 = b1[i], b2[i]
            x1, y1 = aa + cost_a, ba + e2 + cost_a  # (article, article) after either
            x2, y2 = aa + e1 + e2 + cost_b, ba + e1 + cost_b  # (article, boilerplate)
            x3, y3 = ab + e1 + cost_a, bb + e1 + e2 + cost_a  # (boilerplate, article)
            x4, y4 = ab + e2 + cost_b, bb + cost_b  # (boilerplate, boilerplate)
            back.append((y1 < x1, y2 < x2, y3 < x3, y4 < x4))
            aa, ab, ba, bb = min(x1, y1), min(x2, y2), min(x3, y3), min(x4, y4)
        best = min(aa, ba, ab, bb)
        p, q = next((p, q) for (p, q), v in (((0, 0), aa), ((1, 0), ba), ((0, 1), ab), ((1, 1), bb)) if v == best)
        at = first + n - 1
        while True:
            if inner[at]:
                side[at] = 1 if q else -1
            if at == first:
                break
            p, q = int(back[at - first - 1][2 * p + q]), p
            at -= 1


def min_cut(u: np.ndarray, left: np.ndarray, right: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Labels (True: boilerplate) of least cost for terminal preferences ``u`` and undirected edges (left, right, w)."""
    u, n = u.astype(float).copy(), len(u)
    side = np.zeros(n, dtype=np.int8)  # 0 open, 1 boilerplate, -1 article
    while len(left):
        load = np.bincount(left, w, n) + np.bincount(right, w, n)
        settled = (side == 0) & (np.abs(u) >= load) & (u != 0)
        if not settled.any():
            break
        side[settled] = np.where(u[settled] > 0, 1, -1)
        a, b = side[left], side[right]
        for known, open_, other in ((a, b, right), (b, a, left)):
            m = (known != 0) & (open_ == 0)
            np.add.at(u, other[m], known[m] * w[m])
        keep = (a == 0) & (b == 0)
        left, right, w = left[keep], right[keep], w[keep]
    alone = side == 0
    alone[left] = alone[right] = False
    side[alone] = np.where(u[alone] > 0, 1, -1)
    if len(left):
        if np.abs(right - left).max() <= 2:
            _chain_sides(u, left, right, w, side)
        else:
            _flow_sides(u, left, right, w, side)
    return side > 0


def label_pages(pages: list[tuple[str | None, str | None, str | None]], model: LineModel, known: dict[str, tuple[float, int]] | None = None) -> list[list[int]]:
    """For (content, source, url) of each page the numbers of its boilerplate lines."""
    known = {} if known is None else known
    odds, shapes, numbers, owner = [], [], [], []
    coded, shown, places, keys = [], [], [], []
    for p, (content, source, url) in enumerate(pages):
        if not content:
            continue
        low = _NUMBER.sub("0", content.lower())
        if (name := name_pattern(site_name(source, url))) is not None:
            low = name.sub("{b}", low)
        for no, raw in enumerate(low.split("\n")):
            line = raw.strip()
            if not line:
                continue
            got = known.get(line)
            if got is None:
                toks = tokens(line)
                places.append(len(odds))
                coded.append(model.encode(toks))
                shown.append(traits(line, len(toks)))
                keys.append(line)
                got = (0.0, shape(line, len(toks)))
            odds.append(got[0])
            shapes.append(got[1])
            numbers.append(no)
            owner.append(p)
    out: list[list[int]] = [[] for _ in pages]
    if not odds:
        return out
    u, kind, own, num = np.array(odds), np.array(shapes), np.array(owner), np.array(numbers)
    if places:
        u[places] = np.clip(model.log_odds(coded, shown), -CLIP, CLIP)
        if len(known) > 100_000:
            known.clear()
        for k, at in zip(keys, places):
            if len(k) < 100:
                known[k] = (u[at], shapes[at])
    i = np.arange(len(u) - 1)
    near = own[1:] == own[:-1]
    touching = near & (num[1:] - num[:-1] == 1)
    weight = np.where(touching, ADJACENT, ADJACENT / 2) + np.where((kind[1:] == kind[:-1]) & np.isin(kind[1:], (2, 3, 5)), SAME_SHAPE, 0.0)
    left, right, w = i[near], i[near] + 1, weight[near]
    j = np.arange(max(len(u) - 2, 0))  # items of one list with another line between them
    two = (own[2:] == own[:-2]) & (kind[2:] == kind[:-2]) & np.isin(kind[2:], (2, 5)) if len(u) > 2 else np.zeros(0, dtype=bool)
    left, right, w = np.concatenate((left, j[two])), np.concatenate((right, j[two] + 2)), np.concatenate((w, np.full(int(two.sum()), ADJACENT)))
    for k in np.nonzero(min_cut(u, left, right, w))[0]:
        out[own[k]].append(int(num[k]))
    return out


def _label(df: DataFrame, key: str, text: str, source: str, url: str, piece: str, want: str, schema: str) -> DataFrame:
    whole = F.when(F.col(piece).isNull(), F.col(text))

    shared = df.sparkSession.sparkContext.broadcast(line_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                texts = part.column(1).to_pylist()
                pages = [(None if t is None or verdict(t)[1] else t, s, l) for t, s, l in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist())]
                cases = label_pages(pages, model, known)
                if want == "cases":
                    keys = np.repeat(np.arange(len(cases)), [len(c) for c in cases])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keys, pa.int32())), pa.array([n for c in cases for n in c], pa.int32())], names=[key, "line_no"])
                else:
                    body = [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone) for t, gone in zip(texts, map(set, cases))]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(body, pa.string()), pa.array([len(c) for c in cases], pa.int32())], names=[key, "article", "n_removed"])

    return df.select(F.col(key), whole.alias("_t"), F.col(source).alias("_s"), F.col(url).alias("_u")).mapInArrow(run, schema)


def find_boilerplate(df: DataFrame, key: str = "hit_id", text: str = "content", source: str = "source_domain", url: str = "url", piece: str = "chunk_id") -> DataFrame:
    """key and line_no (from 0) of every line that is not part of its page's article."""
    return _label(df, key, text, source, url, piece, "cases", f"`{key}` {df.schema[key].dataType.simpleString()}, line_no int")


def main_text(df: DataFrame, key: str = "hit_id", text: str = "content", source: str = "source_domain", url: str = "url", piece: str = "chunk_id") -> DataFrame:
    """key, article (null for pieces and null contents) and n_removed of every row."""
    return _label(df, key, text, source, url, piece, "article", f"`{key}` {df.schema[key].dataType.simpleString()}, article string, n_removed int")
