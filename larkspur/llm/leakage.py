"""Evaluation passages that stand in training text, by suffix arrays of the training text.

Each Arrow batch of documents is one shard. Words that occur in no passage cannot be part of a match, so a shard keeps
only runs of at least ``least`` words of the passages' vocabulary. Its suffix array sorts those runs' suffixes to the depth
of ``least`` words; every passage suffix, made ready once for all shards, is binary-searched in it, and hits are extended to the
longest verbatim match, whose place in the text is reported. No document is shuffled.

The passages are sent out in blocks of at most ``MAX_TEST_WORDS`` words, one after the other, each block over all
documents; no more than one block is held by the driver while it is prepared. A passage longer than a block is cut into
parts that overlap by ``least - 1`` words; its longest match is then that within a part.

Defined results: null, blank and too short texts or passages have no matches. Items with equal passages are all
reported. Repeated documents are each reported. Documents with a null key are kept under null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import words

LEAST_WORDS = 12
MAX_TEST_WORDS = 2_000_000
SHARD_ROWS = 4096


class TestSuffixes:
    """Word numbers of all passages with a break after each, and the suffixes that have at least ``least`` words."""

    __test__ = False

    def __init__(self, items: list[tuple[int, int, list[str]]], least: int) -> None:
        self.least, self.vocabulary = least, {}
        stream: list[int] = []
        for _, _, ws in items:
            stream += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws] + [0]
        sizes = np.array([len(ws) + 1 for _, _, ws in items], dtype=np.int64)
        self.items, self.skipped = np.array([i for i, _, _ in items], dtype=np.int64), np.array([s for _, s, _ in items], dtype=np.int64)
        self.stream, self.owner, self.first = np.array(stream, dtype=np.uint32), np.repeat(np.arange(len(items)), sizes), np.concatenate(([0], np.cumsum(sizes)))
        self.starts, self.keys = _suffixes(self.stream, least)


def _suffixes(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from which ``depth`` words follow without a break, and those words as byte strings that sort as the words do."""
    if len(stream) < depth:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=f"S{4 * depth}")
    whole = np.lib.stride_tricks.sliding_window_view(stream != 0, depth).all(axis=1)
    at = np.nonzero(whole)[0]
    words_ = np.lib.stride_tricks.sliding_window_view(stream, depth)[at].astype(">u4")
    return at, np.ascontiguousarray(words_).view(f"S{4 * depth}").reshape(-1)


def _runs(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of known words that are long enough."""
    edge = np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0])))
    a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    keep = b - a >= least
    return list(zip(a[keep], b[keep]))


def _extend(train: np.ndarray, test: np.ndarray, p: np.ndarray, q: np.ndarray, m: int) -> np.ndarray:
    """How many words agree from each p and q on, ``m`` of which are known to; all pairs a word at a time."""
    length, open_ = np.full(len(p), m, dtype=np.int64), np.arange(len(p))
    while len(open_):
        a, b = p[open_] + length[open_], q[open_] + length[open_]
        inside = (a < len(train)) & (b < len(test))
        open_, a, b = open_[inside], a[inside], b[inside]
        same = (train[a] == test[b]) & (train[a] != 0)
        open_ = open_[same]
        length[open_] += 1
    return length


def find_in_shard(texts: list[str | None], test: TestSuffixes) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, first word in the text, first word in the passage, words) of the longest match of each pair."""
    least, vocabulary = test.least, test.vocabulary
    parts, rows, places = [], [], []
    for r, t in enumerate(texts):
        if not t or len(t) < 2 * least - 1:
            continue
        ids = np.fromiter((vocabulary.get(w, 0) for w in words(t)), dtype=np.uint32)
        for a, b in _runs(ids, least):
            parts += [ids[a:b], np.zeros(1, dtype=np.uint32)]
            rows.append(np.full(b - a + 1, r))
            places.append(np.arange(a, b + 1))
    if not parts or not len(test.starts):
        return []
    train, row, place = np.concatenate(parts), np.concatenate(rows), np.concatenate(places)
    at, keys = _suffixes(train, least)
    order = np.argsort(keys, kind="stable")  # the shard's suffix array
    array, sorted_keys = at[order], keys[order]
    lo, hi = np.searchsorted(sorted_keys, test.keys, "left"), np.searchsorted(sorted_keys, test.keys, "right")
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in np.nonzero(hi > lo)[0]:
        q = int(test.starts[k])
        p = array[lo[k] : hi[k]]
        if q and test.stream[q - 1]:
            # what agrees a word earlier too is part of a longer match that starts there
            p = p[(p == 0) | (train[p - 1] != test.stream[q - 1])]
        if not len(p):
            continue
        length = _extend(train, test.stream, p, np.full(len(p), q), least)
        item = int(test.owner[q])
        skip = int(test.skipped[item]) + q - int(test.first[item])
        best = np.lexsort((p, -length, row[p]))
        best = best[np.diff(row[p][best], prepend=-1) != 0]
        for r, w, m in zip(row[p][best].tolist(), place[p][best].tolist(), length[best].tolist()):
            if (r, item) not in out or m > out[r, item][2]:
                out[r, item] = (w, skip, m)
    return [(r, i, *v) for (r, i), v in out.items()]


def _blocks(items: Iterable[tuple[int, str]], most: int, least: int) -> Iterator[list[tuple[int, int, list[str]]]]:
    """(item, words before, words) gathered up to ``most`` words."""
    block: list[tuple[int, int, list[str]]] = []
    size = 0
    for i, p in items:
        ws = words(p)
        step = max(1, most - least + 1)
        for at in range(0, max(1, len(ws) - least + 1), step):
            part = ws[at : at + most]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((i, at, part))
            size += len(part)
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", least: int = LEAST_WORDS, most: int = MAX_TEST_WORDS) -> DataFrame:
    """One row per document and item that shares at least ``least`` consecutive words: key, item, text_word, passage_word, n_words."""
    spark, kind = documents.sparkSession, documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item}` long, text_word long, passage_word long, n_words long"
    rows = documents.select(key, text)

    def search(block: list[tuple[int, int, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = TestSuffixes(shared.value, least)
            for b in batches:
                for at in range(0, b.num_rows, SHARD_ROWS):
                    part = b.slice(at, SHARD_ROWS)
                    found = find_in_shard(part.column(1).to_pylist(), test)
                    cols = list(zip(*found)) if found else [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(cols[0], pa.int32())), pa.array(test.items[list(cols[1])] if found else [], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                        names=[key, item, "text_word", "passage_word", "n_words"],
                    )

        return rows.mapInArrow(run, schema)

    tests = items.where(F.col(passage).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long"), passage).distinct().orderBy(item, passage)
    out: DataFrame | None = None
    for block in _blocks(((r[0], r[1]) for r in tests.toLocalIterator()), most, least):
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy(key, item).agg(F.max(F.struct("n_words", (-F.col("text_word")).alias("_t"), "passage_word")).alias("_m")).select(key, item, (-F.col("_m._t")).alias("text_word"), "_m.passage_word", "_m.n_words")


def clean_documents(documents: DataFrame, leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents without any leaked passage; documents with a null key are judged by no join and stay."""
    return documents.join(leaks.select(key).distinct(), key, "left_anti")
