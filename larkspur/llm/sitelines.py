"""Lines repeated over the documents of one source.

Each content is normalised line by line and cut by content-defined chunking: a rolling hash over the normalised bytes
marks cut points, and a line's end is always one, as a line is the unit in which cases are reported. A content without
line ends is cut by the rolling hash alone. The distinct documents of each (source, chunk) are counted. A line of one
chunk is a case when that chunk reaches the limit. A longer line is a candidate when every one of its chunks does; as
they may come from different lines, the candidates' whole lines are counted too, which loses none, since a line in
``least_docs`` documents brings all its chunks into as many. Hashes have 64 bits and are compared within one source only:
among the 10 million distinct lines of a very large source two collide with a chance of 3 in a million.

Counts are made in two steps (distinct (source, chunk, document), then a count), both combined before the shuffle, so
that a chunk found in a third of all documents is never gathered anywhere. Only 64-bit hashes are shuffled, no text.

Defined results: rows with a null or blank source, a null document id or a null content have no cases; lines whose
normalised form is shorter than ``LEAST_CHARS`` are none. Copies of a page under one document id count once.
Repeated rows are each reported. Cleaning keeps all other columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .text import mix

LEAST_CHARS = 20
LEAST_DOCS = 6
WINDOW = 16
LANDMARK_MASK = np.uint64(0xFF)
_DIGITS = re.compile(r"\d+")
_OTHER = re.compile(r"[\W_]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def normalise_line(line: str) -> str:
    return _OTHER.sub(" ", _DIGITS.sub("0", line.lower())).strip()


def normalise_source(column) -> F.Column:
    """Lower case, without a leading ``www.``; null for blank."""
    s = F.regexp_replace(F.lower(F.trim(column)), r"^www\.", "")
    return F.when(s != "", s)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class LineChunker:
    """Chunks and whole hashes of many normalised lines at once."""

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=np.uint64))
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each whole line, hashes of all chunks, number of chunks in each line)."""
        raw = [x.encode() for x in lines]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(data)
        if len(self.up) <= n + 1:
            self.up, self.down = _powers(2 * n + 2, _BASE), _powers(2 * n + 2, _INVERSE)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.table[data] * self.up[:n], out=total[1:])
            ends = np.cumsum(lens)
            starts = ends - lens
            cut = np.zeros(n + 1, dtype=bool)
            if n > WINDOW:
                roll = mix((total[WINDOW:] - total[:-WINDOW]) * self.down[: n - WINDOW + 1])
                at = np.nonzero((roll & LANDMARK_MASK) == 0)[0] + WINDOW
                line_of = np.searchsorted(ends, at - 1, "right")
                at = at[at - WINDOW >= starts[np.minimum(line_of, len(starts) - 1)]]  # the window lies within one line
                cut[at] = True
            cut[ends] = True
            bounds = np.nonzero(cut)[0]
            bounds = bounds[bounds > 0]
            first = np.concatenate(([0], bounds[:-1]))
            chunk = mix((total[bounds] - total[first]) * self.down[first] + (bounds - first).astype(np.uint64))
            whole = mix((total[ends] - total[starts]) * self.down[starts] + lens.astype(np.uint64) * np.uint64(3))
            head = np.searchsorted(first, starts)
            count = np.diff(np.concatenate((head, [len(first)])))
        return whole, chunk, count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def line_hashes(rows: DataFrame, kind: str) -> DataFrame:
    """From (_key, _source, _doc, _text): the same without the text, and arrays line_no, line (hash) and chunks (hashes) of
    each countable line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = LineChunker()
        known: dict[str, str] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lines, numbers, sizes = [], [], []
                for text in part.column(3).to_pylist():
                    before = len(lines)
                    for no, line in enumerate(text.split("\n")):
                        if len(line) < LEAST_CHARS:
                            continue
                        norm = known.get(line)
                        if norm is None:
                            norm = normalise_line(line)
                            if len(known) > 200_000:
                                known.clear()
                            if len(line) < 160:
                                known[line] = norm
                        if len(norm) >= LEAST_CHARS:
                            lines.append(norm)
                            numbers.append(no)
                    sizes.append(len(lines) - before)
                ends = lambda counts: pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                whole, chunk, count = chunker(lines) if lines else (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))
                each = pa.ListArray.from_arrays(ends(count), _signed(chunk))
                cols = [pa.ListArray.from_arrays(ends(sizes), c) for c in (pa.array(numbers, pa.int32()), _signed(whole), each)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *cols], names=["_key", "_source", "_doc", "line_no", "line", "chunks"])

    return rows.mapInArrow(run, f"_key {kind}, _source long, _doc long, line_no array<int>, line array<long>, chunks array<array<long>>")


def _frequent(rows: DataFrame, key: str, least_docs: int) -> DataFrame:
    """The (_source, key) found in at least ``least_docs`` documents."""
    return rows.groupBy("_source", key, "_doc").agg(F.lit(1)).groupBy("_source", key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_docs).select("_source", key)


def find_repeated_lines(df: DataFrame, key: str = "hit_id", text: str = "content", source: str = "source_domain", doc: str = "doc_id", least_docs: int = LEAST_DOCS) -> DataFrame:
    """key and line_no (from 0) of every occurrence of a line that stands in at least ``least_docs`` documents of its source."""
    kind = df.schema[key].dataType.simpleString()
    src = normalise_source(F.col(source))
    rows = df.where(src.isNotNull() & F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(src).alias("_source"), F.xxhash64(doc).alias("_doc"), F.col(text).alias("_text"))
    hashed = materialize(line_hashes(rows, kind), "lines").where(F.size("line_no") > 0)
    pages = hashed.select("_source", "_doc", F.explode(F.flatten("chunks")).alias("chunk"))
    chunks = materialize(_frequent(pages, "chunk", least_docs), "chunks")
    each = hashed.select("_key", "_source", "_doc", F.inline(F.arrays_zip("line_no", "line", "chunks")))
    single = each.where(F.size("chunks") == 1).select("_key", "line_no", "_source", F.get("chunks", F.lit(0)).alias("chunk"))
    single = single.join(chunks, ["_source", "chunk"], "left_semi").select(F.col("_key").alias(key), "line_no")

    # a distinct longer line of a source stands or falls by its distinct chunks
    long = each.where(F.size("chunks") > 1)
    parts = long.select("_source", "line", F.array_distinct("chunks").alias("c")).select("_source", "line", F.size("c").alias("n"), F.explode("c").alias("chunk")).distinct()
    whole = parts.join(chunks, ["_source", "chunk"], "left_semi").groupBy("_source", "line", "n").agg(F.count("*").alias("held")).where("held = n").select("_source", "line")
    candidates = materialize(long.select("_key", "_source", "_doc", "line_no", "line").join(whole, ["_source", "line"], "left_semi"), "candidates")
    lines = _frequent(candidates.select("_source", "_doc", "line"), "line", least_docs)
    return single.unionByName(candidates.join(lines, ["_source", "line"], "left_semi").select(F.col("_key").alias(key), "line_no"))


def remove_lines(df: DataFrame, cases: DataFrame, key: str = "hit_id", text: str = "content", out: str = "clean_content") -> DataFrame:
    """``df`` with ``out``: the content without the given lines. ``key`` must be unique; other lines stay as they are."""
    gone = cases.groupBy(F.col(key).alias("_k")).agg(F.collect_set("line_no").alias("_gone"))
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_text"), F.struct("*").alias("_row"))
    kept = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return rows.join(gone, "_k", "left").withColumn("_clean", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept)).select("_row.*", "_clean").withColumnRenamed("_clean", out)


def chunk_spans(text: str | None) -> list[tuple[int, int]]:
    """Character spans of the content-defined chunks of a text without regard to lines: cuts fall at word ends where the
    rolling hash over the last WINDOW bytes (lower case) has its low bits clear."""
    if not text:
        return []
    ends = [m.end() for m in re.finditer(r"\S+", text)]
    chunker, cuts, last = LineChunker(), [], 0
    data = text.lower().encode("utf-8", "replace")
    n = len(data)
    if n <= WINDOW or not ends:
        return [(0, len(text))]
    with np.errstate(over="ignore"):
        up, down = _powers(n + 2, _BASE), _powers(n + 2, _INVERSE)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(chunker.table[np.frombuffer(data, dtype=np.uint8)] * up[:n], out=total[1:])
        roll = mix((total[WINDOW:] - total[:-WINDOW]) * down[: n - WINDOW + 1])
    marked = np.nonzero((roll & np.uint64(0x1F)) == 0)[0] + WINDOW
    if len(data) != len(text):  # byte places to character places
        char_of = np.repeat(np.arange(len(text)), [len(c.lower().encode("utf-8", "replace")) for c in text])
        marked = char_of[np.minimum(marked, n - 1)]
    word_ends = np.array(ends)
    for m in np.unique(np.searchsorted(word_ends, marked)):
        if m < len(word_ends) and word_ends[m] > last:
            cuts.append((last, int(word_ends[m])))
            last = int(word_ends[m])
    if last < len(text):
        cuts.append((last, len(text)))
    return cuts


def cut_repeated_chunks(df: DataFrame, key: str = "hit_id", text: str = "content", source: str = "source_domain", doc: str = "doc_id", least_docs: int = LEAST_DOCS) -> DataFrame:
    """key and ``clean_content`` after cutting content-defined chunks (newlines ignored) of at least LEAST_CHARS
    normalised characters found in ``least_docs`` documents of the source. Rows without a source keep their content."""
    kind = df.schema[key].dataType.simpleString()
    src = normalise_source(F.col(source))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(src).alias("_source"), F.xxhash64(doc).alias("_doc"), src.isNotNull().alias("_has"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            starts, hashes, sizes = [], [], [0]
            for t in b.column(4).to_pylist():
                spans = chunk_spans(t)
                starts += [a + 1 for a, _ in spans]
                for a, e in spans:
                    norm = normalise_line(t[a:e])
                    hashes.append(xxhash.xxh3_64_intdigest(norm.encode()) - (1 << 63) if len(norm) >= LEAST_CHARS else None)
                sizes.append(len(starts))
            ends = pa.array(sizes, pa.int32())
            cols = [pa.ListArray.from_arrays(ends, pa.array(starts, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(hashes, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["_key", "_source", "_doc", "_has", "_text", "_at", "_h"])

    cut = materialize(rows.mapInArrow(run, f"_key {kind}, _source long, _doc long, _has boolean, _text string, _at array<int>, _h array<long>"), "chunks")
    each = cut.where("_has").select("_key", "_source", "_doc", F.explode("_h").alias("h")).where("h is not null")
    common = _frequent(each.select("_source", "_doc", "h"), "h", least_docs)
    gone = each.join(common, ["_source", "h"], "left_semi").groupBy(F.col("_key").alias("_k")).agg(F.collect_set("h").alias("_gone"))
    # only keys and hashes meet in the join; the text is cut by its spans
    stop = lambda i: F.coalesce(F.try_element_at("_at", i + 2), F.length("_text") + 1)
    piece = lambda a, i: F.when(F.array_contains("_gone", F.get("_h", i)), F.lit("")).otherwise(F.substring(F.col("_text"), a, stop(i) - a))
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_at", piece), ""))
    return cut.join(gone, F.col("_key") == F.col("_k"), "left").select(F.col("_key").alias(key), kept.alias("clean_content"))
