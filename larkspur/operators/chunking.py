"""Sections to chunks: filters, sliding windows by paragraph, sentence groups."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicons import SKIPPED_HEADINGS
from ..functions.text import as_column

MAX_CHARS, OVERLAP, LEAST_SECTION = 1800, 200, 50
PIECE = T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("chunk_text", T.StringType())]))


def kept_sections(docs: DataFrame, sections: str = "content.sections") -> DataFrame:
    """All columns plus section_index, heading and section_text of the sections worth chunking."""
    s = docs.select("*", F.posexplode(sections).alias("section_index", "_s"))
    head = F.when(F.trim("_s.heading") != "", F.trim("_s.heading")).otherwise("main")
    return s.withColumns({"heading": head, "section_text": F.trim("_s.text")}).drop("_s").where((F.length("section_text") >= LEAST_SECTION) & ~F.lower("heading").isin(*SKIPPED_HEADINGS))


def embedding_text(heading: str | Column, text: str | Column) -> Column:
    h, t = as_column(heading), as_column(text)
    return F.when(h.isNull() | (F.trim(h) == "") | (F.lower(h) == "main"), t).otherwise(F.concat(h, F.lit(": "), t))


def window_pieces(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Runs of paragraphs of at most ``most`` characters; a run begins with as many of the paragraphs before it as the
    overlap holds, and has at least one of its own. All from the running total of the paragraphs' lengths."""
    found = [(m.start(), m.group().strip()) for m in re.finditer(r"\S(?:.|\n(?!\n))*", text)]
    if not found:
        return [(0, len(text), text)]
    total = [0, *accumulate(len(p) for _, p in found)]
    out: list[tuple[int, int, str]] = []
    first, own, start = 0, 0, found[0][0]  # first paragraph, first that is not overlap, place in the text
    while own < len(found):
        end = max(own + 1, bisect_right(total, total[first] + most) - 1)
        body = "\n\n".join(p for _, p in found[first:end])
        out.append((start, start + len(body), body))
        first, own = max(first, bisect_left(total, total[end] - overlap)), end
        if end < len(found):
            start = found[end][0] - (total[end] - total[first])
    return out


def sentence_spans(text: str, short: int = 30, long: int = 500) -> list[tuple[int, int]]:
    """Places of sentences: a mark ends one when a capital letter follows, or, where that leaves a single very long one,
    whatever follows. A short one belongs to the unit that the next long enough one closes, a short rest to the last unit."""
    places = lambda after: [m.span() for m in re.finditer(rf"\S(?:.*?[.!?](?={after})|.*\Z)", text, re.S)]
    at = places(r"\s+[A-Z]")
    if len(at) == 1 and at[0][1] - at[0][0] > long:
        at = places(r"\s")
    size = [len(" ".join(text[a:b].split())) for a, b in at]
    closed = [0, *accumulate(n >= short for n in size)]
    last = max(closed[-1] - 1, 0)
    units = [list(g) for _, g in groupby(range(len(at)), key=lambda i: min(closed[i], last))]
    return [(at[u[0]][0], at[u[-1]][1]) for u in units]


def sentences(text: str, short: int = 30) -> list[str]:
    """The texts of :func:`sentence_spans`, white space collapsed."""
    return [" ".join(text[a:b].split()) for a, b in sentence_spans(text, short)]


def sentence_groups(similar: list[float], n: int, least: float = 0.5, fewest: int = 3, most: int = 20) -> list[int]:
    """First sentences of the groups. From one break the next is sought where a group may first end: at the first pair of
    unlike neighbours, or where the group is full. The first group may end one pair sooner than the others."""
    breaks, before = [0], -2
    while True:
        full = before + most
        at = next((i for i in range(before + fewest + 1, min(full, n - 1)) if similar[i] < least), full)
        if at >= n - 1:
            return breaks
        breaks.append(at + 1)
        before = at


def semantic_pieces(text: str, embed, least_chars: int = 150) -> list[tuple[int, int, str]]:
    """Groups of like sentences with their places in the text; a small group goes to the one before it."""
    spans = sentence_spans(text)
    if len(spans) <= 3:
        return [(0, len(text), text)] if spans else []
    v = np.asarray(embed([" ".join(text[a:b].split()) for a, b in spans]), dtype=float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    starts = sentence_groups((v[:-1] * v[1:]).sum(axis=1).tolist(), len(spans))
    out: list[tuple[int, int, str]] = []
    for a, b in zip(starts, [*starts[1:], len(spans)]):
        lo, hi = spans[a][0], spans[b - 1][1]
        if out and len(" ".join(text[lo:hi].split())) < least_chars:
            lo = out.pop()[0]
        out.append((lo, hi, " ".join(text[lo:hi].split())))
    return out


def hashed_vectors(texts: list[str], width: int = 64) -> np.ndarray:
    """Bags of words hashed into a vector: what :func:`semantic_pieces` compares sentences by when there is no encoder."""
    out = np.zeros((len(texts), width))
    for i, t in enumerate(texts):
        for w in set(re.findall(r"[a-z0-9]+", t.lower())):
            h = hashlib.md5(w.encode()).digest()
            out[i, h[0] % width] += 1 if h[1] < 128 else -1
    return out


def _pieces(cut):
    @F.pandas_udf(PIECE)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start_char": a, "end_char": b, "chunk_text": x} for a, b, x in cut(t)] if t else [])

    return run


STRATEGIES = {"window": window_pieces, "semantic": lambda t: semantic_pieces(t, hashed_vectors)}


def chunk_documents(docs: DataFrame, keep: list[str], strategy: str = "window") -> DataFrame:
    """Chunks of every kept section: whole when short enough, else by strategy. ``keep``: columns to carry along (with doc_id)."""
    s = kept_sections(docs)
    cut = _pieces(STRATEGIES[strategy])
    short = s.where(F.length("section_text") <= MAX_CHARS).select(*keep, "section_index", "heading", F.lit(0).alias("chunk_index"), F.lit(0).alias("start_char"), F.length("section_text").alias("end_char"), F.col("section_text").alias("chunk_text"))
    long = s.where(F.length("section_text") > MAX_CHARS).select(*keep, "section_index", "heading", F.posexplode(cut("section_text")).alias("chunk_index", "_p")).select(*keep, "section_index", "heading", "chunk_index", "_p.*")
    out = short.unionByName(long)
    return out.withColumns({"chunk_id": F.concat_ws(":", "doc_id", "section_index", "chunk_index"), "chunk_hash": F.sha2("chunk_text", 256)})
