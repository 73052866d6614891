"""Splitting of items over a size limit into overlapping pieces.

Cut points are content-defined: a rolling hash over the last few tokens marks landmarks, and each cut snaps to the natural
boundary nearest to a landmark, between the least and the greatest piece size. As landmarks depend on nearby tokens
only, an edit alters the pieces around it and leaves the rest.

Whether a row is too long is decided in the JVM; Python gets only rows that must be cut. The configuration table is
broadcast after its row count has been checked against ``MAX_CONFIGS``; a larger one is joined by shuffle.

Defined results: null and blank contents, contents within the limit, rows without a known configuration and
configurations with a null or non-positive size give no pieces. An overlap of at least the size is lowered to size - 1.
Tokens are maximal runs of characters that are not Unicode white space; a token is never cut, whatever its length.
Repeated rows each give their pieces. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CONFIGS = 10_000
WINDOW = 5
LANDMARK_MASK = np.uint64(0x1F)
#: Unicode's White_Space characters (fixed values).
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_TOKEN = re.compile(f"[^{SPACE}]+")
_BREAKS = frozenset("\n\r\u2028\u2029")
_JAVA_TOKEN = "[^" + "".join(f"\\u{ord(c):04x}" for c in SPACE) + "]+"


def count_tokens(text: str | None) -> int:
    return sum(1 for _ in _TOKEN.finditer(text or ""))


def _boundaries(text: str, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Strength of the boundary after each token: 3 paragraph, 2 line or sentence, 1 clause, 0 none."""
    strength = np.zeros(len(ends), dtype=np.int8)
    for i in range(len(ends) - 1):
        gap = text[ends[i] : starts[i + 1]]
        last = text[ends[i] - 1]
        if not _BREAKS.isdisjoint(gap):
            strength[i] = 3 if gap.count("\n") > 1 or "\u2029" in gap else 2
        elif last in ".!?…。" or (last in "\"')”’]" and ends[i] - starts[i] > 1 and text[ends[i] - 2] in ".!?…"):
            strength[i] = 2
        elif last in ",;:)—–":
            strength[i] = 1
    strength[-1] = 3
    return strength


def _landmarks(tokens: list[str]) -> np.ndarray:
    """True where the rolling hash of the last WINDOW tokens has its low bits clear."""
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) for t in tokens), dtype=np.uint64, count=len(tokens))
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        roll = np.zeros(len(h), dtype=np.uint64)
        for k in range(WINDOW):
            roll[k:] = roll[k:] * base + h[: len(h) - k] if k else h
        roll ^= roll >> np.uint64(29)
    return (roll & LANDMARK_MASK) == 0


def split_text(text: str | None, size: int | None, overlap: int | None = 0, least: int | None = 0, sentences: bool | None = True) -> list[tuple[int, int, int, int]]:
    """Pieces as (first token, token after the last, first character, character after the last)."""
    if not text or not size or size <= 0:
        return []
    found = [m.span() for m in _TOKEN.finditer(text)]
    n = len(found)
    if n <= size:
        return []
    starts, ends = np.array([a for a, _ in found]), np.array([b for _, b in found])
    over = min(max(overlap or 0, 0), size - 1)
    strength = _boundaries(text, ends, starts)
    marks = _landmarks([text[a:b] for a, b in found])
    wanted = 2 if sentences else 1
    pieces, begin = [], 0
    while True:
        if n - begin <= size:
            pieces.append((begin, n))
            break
        high = begin + size
        fresh = begin + over
        low = min(max(fresh + 1, begin + max(least or 0, size // 2)), high)
        at = np.arange(low, high + 1) - 1  # a cut after token t
        s = strength[at]
        best = at[s == s.max()] if s.max() < wanted else at[s >= wanted]
        if s.max() == 0:
            best = at
        near = at[marks[at]]
        if len(near):
            gap = np.abs(best[:, None] - near[None, :]).min(axis=1)
            cut = int(best[len(gap) - 1 - int(np.argmin(gap[::-1]))])
        else:
            cut = int(best[-1])
        pieces.append((begin, cut + 1))
        begin = cut + 1 - over
    return [(a, b, int(starts[a]), int(ends[b - 1])) for a, b in pieces]


def split_oversized(df: DataFrame, configs: DataFrame, key: str = "hit_id", text: str = "content", config: str = "chunk_config") -> DataFrame:
    """Pieces of every row over its limit: key, piece_no, first_token, n_tokens, start_char, end_char, shared_tokens, piece."""
    limits = configs.where(F.col("chunk_size") > 0).groupBy(F.col("config_name").alias("_config")).agg(
        F.max(F.struct("chunk_size", "overlap_tokens", "min_chunk_size", "preserve_sentences")).alias("_limit")
    )
    small = limits.limit(MAX_CONFIGS + 1).count() <= MAX_CONFIGS
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(config).alias("_config")).where(F.col("_text").isNotNull())
    long = (
        rows.join(F.broadcast(limits) if small else limits, "_config")
        .where(F.length("_text") > 2 * F.col("_limit.chunk_size") - 1)  # n tokens need at least 2n - 1 characters
        .where(F.regexp_count("_text", F.lit(_JAVA_TOKEN)) > F.col("_limit.chunk_size"))
        .select("_key", "_text", "_limit.*")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 6)))):
                text, size, over, least, sentences = row
                before = 0
                for no, (a, e, ca, ce) in enumerate(split_text(text, size, over, least, sentences)):
                    keys.append(i)
                    out.append((no, a, e - a, ca, ce, max(0, before - a), text[ca:ce]))
                    before = e
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[key, "piece_no", "first_token", "n_tokens", "start_char", "end_char", "shared_tokens", "piece"])

    return long.mapInArrow(run, f"`{key}` {kind}, piece_no int, first_token long, n_tokens long, start_char long, end_char long, shared_tokens long, piece string")
