"""Encoding of texts with a public byte-level BPE vocabulary, and the way back.

``encode`` runs the tokenizers library over Arrow batches; nothing is shuffled and only the key and the text are read.
``encode_offsets`` also gives, for each token, the character span that it covers: a byte-level token may begin or end
inside a character, so spans are found by mapping each byte to its character. ``decode`` reverses the byte table and
joins bytes before it decodes them, so characters that were split over tokens come back whole.

Defined results: a null and an empty text both give an empty list; a blank text is encoded as it stands; strings that
look like special tokens are ordinary text; lone surrogates cannot occur in a Spark string. Rows are never merged, so
repeated rows give repeated results; columns other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("LARKSPUR_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


@functools.lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary, reversed: bytes that are visible Latin-1
    characters stand for themselves, the others for the code points from 256 on, in order."""
    visible = {b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)}
    out, free = {}, 256
    for b in range(256):
        if b in visible:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


@functools.lru_cache(maxsize=4)
def _token_bytes(path: str) -> dict[int, bytes]:
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    table = byte_table()
    return {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in vocab.items()}


def encode_texts(texts: list[str | None], vocabulary: str = DEFAULT_VOCABULARY) -> list[list[int]]:
    return [e.ids for e in _tokenizer(vocabulary).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                ids = encode_texts(part.column(1).to_pylist(), vocabulary)
                ends = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def spans(text: str, ids: list[int], vocabulary: str = DEFAULT_VOCABULARY) -> list[tuple[int, int]]:
    """The characters [start, end) that each token touches; a character split over tokens belongs to each of them."""
    per_char = [len(c.encode("utf-8", "surrogatepass")) for c in text]
    char_of = np.repeat(np.arange(len(text)), per_char)
    table, at, out = _token_bytes(vocabulary), 0, []
    for i in ids:
        n = len(table[i])
        out.append((int(char_of[at]), int(char_of[at + n - 1]) + 1) if n else (0, 0))
        at += n
    return out


def encode_offsets(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key``, ``ids`` and the token spans ``starts`` and ``ends`` (array<int>, in characters)."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = encode_texts(texts, vocabulary)
            sp = [spans(t or "", i, vocabulary) for t, i in zip(texts, ids)]
            arrays = [pa.array(x, type=pa.list_(pa.int32())) for x in (ids, [[a for a, _ in s] for s in sp], [[e for _, e in s] for s in sp])]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=[key, "ids", "starts", "ends"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>, starts array<int>, ends array<int>")


def decode_ids(ids: list[int] | None, vocabulary: str = DEFAULT_VOCABULARY) -> str:
    table = _token_bytes(vocabulary)
    return b"".join(table[i] for i in ids or []).decode("utf-8", errors="replace")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``text``; null or empty ids give an empty text."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(x, vocabulary) for x in b.column(1).to_pylist()], type=pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind.simpleString()}, text string")


def round_trip_report(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Per source: documents, tokens, characters, and how many texts do not come back exactly after decoding."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = encode_texts(texts, vocabulary)
            bad = [int((t or "") != decode_ids(i, vocabulary)) for t, i in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(bad, pa.int64())], names=["source", "n", "c", "bad"])

    return df.select(F.col(source).alias("source"), text).mapInArrow(run, "source string, n long, c long, bad long").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum("c").alias("characters"), F.sum("bad").alias("changed"))
