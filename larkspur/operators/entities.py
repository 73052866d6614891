"""Named entities: filters, a gazetteer tagger, overlap and adjacency."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_column

LABELS = ("PROBLEM", "TREATMENT", "TEST", "ANATOMY")
ENTITY = "array<struct<text:string,label:string,start_char:int,end_char:int,score:double>>"


def kept_entities(ner: str | Column, labels: tuple[str, ...] = LABELS, least_chars: int = 3, most_words: int = 6, least_score: float = 0.5) -> Column:
    return F.filter(as_column(ner), lambda e: e["label"].isin(*labels) & (F.length(F.trim(e["text"])) >= least_chars) & (F.regexp_count(e["text"], F.lit(r"\S+")) <= most_words) & (e["score"] >= least_score))


def without_overlaps(ner: str | Column) -> Column:
    """Greedy by score (ties: earlier start): an entity that overlaps a better one is dropped; the rest in order of place.

    An array fold inside the row; no shuffle."""
    order = F.array_sort(F.transform(as_column(ner), lambda e: F.struct((-F.coalesce(e["score"], F.lit(0.0))).alias("s"), e["start_char"].alias("a"), e.alias("e"))))
    clash = lambda acc, e: F.exists(acc, lambda o: (o["a"] < e["e"]["end_char"]) & (e["a"] < o["e"]["end_char"]))
    kept = F.aggregate(order, F.slice(order, 1, 0), lambda acc, e: F.when(clash(acc, e), acc).otherwise(F.concat(acc, F.array(e))))
    return F.transform(F.array_sort(F.transform(kept, lambda o: F.struct(o["a"].alias("a"), o["e"].alias("e")))), lambda o: o["e"])


def merged_spans(rows: DataFrame, key: str, ner: str, text: str, most_gap: int = 4) -> DataFrame:
    """(key, label, start_char, end_char, spans): neighbouring spans of one label joined over at most ``most_gap``
    characters without sentence punctuation. Gaps and islands within a row's entities; keys must be unique."""
    e = rows.select(key, text, F.inline(F.col(ner)).alias("text_", "label", "a", "b", "score")).drop("text_", "score")
    w = W.partitionBy(key).orderBy("a", "b", "label")
    gap, last = F.col("a") - F.lag("b").over(w), F.lag("b").over(w)
    between = F.substring(F.col(text), last + 1, F.greatest(gap, F.lit(0)))
    joined = (F.lag("label").over(w) == F.col("label")) & gap.between(0, most_gap) & ~F.coalesce(between, F.lit("")).rlike("[.!?;:]")
    e = e.select(key, "label", "a", "b", F.when(joined, 0).otherwise(1).alias("fresh"))
    e = e.withColumn("island", F.sum("fresh").over(W.partitionBy(key).orderBy("a", "b", "label").rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy(key, "label", "island").agg(F.min("a").alias("start_char"), F.max("b").alias("end_char"), F.count("*").alias("spans")).drop("island")


def merge_adjacent(spans: list[tuple[int, int, str]], text: str, most_gap: int = 4) -> list[tuple[int, int, str]]:
    """Join neighbouring spans of one label when at most ``most_gap`` characters without sentence punctuation part them."""
    out: list[tuple[int, int, str]] = []
    for a, b, label in sorted(spans):
        if out and out[-1][2] == label and 0 <= a - out[-1][1] <= most_gap and not re.search(r"[.!?;:]", text[out[-1][1] : a]):
            out[-1] = (out[-1][0], max(b, out[-1][1]), label)
        else:
            out.append((a, b, label))
    return out


def gazetteer_tagger(terms: dict[str, str]):
    """A stand-in for a model behind the same interface: terms (lower case) to labels, longest first, whole words."""
    pattern = re.compile(r"(?<!\w)(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")(?!\w)", re.I) if terms else None

    @F.pandas_udf(T._parse_datatype_string(ENTITY))
    def tag(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = [(m.start(), m.end(), terms[m[1].lower()]) for m in pattern.finditer(t)] if t and pattern else []
            out.append([{"text": t[a:b], "label": label, "start_char": a, "end_char": b, "score": 1.0} for a, b, label in merge_adjacent(found, t or "", 0)])
        return pd.Series(out)

    return tag
