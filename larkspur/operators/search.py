"""Retrieval pipelines for many queries at once: a stored index, requests with filters, hybrid and two-stage search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_column, round6, tokens
from ..runtime import materialize, spread
from . import blocks, fusion, lexical

DIMENSIONS = 64

_INDEXES: dict[tuple[str, str], "Index"] = {}


class Index:
    """Postings of a corpus, stored in blocks of documents (``blocks.postings``), with the sizes of the fields and how many
    documents hold each term: a request tokenises no document. Document keys are unique.

    Queries of the same terms are worked off once. The driver holds the distinct sets of terms, and of the asked terms
    those that any document has."""

    def __init__(self, stored: DataFrame, fields: list[str], tags: bool) -> None:
        self.stored, self.fields, self.tags = stored, fields, tags
        self.sizes = {r["field"]: r for r in blocks.sizes(stored, fields).collect()}
        self.freq = materialize(blocks.frequencies(stored, len(fields) + tags), "frequencies")

    @classmethod
    def build(cls, docs: DataFrame, key: str, fields: list[str], tags: str | None = None) -> Index:
        """tags: an array of words for :meth:`top` to boost by."""
        stored = blocks.postings(spread(docs.select(key, *fields, *[tags] * bool(tags))), key, fields, tags)
        return cls(materialize(stored, "index", **blocks.STORED), fields, tags is not None)

    def _asked(self, words: DataFrame, tags: DataFrame | None = None) -> list[dict[str, float]]:
        """Of each field the asked terms that documents have, with their weight. words, tags: (term)."""
        wanted = words.select("term").distinct().join(self.freq.where(F.col("at") < len(self.fields)), "term")
        if tags is not None:
            wanted = wanted.unionByName(tags.select("term").distinct().join(self.freq.where(F.col("at") == len(self.fields)), "term"))
        out: list[dict[str, float]] = [{} for _ in range(len(self.fields) + (tags is not None))]
        for r in sorted(wanted.collect(), key=lambda r: r["term"]):
            n = self.sizes[self.fields[r["at"]]]["n"] if r["at"] < len(self.fields) else 0
            out[r["at"]][r["term"]] = math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)) if n else 0.0
        return out

    def _weighed(self, asked: list[dict[str, float]]) -> DataFrame:
        average = [self.sizes[f]["avg_len"] if f in self.sizes else 0.0 for f in self.fields]
        return materialize(blocks.weighed(self.stored, asked, [*average, 0.0], lexical.K1, lexical.B), "asked", **blocks.STORED)

    def scores(self, terms: DataFrame, boosts: dict[str, float], every_term: bool = False) -> DataFrame:
        """(query, doc, score) of every document that holds an asked term; terms: (query, term, n_terms). These are many:
        :meth:`top` and :meth:`hits` don't make them."""
        asked = self._asked(terms)
        return lexical.score(blocks.exploded(self._weighed(asked), self.fields, asked), terms, boosts, every_term)

    def _sets(self, terms: DataFrame, known: set[str], every_term: bool, tags: DataFrame | None) -> tuple[DataFrame, list[tuple]]:
        """(query, set), and the sets: (set, terms, number of terms, tags). Terms that no document has are left out."""
        words = terms.sparkSession.createDataFrame([(t,) for t in sorted(known)], "term string")
        each = terms.join(words, "term").groupBy("query").agg(F.sort_array(F.collect_list("term")).alias("terms"), (F.max("n_terms") if every_term else F.lit(0)).cast("int").alias("n"))
        if tags is not None:
            each = each.join(tags.groupBy("query").agg(F.sort_array(F.collect_set("term")).alias("tags")), "query", "full_outer")
        none = F.array().cast("array<string>")
        each = materialize(each.select("query", F.coalesce("terms", none).alias("terms"), F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("tags", none) if tags is not None else none).alias("tags")), "asking")
        sets = materialize(each.select("terms", "n", "tags").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
        listed = sorted(((r["set"], r["terms"], r["n"], r["tags"]) for r in sets.collect()), key=lambda x: x[1:])
        return each.join(sets, ["terms", "n", "tags"]).select("query", "set"), listed

    def top(self, terms: DataFrame, boosts: dict[str, float], k: int, offset: int = 0, every_term: bool = False, tags: DataFrame | None = None, tag_boost: float = 3.0) -> DataFrame:
        """(query, doc, score, rank): what ``lexical.top_k`` makes of :meth:`scores`. With ``tags``, (query, term), documents
        that share a tag with the query have ``tag_boost`` more, whether they hold a term or not. Boosts are positive."""
        if min([*boosts.values(), tag_boost]) <= 0 or not set(boosts) <= set(self.fields):
            raise ValueError("boosts must be positive and name fields of the index")
        asked = self._asked(terms, tags)
        queries, sets = self._sets(terms, {t for a in asked[: len(self.fields)] for t in a}, every_term, tags)
        found = blocks.best(self._weighed(asked), sets, asked, [float(boosts.get(f, 0.0)) for f in self.fields], k + offset, every_term, tag_boost if tags is not None else None)
        if offset:
            found = found.where(F.col("rank") > offset)
        return queries.join(found, "set").select("query", "doc", "score", "rank")

    def hits(self, terms: DataFrame) -> DataFrame:
        """(query, hits): how many documents hold an asked term, for queries that have any."""
        asked = self._asked(terms)
        queries, sets = self._sets(terms, {t for a in asked for t in a}, False, None)
        return queries.join(blocks.hits(self._weighed(asked), sets, asked), "set").select("query", "hits")


def index_of(docs: DataFrame, name: str, key: str, fields: list[str], tags: str | None = None) -> Index:
    """The index of a corpus under this name, built once in a Spark application."""
    at = (docs.sparkSession.sparkContext.applicationId, f"{name} {tags or ''}")
    if at not in _INDEXES:
        _INDEXES[at] = Index.build(docs, key, fields, tags)
    return _INDEXES[at]


# embedding -----------------------------------------------------------------------------------------------------------


def _place(token: str) -> tuple[int, int]:
    h = hashlib.md5(token.encode()).hexdigest()
    return int(h[:2], 16) % DIMENSIONS, 1 if h[2] < "8" else -1


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hashed(words: pd.Series) -> pd.Series:
    known: dict[str, tuple[int, int]] = {}

    def one(ws) -> list[float] | None:
        if ws is None or not len(ws):
            return None
        v = np.zeros(DIMENSIONS)
        for w in ws:
            if w not in known:
                known[w] = _place(w)
            d, s = known[w]
            v[d] += s
        n = np.sqrt((v * v).sum())
        return (v / n).tolist() if n > 0 else None

    return words.map(one)


def embed(text: str | Column) -> Column:
    """A hashed-feature vector of unit length: each distinct token adds or takes one at the place that its MD5 gives. It
    stands in for an encoder behind the same place in a plan; null for texts without tokens and for sums of zero."""
    return _hashed(F.array_distinct(tokens(text)))


def pool(vectors_: str | Column, how: str = "mean") -> Column:
    """One unit vector from an array of token vectors: their mean, their greatest values, or the first of them."""
    v = as_column(vectors_)
    if how == "cls":
        one = F.get(v, F.lit(0))
    else:
        first = F.transform(F.get(v, F.lit(0)), lambda x: x.cast("double"))
        step = (lambda p, q: p + q) if how == "mean" else (lambda p, q: F.greatest(p, q))
        one = F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), first, lambda acc, x: F.zip_with(acc, x, step))
    norm = F.sqrt(F.aggregate(one, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(one, lambda x: x / norm))


# pipelines -----------------------------------------------------------------------------------------------------------


def _vector_blocks(docs: DataFrame) -> DataFrame:
    """(doc, values): blocks of documents with the whole numbers that :func:`embed` brings to unit length. docs: (doc, text)."""
    base = docs.where("doc IS NOT NULL").select("doc", F.array_distinct(tokens("text")).alias("t")).where(F.size("t") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, blocks.BLOCK):
                b = batch.slice(at, blocks.BLOCK)
                words, values = b.column(1).flatten().dictionary_encode(), np.zeros((b.num_rows, DIMENSIONS), dtype=np.int32)
                places = np.array([_place(w) for w in words.dictionary.to_pylist()])[words.indices.to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
                np.add.at(values, (row, places[:, 0]), places[:, 1].astype(np.int32))
                yield pa.RecordBatch.from_pydict({"doc": pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type)), "values": pa.array([values.tobytes()], pa.binary())})

    return base.mapInArrow(run, f"doc array<{docs.schema['doc'].dataType.simpleString()}>, values binary")


def _token_sets(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, set), and the sets (set, terms) of distinct tokens: queries of the same words are worked off once."""
    each = queries.where("query IS NOT NULL").select("query", F.array_sort(F.array_distinct(tokens("text"))).alias("terms")).where(F.size("terms") > 0)
    each = materialize(each, "query-tokens")
    sets = materialize(each.select("terms").distinct().select(F.monotonically_increasing_id().alias("set"), "terms"), "token-sets")
    return each.join(sets, "terms").select("query", "set"), sets


def _similar(sets: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """(set, doc, score, rank); sets: (set, terms)."""
    asked = []
    for r in sets.orderBy("terms").collect():
        v = np.zeros(DIMENSIONS)
        for w in r["terms"]:
            d, s = _place(w)
            v[d] += s
        if v.any():
            asked.append((r["set"], v))
    return blocks.similar(materialize(_vector_blocks(docs), "vectors", **blocks.STORED), asked, k, least)


def semantic(queries: DataFrame, docs: DataFrame, k: int = 100, least: float = 0.3) -> DataFrame:
    """(query, doc, score, rank): documents by cosine, from ``least`` on. queries: (query, text); docs: (doc, text)."""
    of, sets = _token_sets(queries)
    return of.join(_similar(sets, docs, k, least), "set").select("query", "doc", "score", "rank")


def hybrid(index: Index, queries: DataFrame, docs: DataFrame, boosts: dict[str, float], k: int = 100, least: float = 0.3, top: int | None = None) -> DataFrame:
    """(query, item, score, rank): both legs' best k fused by reciprocal rank. queries: (query, text)."""
    of, sets = _token_sets(queries)
    terms = sets.select(F.col("set").alias("query"), F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    lex = index.top(terms, boosts, k).select("query", F.lit("lexical").alias("source"), F.col("doc").alias("item"), "rank", "score")
    sem = _similar(sets, docs, k, least).select(F.col("set").alias("query"), F.lit("vector").alias("source"), F.col("doc").alias("item"), "rank", "score")
    fused = fusion.reciprocal_rank(lex.unionByName(sem).repartition("query"), top=top)  # neither the sums nor the order need another shuffle
    return of.join(fused.withColumnRenamed("query", "set"), "set").select("query", "item", "score", "rank")


def rerank(candidates: DataFrame, queries: DataFrame, texts: DataFrame, k: int = 10) -> DataFrame:
    """(query, item, score, original_rank, rank): candidates by the share of the query's words that their text holds.

    candidates: (query, item, rank); queries: (query, text), whose words the driver holds; texts: (item, text). Of the texts
    only asked words are moved. Stands in for a cross encoder."""
    words = {r[0]: r[1] for r in queries.where("query IS NOT NULL").select("query", F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).collect()}
    shared = texts.sparkSession.sparkContext.broadcast(words)
    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((candidates, "query"), (texts, "item"))}

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sorted({w for ws in shared.value.values() for w in ws}), pa.string())
        for b in batches:
            kept = pc.is_in(b.column(1).flatten(), value_set=known)
            ends = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b.column(1).flatten().filter(kept))], names=["item", "words"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[float] = []
            found = pc.list_flatten(b.column("of"))
            counts, ids = pc.list_value_length(b.column("of")).to_numpy(zero_copy_only=False), found.field("query").to_pylist()
            at = 0
            for n, held in zip(counts, b.column("words").to_pylist()):
                held = frozenset(held or ())
                for q in ids[at : at + n]:
                    ws = shared.value.get(q)
                    out.append(-1.0 if ws is None else sum(w in held for w in ws) / max(len(ws), 1))
                at += n
            item = b.column("item").take(pa.array(np.repeat(np.arange(b.num_rows), counts)))
            yield pa.RecordBatch.from_arrays([found.field("query"), item, found.field("original_rank"), pa.array(out, pa.float64())], names=["query", "item", "original_rank", "score"])

    t = texts.select("item", F.coalesce(F.array_distinct(tokens("text")), F.array().cast("array<string>")).alias("t")).mapInArrow(asked, f"item {kind['item']}, words array<string>")
    each = candidates.groupBy("item").agg(F.collect_list(F.struct("query", F.col("rank").alias("original_rank"))).alias("of"))
    s = each.join(t, "item", "left").select("item", "of", "words").mapInArrow(shares, f"query {kind['query']}, item {kind['item']}, original_rank int, score double")
    w = W.partitionBy("query").orderBy(F.col("score").desc(), "original_rank")
    return s.where("score >= 0").withColumn("score", round6("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "item", "original_rank", "score", "rank")


def two_stage(index: Index, queries: DataFrame, expanded: DataFrame, docs: DataFrame, texts: DataFrame, boosts: dict[str, float], candidates: int = 100, k: int = 10, excluded: DataFrame | None = None) -> DataFrame:
    """Hybrid retrieval by the expanded queries, then what is excluded is taken out and the rest reranked by the original
    ones. queries, expanded: (query, text); docs: (doc, text) for the vectors; texts: (item, text); excluded: (query, item).
    Queries that are the same in both forms are worked off once, unless something is excluded."""
    each = queries.select("query", F.col("text").alias("asked")).join(expanded.select("query", F.col("text").alias("expanded")), "query")
    each = materialize(each, "expanded")  # long expressions are not worked out twice
    if excluded is not None:
        found = hybrid(index, each.select("query", F.col("expanded").alias("text")), docs, boosts, candidates, top=candidates)
        found = found.join(excluded.select("query", "item").distinct(), ["query", "item"], "left_anti")
        return rerank(found, each.select("query", F.col("asked").alias("text")), texts, k)
    words = lambda c: F.array_sort(F.array_distinct(tokens(F.coalesce(c, F.lit("")))))
    each = materialize(each.where("query IS NOT NULL").select("query", F.array_join(words("asked"), " ").alias("asked"), F.array_join(words("expanded"), " ").alias("expanded")), "expanded-words")
    sets = materialize(each.select("asked", "expanded").distinct().withColumn("set", F.monotonically_increasing_id()), "expanded-sets")
    found = hybrid(index, sets.select(F.col("set").alias("query"), F.col("expanded").alias("text")), docs, boosts, candidates, top=candidates)
    best = rerank(found, sets.select(F.col("set").alias("query"), F.col("asked").alias("text")), texts, k).withColumnRenamed("query", "set")
    return each.join(sets, ["asked", "expanded"]).select("query", "set").join(best, "set").drop("set")


def request(docs: DataFrame, filters: dict[str, Column], every: bool = True) -> Column:
    """The conjunction (or disjunction) of the filters that were given, true without any."""
    out: Column | None = None
    for c in filters.values():
        out = c if out is None else (out & c if every else out | c)
    return F.coalesce(out, F.lit(False)) if out is not None else F.lit(True)


def match_all(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, doc, score, rank) for queries without any word: every document scores 1, and concepts of the query are a
    filter instead of a boost. docs: (doc, concepts); queries: (query, text, concepts).

    Only the first k documents by id of each concept can come out, so that many are kept per concept before the join."""
    blank = queries.where(F.size(tokens(F.coalesce("text", F.lit("")))) == 0).select("query", "concepts")
    order = W.partitionBy("c").orderBy("doc")
    first = docs.select("doc", F.explode("concepts").alias("c")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    by_concept = blank.where(F.size("concepts") > 0).select("query", F.explode("concepts").alias("c")).join(first, "c").select("query", "doc").distinct()
    head = docs.select("doc").orderBy("doc").limit(k)  # k rows, whatever the corpus
    rest = blank.where(F.coalesce(F.size("concepts"), F.lit(0)) <= 0).select("query").join(F.broadcast(head), F.lit(True))
    both = by_concept.unionByName(rest).withColumn("score", F.lit(1.0))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("doc"))).where(F.col("rank") <= k)


def by_session(rows: DataFrame, key: str = "query_id") -> Iterator[dict]:
    """Rows in order, one after the other, for a caller that streams them out."""
    for r in rows.orderBy(key).toLocalIterator():
        yield r.asDict(recursive=True)
