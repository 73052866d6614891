"""Lexical retrieval: postings, BM25, filters, facets, paging and highlights, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import as_column, round6, tokens

K1, B = 1.2, 0.75
MAX_TERMS = 200_000


def postings(docs: DataFrame, doc: str, field: str, text: str | Column) -> DataFrame:
    """(doc, field, term, tf, len): one row for each term of a document's field."""
    base = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), tokens(text).alias("_t")).where(F.size("_t") > 0)
    each = base.select("doc", F.size("_t").cast("long").alias("len"), F.explode("_t").alias("term"))
    return each.groupBy("doc", "len", "term").agg(F.count("*").alias("tf")).select("doc", F.lit(field).alias("field"), "term", "tf", "len")


def query_terms(queries: DataFrame, query: str, text: str | Column) -> DataFrame:
    """(query, term, n_terms): the distinct terms of each query."""
    q = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("query"), F.array_distinct(tokens(text)).alias("_t"))
    return q.select("query", F.size("_t").alias("n_terms"), F.explode("_t").alias("term"))


def weigh(post: DataFrame, sizes: DataFrame) -> DataFrame:
    """(term, field, doc, gain): what each posting adds to the score of its field. sizes: (field, n, avg_len)."""
    freq = post.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return post.join(freq, ["field", "term"]).join(F.broadcast(sizes), "field").select("term", "field", "doc", gain.alias("gain"))


def score(weighed: DataFrame, terms: DataFrame, boosts: dict[str, float] | None = None, every_term: bool = False) -> DataFrame:
    """(query, doc, score): the sum of gains of each field times its boost, the best field of a document counts.

    The terms are sent around while they are few enough (``MAX_TERMS`` rows, counted first) and the postings lie by
    document, so that neither sum needs another shuffle; beyond that they are joined by shuffle. With ``every_term`` all
    terms of a query must stand in one field."""
    if terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS:
        asked = weighed.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        hit = asked.repartition("doc").join(F.broadcast(terms), "term")
    else:
        hit = weighed.join(terms, "term")
    boost = F.lit(1.0)
    for field, value in (boosts or {}).items():
        boost = F.when(F.col("field") == field, F.lit(float(value))).otherwise(boost)
    if not every_term and boosts and len(boosts) <= 8:
        # one sum a field, all in one aggregation
        sums = [F.sum(F.when(F.col("field") == f, F.col("gain"))).alias(f"_s{i}") for i, f in enumerate(boosts)]
        best = [F.coalesce(F.col(f"_s{i}") * float(v), F.lit(0.0)) for i, v in enumerate(boosts.values())]
        return hit.where(F.col("field").isin(*boosts)).groupBy("query", "doc").agg(*sums).select("query", "doc", (F.greatest(*best) if len(best) > 1 else best[0]).alias("score"))
    per_field = hit.groupBy("query", "field", "doc").agg(F.sum("gain").alias("s"), F.count("*").alias("found"), F.max("n_terms").alias("n_terms"))
    if every_term:
        per_field = per_field.where("found = n_terms")
    return per_field.groupBy("query", "doc").agg(F.max(F.col("s") * boost).alias("score"))


def bm25(post: DataFrame, terms: DataFrame, n_docs: DataFrame, boosts: dict[str, float] | None = None, every_term: bool = False) -> DataFrame:
    """(query, doc, score) straight from postings that are not stored; n_docs: (field, n, avg_len)."""
    asked = post.join(terms.select("term").distinct(), "term", "left_semi")
    return score(weigh(asked, n_docs), terms, boosts, every_term)


def field_sizes(post: DataFrame) -> DataFrame:
    """(field, n, avg_len); as many rows as there are fields."""
    return post.select("field", "doc", "len").distinct().groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def top_k(scores: DataFrame, k: int, query: str = "query", doc: str = "doc", score: str | Column = "score", offset: int = 0) -> DataFrame:
    """The best of each query in order, with ``rank`` from 1; scores are compared at six decimals, ties go to the smaller id."""
    w = W.partitionBy(query).orderBy(F.col("score").desc(), F.col(doc))
    ranked = scores.withColumn("score", round6(score)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + offset)
    return ranked.where(F.col("rank") > offset) if offset else ranked


def concept_boost(scores: DataFrame, docs: DataFrame, queries: DataFrame, boost: float = 3.0) -> DataFrame:
    """Add ``boost`` where a document shares a concept with the query; either match is enough.

    docs: (doc, concepts array); queries: (query, concepts array). Joined on single concepts, not on all pairs."""
    d = docs.select("doc", F.explode("concepts").alias("c"))
    q = queries.select("query", F.explode("concepts").alias("c"))
    shared = q.join(d, "c").select("query", "doc").distinct().withColumn("extra", F.lit(boost))
    joined = scores.join(shared, ["query", "doc"], "full_outer")
    return joined.select("query", "doc", (F.coalesce("score", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).alias("score"))


def facets(docs: DataFrame, fields: list[str], size: int = 20) -> DataFrame:
    """(field, value, n): the most frequent values of several fields over all rows, by grouping sets in one pass."""
    sets = [[F.col(f)] for f in fields]
    grouped = docs.groupingSets(sets, *fields).agg(F.count("*").alias("n"), *[F.grouping(f).alias(f"_g{i}") for i, f in enumerate(fields)])
    which = F.coalesce(*[F.when(F.col(f"_g{i}") == 0, F.lit(f)) for i, f in enumerate(fields)])
    value = F.coalesce(*[F.when(F.col(f"_g{i}") == 0, F.col(f).cast("string")) for i, f in enumerate(fields)])
    long = grouped.select(which.alias("field"), value.alias("value"), "n").where("value is not null")
    w = W.partitionBy("field").orderBy(F.col("n").desc(), F.col("value"))
    return long.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


def highlight(text: str | Column, terms: str | Column, fragment: int = 160) -> Column:
    """The first fragment that begins at an asked term, each asked term in <em>."""
    t = as_column(text)
    pattern = F.concat(F.lit(r"(?i)\b("), F.array_join(as_column(terms), "|"), F.lit(r")\b"))
    at = F.greatest(F.regexp_instr(t, pattern), F.lit(1))
    return F.regexp_replace(F.substring(t, at, F.lit(fragment)), pattern, F.lit("<em>$1</em>"))
