"""Query expansion: synonyms, pseudo relevance and relevance feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicons import FEEDBACK_STOPWORDS, RELEVANCE_STOPWORDS, SYNONYMS
from ..functions.text import as_column, literal_array, whole_term


def synonym_terms(query: str | Column, synonyms: dict[str, list[str]] | None = None, most: int = 12) -> Column:
    """Variants of the terms that a query holds, in the order of the table, each once and none that the query has."""
    groups = synonyms or SYNONYMS
    q = F.trim(as_column(query))
    none = F.array().cast("array<string>")
    parts = []
    for term, variants in groups.items():
        parts.append(F.when(whole_term(q, term), literal_array(variants)).otherwise(none))
        parts += [F.when(whole_term(q, v), literal_array([term, *variants])).otherwise(none) for v in variants]
    found = F.flatten(F.array(*parts))
    fresh = F.filter(found, lambda t: ~F.lower(q).contains(F.lower(t)))
    keep = lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t)))
    return F.slice(F.aggregate(fresh, none, keep), 1, most)


def expand_synonyms(query: str | Column, synonyms: dict[str, list[str]] | None = None, most: int = 12) -> Column:
    q, terms = as_column(query), synonym_terms(query, synonyms, most)
    return F.when(F.size(terms) == 0, q).otherwise(F.concat_ws(" ", F.trim(q), F.array_join(terms, " ")))


def frequent_terms(texts: DataFrame, queries: DataFrame, top: int, stopwords: list[str]) -> DataFrame:
    """(query, terms): the most frequent words of a query's texts that the query has not; ties go to the first met.

    texts: (query, position, text) with positions from 1; queries: (query, text)."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    each = texts.select("query", "position", F.posexplode(words).alias("p", "term")).where(~F.col("term").isin(*stopwords))
    asked = queries.select("query", F.split(F.lower("text"), r"\s+").alias("_asked"))
    each = each.join(asked, "query").where(~F.array_contains("_asked", F.col("term")))
    n = each.groupBy("query", "term").agg(F.count("*").alias("n"), F.min(F.struct("position", "p")).alias("first"))
    w = W.partitionBy("query").orderBy(F.col("n").desc(), F.col("first"))
    best = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return best.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))


def expand_by_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, expanded): the text with its terms appended, or as it is."""
    joined = queries.join(terms, "query", "left")
    return joined.select("query", F.when(F.col("terms").isNull(), F.col("text")).otherwise(F.concat_ws(" ", F.trim("text"), F.array_join("terms", " "))).alias("expanded"))


def pseudo_relevance(ranked: DataFrame, queries: DataFrame, docs: int = 5, terms: int = 8) -> DataFrame:
    """Expand by the best texts; ranked: (query, rank, text)."""
    return expand_by_terms(queries, frequent_terms(ranked.where(F.col("rank") <= docs).select("query", F.col("rank").alias("position"), "text"), queries, terms, RELEVANCE_STOPWORDS))


def relevance_feedback(votes: DataFrame, chunks: DataFrame, queries: DataFrame, terms: int = 10) -> DataFrame:
    """Expand by the texts voted relevant; votes: (query, chunk, relevant, position), chunks: (chunk, text)."""
    liked = votes.where("relevant").join(chunks, "chunk").select("query", "position", "text")
    return expand_by_terms(queries, frequent_terms(liked, queries, terms, FEEDBACK_STOPWORDS))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
