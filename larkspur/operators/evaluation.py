"""Retrieval metrics for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold, is_match, name_tokens


def name_hits(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query, rank, hit): an item is a hit when one of its aliases matches one of the query's relevant names.

    ranked: (query, rank, aliases array); qrels: (query, names array). Joined on the query; names are compared in place."""
    each = ranked.join(qrels, "query")
    a = F.transform(F.filter("aliases", lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: name_tokens(x))
    e = F.transform("names", lambda x: name_tokens(x))
    return each.select("query", "rank", F.exists(a, lambda r: F.exists(e, lambda x: is_match(r, x))).alias("hit"))


def metrics(hits: DataFrame, relevant: DataFrame, k: int = 10, corpus_size: int | DataFrame | None = None) -> DataFrame:
    """All metrics of each query at cut ``k``. hits: (query, rank, hit); relevant: (query, n_relevant).

    corpus_size: how many items are indexed, as a number or as a table of one row and the column corpus_size; fallout is
    null without it. Queries without results score 0. Recall, precision averages and gains are not capped at 1 when several
    places match one relevant name."""
    running = hits.withColumn("sofar", F.sum(F.col("hit").cast("long")).over(W.partitionBy("query").orderBy("rank")))
    at = F.col("rank") <= k
    hit = F.col("hit")
    r = relevant.select("query", F.col("n_relevant").cast("double").alias("rel"))
    joined = r.join(running, "query", "left")
    agg = joined.groupBy("query", "rel").agg(
        F.count_if(hit & at).alias("n"),
        F.count_if(at).alias("shown"),
        F.coalesce(F.sum(F.when(hit, F.col("sofar") / F.col("rank"))), F.lit(0.0)).alias("gain"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(hit & at, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
        F.count_if(hit & (F.col("rank") <= F.col("rel"))).alias("at_r"),
    )
    if isinstance(corpus_size, DataFrame):
        agg, size = agg.crossJoin(corpus_size.select("corpus_size")), F.col("corpus_size")
    else:
        size = F.lit(corpus_size)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("rel").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    p, rec = F.col("n") / F.lit(float(k)), F.when(F.col("rel") > 0, F.col("n") / F.col("rel")).otherwise(0.0)
    out = agg.select(
        "query",
        p.alias("precision"),
        rec.alias("recall"),
        F.when(p + rec > 0, 2 * p * rec / (p + rec)).otherwise(0.0).alias("f1"),
        F.when(F.col("rel") > 0, F.col("gain") / F.col("rel")).otherwise(0.0).alias("average_precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.col("n") > 0).cast("int").alias("hit"),
        F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("top1"),
        F.coalesce((F.col("first") <= 3).cast("int"), F.lit(0)).alias("top3"),
        F.when(F.col("rel") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        F.when(F.col("rel") > 0, F.col("at_r") / F.col("rel")).otherwise(0.0).alias("r_precision"),
        (F.when(size - F.col("rel") > 0, (F.col("shown") - F.col("n")) / (size - F.col("rel"))).otherwise(0.0) if corpus_size is not None else F.lit(None).cast("double")).alias("fallout"),
    )
    return out


def macro(per_query: DataFrame, columns: list[str]) -> DataFrame:
    """Averages over all queries, a missing value counting as 0."""
    return per_query.agg(F.count("*").alias("queries"), *[(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) / F.count("*")).alias(c) for c in columns])


def by_mode(hits: DataFrame, relevant: DataFrame, k: int = 10, corpus_size: int | None = None) -> DataFrame:
    """One row a mode with its queries and the averages of all metrics. The key ``query`` is a struct (mode, query_id), so
    that every mode is judged over the same queries and one that fails in a mode only lowers that mode."""
    per = metrics(hits, relevant, k, corpus_size)
    columns = [c for c in per.columns if c not in ("query", "fallout")]
    mean = [(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) / F.count("*")).alias(c) for c in columns]
    return per.groupBy(F.col("query.mode").alias("mode")).agg(F.count("*").alias("queries"), *mean)


def answer_hits(answers: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, names_it): whether an answer holds any of its query's names, both folded. answers: (query_id, answer);
    names: (query_id, names array, folded)."""
    a = answers.join(names, "query_id").withColumn("_a", fold("answer"))
    return a.select("query_id", F.exists("names", lambda n: F.col("_a").contains(n)).alias("names_it"))
