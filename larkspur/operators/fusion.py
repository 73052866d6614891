"""Fusion of rankings in long form: (query, source, item, rank, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import round6


def _ordered(df: DataFrame, k: int | None = None) -> DataFrame:
    w = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("item"))
    out = df.withColumn("score", round6("score")).withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def reciprocal_rank(rankings: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """Sum of 1 / (k + rank)."""
    return _ordered(rankings.groupBy("query", "item").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")), top)


def weighted_sum(rankings: DataFrame, weights: dict[str, float], top: int | None = None) -> DataFrame:
    """Scores over the best of their list (where that is positive), weighted by source and added."""
    best = F.max("score").over(W.partitionBy("query", "source"))
    share = F.when(best > 0, F.col("score") / best).otherwise(F.col("score"))
    weight = F.lit(0.0)
    for source, value in weights.items():
        weight = F.when(F.col("source") == source, F.lit(float(value))).otherwise(weight)
    return _ordered(rankings.select("query", "item", (share * weight).alias("_s")).groupBy("query", "item").agg(F.sum("_s").alias("score")), top)


def borda(rankings: DataFrame, points: int | None = None, top: int | None = None) -> DataFrame:
    """Points minus place (from 0); by default as many points as the longest list of the query is long."""
    most = F.lit(points) if points is not None else F.max("rank").over(W.partitionBy("query"))
    scored = rankings.select("query", "item", (most - (F.col("rank") - 1)).cast("double").alias("_s"))
    return _ordered(scored.groupBy("query", "item").agg(F.sum("_s").alias("score")), top)


def interleave(rankings: DataFrame, sources: list[str], k: int | None = None) -> DataFrame:
    """Turn by turn from each list, each item once."""
    turn = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    first = rankings.groupBy("query", "item").agg(F.min(F.struct(F.col("rank").alias("r"), turn.alias("t"))).alias("at"))
    out = first.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("at", "item"))).select("query", "item", "rank")
    return out if k is None else out.where(F.col("rank") <= k)


def unique_items(rankings: DataFrame) -> DataFrame:
    return rankings.select("query", "item").distinct()


def intersect(rankings: DataFrame, n_sources: int) -> DataFrame:
    """Items of all lists with their best score."""
    return rankings.groupBy("query", "item").agg(F.count_distinct("source").alias("_n"), F.max("score").alias("score")).where(F.col("_n") == n_sources).drop("_n")


def negate(rankings: DataFrame, source: str, minus: str) -> DataFrame:
    """Items of one list that another has not."""
    a, b = rankings.where(F.col("source") == source), rankings.where(F.col("source") == minus)
    return a.join(b.select("query", "item"), ["query", "item"], "left_anti").select("query", "item", "score")
