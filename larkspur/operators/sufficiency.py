"""Whether local results suffice for a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import unit_score


def assess(results: DataFrame, queries: DataFrame, useful: float = 0.5, limits: tuple[float, int, float, int] = (0.5, 3, 0.5, 2), most: float = 0.45, top: int = 10) -> DataFrame:
    """One row per query: confidence, useful documents, coverage, diversity, insufficiency, failed criteria, sufficient.

    results: (query_id, rank from 1, doc_id, source_domain, text, score); queries: (query_id, terms array). A query
    without results is insufficient at 1.0; one without terms has full coverage."""
    conf, docs_needed, cover, sources = limits
    r = results.withColumn("n", unit_score("score"))
    last = r.where((F.col("n") >= useful) & (F.trim("source_domain") != "")).groupBy("query_id", "doc_id").agg(F.max_by(F.lower(F.trim("source_domain")), "rank").alias("d"))
    diversity = last.groupBy("query_id").agg(F.count_distinct("d").alias("diversity"))
    per_doc = r.groupBy("query_id", "doc_id").agg(F.max("n").alias("best"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("first"))
    base = per_doc.groupBy("query_id").agg(F.count_if(F.col("best") >= useful).alias("useful"), F.max("first").alias("confidence"))
    text = r.where(F.col("rank") <= top).groupBy("query_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n")).alias("t"))
    q = queries.select("query_id", "terms").join(base, "query_id", "left").join(diversity, "query_id", "left").join(text, "query_id", "left")
    found = F.size(F.filter("terms", lambda s: F.coalesce(F.col("t"), F.lit("")).contains(F.lower(s))))
    q = q.select(
        "query_id", F.col("useful").isNull().alias("none"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("useful", F.lit(0)).alias("useful"),
        F.when(F.size("terms") > 0, found / F.size("terms").cast("double")).otherwise(1.0).alias("coverage"), F.coalesce("diversity", F.lit(0)).alias("diversity"),
    )
    short = lambda c, n: F.greatest(F.lit(0), F.lit(n) - F.col(c)) / float(n)
    score = F.when(F.col("none"), 1.0).otherwise(0.35 * (1 - F.col("confidence")) + 0.25 * short("useful", docs_needed) + 0.25 * (1 - F.col("coverage")) + 0.15 * short("diversity", sources))
    failed = F.when(F.col("none"), F.array(F.lit("no_local_results"))).otherwise(
        F.array_compact(F.array(F.when(F.col("confidence") < conf, "rank_confidence"), F.when(F.col("useful") < docs_needed, "useful_documents"), F.when(F.col("coverage") < cover, "symptom_coverage"), F.when(F.col("diversity") < sources, "source_diversity")))
    )
    out = q.withColumns({"insufficiency": score, "failed": failed})
    return out.withColumn("sufficient", (F.size("failed") == 0) & (F.col("insufficiency") < most)).drop("none")


def rank_results(rows: DataFrame, by: str = "query_id") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.col("score").desc(), F.col("doc_id"))))
