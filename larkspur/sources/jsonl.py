"""Acquired documents as JSON lines: strict and lenient scans, append and per-query deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACQUIRED = (
    "doc_id string, url string, source_domain string, fetched_at string, crawl struct<depth:int,parent_url:string,seed_id:string,seed_group:string>, "
    "content struct<mime_type:string,title:string,sections:array<struct<heading:string,text:string>>,body:string>, "
    "page_meta struct<published_at:string,updated_at:string,author:string,language:string>, content_hash string"
)
REQUIRED = ["doc_id", "url", "source_domain", "fetched_at", "crawl.depth", "crawl.seed_id", "crawl.seed_group", "content.mime_type", "content.body"]
_MAY_BE_EMPTY = {"content.body", "crawl.depth"}


def problems(fields: list[str] = REQUIRED) -> Column:
    """What is wrong with a row: missing or blank required fields, sections without heading or text. Empty when sound.

    A declared schema reads absent keys as null without complaint, so that requiredness has to be checked here."""
    out = []
    for f in fields:
        c = F.col(f)
        out.append(F.when(c.isNull() | (F.lit(False) if f in _MAY_BE_EMPTY else F.trim(c.cast("string")) == ""), F.lit(f"missing {f}")))
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    out.append(F.when(F.exists("content.sections", lambda s: blank(s["heading"]) | blank(s["text"])), F.lit("empty section")))
    return F.array_compact(F.array(*out))


def _optional_blank_to_null(df: DataFrame) -> DataFrame:
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    meta = F.when(F.col("page_meta").isNotNull(), F.struct(*[some(F.col(f"page_meta.{f}")).alias(f) for f in ("published_at", "updated_at", "author", "language")]))
    return df.withColumns({"content_hash": some(F.col("content_hash")), "page_meta": meta, "content": F.col("content").withField("title", some(F.col("content.title"))), "crawl": F.col("crawl").withField("parent_url", some(F.col("crawl.parent_url")))})


def _raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(ACQUIRED + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(paths).withColumn("_file", F.col("_metadata.file_path"))


def read_strict(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Fails on the first line that is no JSON or lacks a required field, naming the file and what is wrong."""
    df = _raw(spark, paths)
    wrong = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("no JSON of this schema"))).otherwise(problems())
    df = df.withColumn("doc_id", F.when(F.size(wrong) == 0, F.col("doc_id")).otherwise(F.raise_error(F.concat(F.lit("["), F.col("_file"), F.lit("] "), F.array_join(wrong, ", ")))))
    return _optional_blank_to_null(df.drop("_corrupt", "_file"))


def read_lenient(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(sound rows, bad rows with file and reasons)."""
    df = _raw(spark, paths)
    wrong = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("no JSON of this schema"))).otherwise(problems())
    df = df.withColumn("_wrong", wrong)
    return _optional_blank_to_null(df.where(F.size("_wrong") == 0).drop("_corrupt", "_file", "_wrong")), df.where(F.size("_wrong") > 0).select(F.col("_file").alias("file"), "doc_id", F.col("_wrong").alias("reasons"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_delta(df: DataFrame, path: str, query_hash: str = "query_hash") -> None:
    """One partition per query; writing a query again replaces its own partition only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(query_hash).json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query, names, chunk_ids, doc_ids): judgments; a line without query or names fails the read."""
    df = spark.read.schema("query string, relevant_disease_names array<string>, relevant_chunk_ids array<string>, relevant_doc_ids array<string>").option("mode", "FAILFAST").json(path)
    ok = (F.trim("query") != "") & (F.size("relevant_disease_names") > 0)
    q = F.when(F.coalesce(ok, F.lit(False)), F.col("query")).otherwise(F.raise_error(F.lit("a judgment needs a query and relevant names")))
    return df.select(q.alias("query"), F.col("relevant_disease_names").alias("names"), F.col("relevant_chunk_ids").alias("chunk_ids"), F.col("relevant_doc_ids").alias("doc_ids"))
