"""Plain files: uploaded charts, robots rules, versioned tables."""

from __future__ import annotations

from urllib import robotparser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def decode_bytes(raw: bytes | None) -> str | None:
    """UTF-8, else Latin-1."""
    if raw is None:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


@F.pandas_udf(StringType())
def _decoded(raw: pd.Series) -> pd.Series:
    return raw.map(decode_bytes)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", _decoded("content").alias("text"))


def read_pdfs(spark: SparkSession, path: str, extract) -> DataFrame:
    """(path, text) with a pluggable extractor of bytes to text (there is none in the standard library)."""
    f = _extractor(extract)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", f("content").alias("text"))


def _extractor(extract):
    @F.pandas_udf(StringType())
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(extract)

    return run


def robots_allow(rules: dict[str, str], agent: str = "*"):
    """A predicate on URLs from robots texts by host (a bounded set that a crawl holds); unknown hosts are allowed."""
    parsed: dict[str, robotparser.RobotFileParser] = {}

    @F.pandas_udf(BooleanType())
    def allowed(url: pd.Series) -> pd.Series:
        def one(u: str | None) -> bool:
            host = (u or "").split("://", 1)[-1].split("/", 1)[0].lower()
            if host not in rules:
                return True
            if host not in parsed:
                parsed[host] = robotparser.RobotFileParser()
                parsed[host].parse(rules[host].splitlines())
            return parsed[host].can_fetch(agent, u)

        return url.map(one)

    return allowed


def publish(df: DataFrame, root: str, version: str, view: str) -> str:
    """Write a version of a table and point the view at it: readers change over at once, old versions stay readable."""
    path = f"{root}/{version}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).createOrReplaceTempView(view)
    return path


def frontier_step(links: DataFrame, visited: DataFrame, allowed: Column, most_depth: int) -> DataFrame:
    """The next round of a crawl: allowed links of the last round that no one has visited, each once at its least depth."""
    new = links.where(allowed & (F.col("depth") <= most_depth)).groupBy("url").agg(F.min(F.struct("depth", "parent_url", "seed_id", "seed_group")).alias("_f")).select("url", "_f.*")
    return new.join(visited.select("url"), "url", "left_anti")
