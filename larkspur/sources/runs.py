"""Runs and their files: reports, rows that failed, stored evaluations, index sizes, settings, test cases."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_report(counts: DataFrame, rows: DataFrame, problem: str, path: str) -> None:
    """Counters as JSON below ``path``/report, and the rows with a problem, with what it is, below ``path``/bad.

    ``problem`` is an SQL expression that gives a text, or null for a good row."""
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    rows.withColumn("problem", F.expr(problem)).where("problem is not null").write.mode("overwrite").json(f"{path}/bad")


class RunStore:
    """Evaluation runs by id: a folder of rows for each."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, run_id: str, rows: DataFrame) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id) or run_id.startswith("."):
            raise ValueError(f"not a run id: {run_id!r}")
        rows.write.mode("overwrite").parquet(f"{self.root}/run={run_id}")

    def get(self, run_id: str) -> DataFrame | None:
        fs, p = _fs(self.spark, f"{self.root}/run={run_id}")
        return self.spark.read.parquet(f"{self.root}/run={run_id}") if fs.exists(p) else None

    def delete(self, run_id: str) -> bool:
        fs, p = _fs(self.spark, f"{self.root}/run={run_id}")
        return fs.exists(p) and fs.delete(p, True)

    def ids(self) -> list[str]:
        fs, p = _fs(self.spark, self.root)
        return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if s.getPath().getName().startswith("run=")) if fs.exists(p) else []


def index_sizes(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(name, rows, bytes) of stored tables; 0 for those that do not exist."""
    out = None
    for name, path in tables.items():
        fs, p = _fs(spark, path)
        there = fs.exists(p)
        size = fs.getContentSummary(p).getLength() if there else 0
        rows = spark.read.parquet(path).agg(F.count("*").alias("rows")) if there else spark.createDataFrame([(0,)], "rows long")
        part = rows.select(F.lit(name).alias("name"), "rows", F.lit(size).cast("long").alias("bytes"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "name string, rows long, bytes long")


def reset(spark: SparkSession, tables: dict[str, str], which: list[str] | None = None) -> list[str]:
    """Delete stored tables (all of them, or the named ones); gives the names of those that were there."""
    gone = []
    for name, path in tables.items():
        if which is None or name in which:
            fs, p = _fs(spark, path)
            if fs.exists(p) and fs.delete(p, True):
                gone.append(name)
    return gone


@dataclass
class CrawlSettings:
    """Settings of a crawl; what a file or the environment does not give keeps its default."""

    max_depth: int = 2
    max_docs: int = 1000
    delay_seconds: float = 1.0
    user_agent: str = "larkspur"
    seeds: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | None = None, prefix: str = "LARKSPUR_") -> CrawlSettings:
        """From a TOML file, then from the environment (upper-case names after the prefix), which wins."""
        import tomllib

        given: dict = {}
        if path:
            with open(path, "rb") as f:
                given = tomllib.load(f)
        out = cls()
        for f_ in fields(cls):
            value = os.environ.get(prefix + f_.name.upper(), given.get(f_.name))
            if value is not None:
                kind = type(getattr(out, f_.name))
                setattr(out, f_.name, ([x.strip() for x in value.split(",") if x.strip()] if kind is list and isinstance(value, str) else kind(value)))
        return out


def test_cases(spark: SparkSession, markdown: str) -> DataFrame:
    """(query, expected) of a markdown page: each heading's first quoted or fenced text is a query, and the first name after
    "Top-1", "Expected" or "Diagnosis" is what should come first. Headings without both give nothing."""
    rows = []
    for part in re.split(r"(?m)^#{2,}\s+", markdown)[1:]:
        fence, quote = re.search(r"```[a-z]*\n(.+?)\n```", part, re.S), re.search(r"(?m)^>\s*(.+)$", part)
        name = re.search(r"(?im)^[\s*|-]*(?:top-?1|expected|diagnosis)[\s*|:]*([^\n|*]+)", part)
        asked = fence or quote
        if asked and name and name[1].strip():
            rows.append((" ".join(asked[1].split()), name[1].strip()))
    return spark.createDataFrame(rows, "query string, expected string")


test_cases.__test__ = False
