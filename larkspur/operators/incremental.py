"""Keyed tables: last write wins, deletes, skipping what is known, votes, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones under other keys. Both have the same columns; keys that are null never match."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that comes last; all columns kept. One aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return best.select(*keys, "_last.*").select(*rows.columns)


def skip_known(rows: DataFrame, manifest: DataFrame, version: str, doc: str = "doc_id", content_hash: str = "content_hash") -> DataFrame:
    """Rows that the manifest does not have under the same hash and pipeline version."""
    known = manifest.where(F.col("pipeline_version") == version).select(F.col("doc_id").alias(doc), F.lower("content_hash").alias(content_hash)).distinct()
    return rows.join(known, [doc, content_hash], "left_anti")


def current_votes(events: DataFrame, keys: list[str], at: str, seq: str, kind: str, retract: str) -> DataFrame:
    """The state after a log of votes: of each key the last event, unless it takes the vote back."""
    return latest(events, keys, [at, seq]).where(F.col(kind) != retract)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run_counts(rows: DataFrame, by: str, flags: dict[str, str]) -> DataFrame:
    """Rows and how many satisfy each condition, for each value of a column, in one pass."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in flags.items()])
