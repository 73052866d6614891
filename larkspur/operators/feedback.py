"""Votes on results: validation, the state of a session, refined queries and the log of expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import expansion, incremental

REQUIRED = ("session_id", "query", "chunk_id", "doc_id")


def missing_field(fields: tuple[str, ...] = REQUIRED) -> Column:
    """The first required field that is null or blank, null when none is."""
    return F.coalesce(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields])


def split_valid(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes that can be stored, and the others with the field that each lacks."""
    judged = votes.withColumn("missing", missing_field())
    return judged.where(F.col("missing").isNull()).drop("missing"), judged.where(F.col("missing").isNotNull())


def current(votes: DataFrame, at: str = "created_at", seq: str = "vote_id", kind: str = "kind", retract: str = "retract") -> DataFrame:
    """Valid votes as they stand: of each session, query, chunk and document the last one, unless it takes the vote back."""
    return incremental.current_votes(split_valid(votes)[0], list(REQUIRED), at, seq, kind, retract)


def refined(votes: DataFrame, chunks: DataFrame, queries: DataFrame, terms: int = 10) -> DataFrame:
    """(query, expanded): queries with the frequent words of the chunks voted relevant.

    votes: (query, chunk, relevant, position); chunks: (chunk, text); queries: (query, text)."""
    return expansion.relevance_feedback(votes, chunks, queries, terms)


def excluded(votes: DataFrame) -> DataFrame:
    """(query, item): what was voted not relevant."""
    return votes.where(~F.col("relevant")).select("query", F.col("chunk").alias("item")).distinct()


def expansion_log(steps: dict[str, DataFrame], sessions: DataFrame) -> DataFrame:
    """(session_id, query, original, expanded, strategy): one row for each step that changed a query.

    steps: by strategy (query, text, expanded); sessions: (query, session_id)."""
    out = None
    for strategy, df in steps.items():
        part = df.where(F.col("expanded") != F.col("text")).select("query", F.col("text").alias("original"), "expanded", F.lit(strategy).alias("strategy"))
        out = part if out is None else out.unionByName(part)
    return out.join(sessions.select("query", "session_id"), "query", "left").select("session_id", "query", "original", "expanded", "strategy")
