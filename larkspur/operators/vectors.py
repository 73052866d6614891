"""Exact vector search and similarity, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK = 2048


def cosine(a: str, b: str) -> F.Column:
    """Cosine of two vectors in double precision; null for a zero or missing one."""
    x, y = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def searched(vectors: DataFrame) -> DataFrame:
    """One row (corpus_size): how many of the vectors (id, embedding) :func:`top_similar` searches."""
    squares = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, z: s + z * z)
    return vectors.agg(F.count_if(F.col("id").isNotNull() & (squares > 0) & (squares < float("inf"))).alias("corpus_size"))


def top_similar(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, same_ids: bool = True) -> DataFrame:
    """(query, item, score, rank): the k items of greatest cosine for each query, itself left out unless the
    ids are of two kinds (``same_ids`` false). Cosines are compared at six decimals, ties go to the smaller id.

    queries and vectors: (id, embedding). The queries are a stated set, worked off in blocks of ``QUERY_BLOCK`` which
    are sent to all vectors; each task keeps k per query, so little is shuffled. Null, empty and zero vectors take no part."""
    spark = vectors.sparkSession
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("id").isNotNull()
    base = vectors.where(usable).select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "query string, item string, score double"
    out, block = None, []

    def search(rows: list[tuple[str, list[float]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, tuple[list[str], np.ndarray]] = {}
            for n in {len(v) for _, v in shared.value}:
                some = [(i, v) for i, v in shared.value if len(v) == n]
                m = np.array([v for _, v in some])
                by_size[n] = ([i for i, _ in some], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))
            for b in batches:
                ids, lists = b.column(0).to_pylist(), b.column(1).to_pylist()
                for n, (names, q) in by_size.items():
                    at = [i for i, v in enumerate(lists) if len(v) == n]
                    if not at:
                        continue
                    x = np.array([lists[i] for i in at])
                    norm = np.linalg.norm(x, axis=1)
                    keep = np.nonzero(np.isfinite(norm) & (norm > 0))[0]
                    sims = q @ (x[keep] / norm[keep, None]).T
                    own = {ids[at[j]]: c for c, j in enumerate(keep)}
                    for r, name in enumerate(names):
                        row = np.floor(sims[r] * 1000000 + 0.5) / 1000000.0
                        if same_ids and (c := own.get(name)) is not None:
                            row[c] = -2.0
                        least_kept = max(np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -1.5, -1.5 if least is None else least)
                        order = np.nonzero(row >= least_kept)[0]
                        if len(order) > k:
                            order = np.array(sorted(order.tolist(), key=lambda o: (-row[o], ids[at[keep[o]]]))[:k])
                        if len(order):
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(order)), pa.array([ids[at[keep[o]]] for o in order]), pa.array(row[order])], names=["query", "item", "score"])

        return base.mapInArrow(run, schema)

    for r in queries.where(usable).select(F.col("id").cast("string"), F.col("embedding").cast("array<double>")).toLocalIterator():
        if any(r[1]):
            block.append((r[0], list(r[1])))
        if len(block) == QUERY_BLOCK:
            out = search(block) if out is None else out.unionByName(search(block))
            block = []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    out = out.withColumn("score", F.floor(F.col("score") * 1000000 + 0.5) / 1000000.0)
    if least is not None:
        out = out.where(F.col("score") >= least)
    w = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("item"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
