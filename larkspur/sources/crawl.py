"""A crawl as batches: the frontier of one depth after the other, when each page may be fetched, and what came of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize
from .files import frontier_step

PAGE = "url string, depth int, parent_url string, seed_id string, seed_group string, status int, mime_type string, html string"


def fetch_pages(frontier: DataFrame, fetch: Callable[[str], tuple[int, str, str]]) -> DataFrame:
    """The frontier with status, mime type (without parameters, lower case) and text of each page.

    ``fetch`` gives them for a URL, redirects followed; what it raises becomes status 0, so that one page cannot stop a
    crawl. It is called in the executors, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u in b["url"]:
                try:
                    status, mime, text = fetch(u)
                    out.append((int(status), (mime or "").split(";")[0].strip().lower(), text))
                except Exception:  # noqa: BLE001 - any failure is the page's, not the crawl's
                    out.append((0, "", None))
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(out, columns=["status", "mime_type", "html"])], axis=1)

    return frontier.select("url", "depth", "parent_url", "seed_id", "seed_group").mapInPandas(run, PAGE)


def fetch_times(frontier: DataFrame, gap_seconds: float, start: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """All columns and ``not_before``: pages of one host at least ``gap_seconds`` apart, in their order; hosts do not wait
    for each other. Places are counted per host by a window; a host is bounded by what one crawl step asks of it."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    place = F.row_number().over(W.partitionBy("_host").orderBy("depth", "url")) - 1
    t0 = F.unix_timestamp(F.to_timestamp(F.lit(start), "yyyy-MM-dd'T'HH:mm:ssX"))
    timed = frontier.withColumn("_host", host).withColumn("not_before", F.timestamp_seconds(t0 + place * F.lit(float(gap_seconds))))
    return timed.drop("_host")


def crawl(seeds: DataFrame, fetch: Callable[[str], tuple[int, str, str]], links: Callable[[DataFrame], DataFrame], accept, max_depth: int, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """(pages, counters): one depth after the other until nothing is left, the depth is reached or enough pages are kept.

    seeds: (url, depth, parent_url, seed_id, seed_group). ``links`` gives the same columns for what the pages link to;
    ``accept`` is a column that tells which URLs may be fetched. Each depth is one batch whose result is written."""
    frontier, visited, pages = seeds.dropDuplicates(["url"]), seeds.select("url").distinct(), None
    for depth in range(max_depth + 1):
        got = materialize(fetch_pages(frontier, fetch), "pages")
        pages = got if pages is None else pages.unionByName(got)
        if depth == max_depth or pages.where("status = 200").count() >= max_docs:
            break
        frontier = materialize(frontier_step(links(got.where("status = 200")), visited, accept, max_depth), "frontier")
        if frontier.isEmpty():
            break
        visited = materialize(visited.unionByName(frontier.select("url")), "visited")
    kept = pages.where("status = 200").withColumn("_n", F.row_number().over(W.orderBy("depth", "url"))).where(F.col("_n") <= max_docs).drop("_n")
    return kept, counters(pages, kept)


def counters(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """Fetched, failed and kept pages by seed group."""
    a = pages.groupBy("seed_group").agg(F.count("*").alias("fetched"), F.count_if(F.col("status") != 200).alias("failed"))
    b = kept.groupBy("seed_group").agg(F.count("*").alias("kept"))
    return a.join(b, "seed_group", "left").select("seed_group", "fetched", "failed", F.coalesce("kept", F.lit(0)).alias("kept"))
