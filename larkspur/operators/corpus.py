"""Corpus curation and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_column


def should_persist(mime: str | Column, body: str | Column, out_links: Column | None = None, least_words: int = 200, most_links: int = 120, short_share: float = 0.6) -> Column:
    """Whether a page is worth keeping: long enough, no alphabetic index, no link directory, not mostly lines of few words."""
    m, b = as_column(mime), as_column(body)
    words = F.coalesce(F.regexp_count(b, F.lit("[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+")), F.lit(0))
    lines = F.filter(F.split(b, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"\S+")) <= 3)) / F.size(lines)
    listing = F.coalesce((F.size(lines) > 0) & (short > short_share) & (words < least_words * 4), F.lit(False))
    links = out_links if out_links is not None else F.lit(0)
    page = (words >= least_words) & ~F.coalesce(b.rlike(r"\bA\s+B\s+C\s+D\s+E\b"), F.lit(False)) & ~((links >= most_links) & (words < least_words * 3)) & ~listing
    return F.when(m.startswith("text/html"), page).when(m == "application/pdf", words >= least_words).otherwise(F.lit(False))


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by arrival; rows with a null key are all kept."""
    cond = " and ".join(f"{k} is not null" for k in keys)
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.where(cond).groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(*keys, "_first.*").select(*rows.columns)
    return best.unionByName(rows.where(f"not ({cond})"))


def length_statistics(rows: DataFrame, by: str, length: str | Column, name: str = "chars") -> DataFrame:
    """Count, average, least, greatest and quartiles up to the 99th percentile, each without its fraction (a
    percentile that interpolation leaves a millionth under a whole number counts as that number)."""
    n = as_column(length)
    pct = F.percentile(n, F.array(*[F.lit(p) for p in (0.5, 0.9, 0.95, 0.99)]))
    out = rows.groupBy(by).agg(F.count(n).alias("n"), F.floor(F.avg(n)).alias("avg"), F.min(n).alias("min"), F.max(n).alias("max"), pct.alias("_p"))
    return out.select(by, "n", "avg", "min", "max", *[F.floor(F.col("_p")[i] + 0.000001).alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))])


def duplicate_totals(rows: DataFrame, key: str | Column) -> DataFrame:
    """Keys found more than once, rows under them, and rows too many."""
    g = rows.groupBy(as_column(key).alias("_k")).agg(F.count("*").alias("c")).where("_k is not null and c > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("extra"))


def without_known_identities(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of several identity keys with what is known."""
    for k in keys:
        rows = rows.join(known.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return rows
