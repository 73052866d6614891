"""Answers of bibliographic services as one table. Fetching is pluggable; parsing is the engine's.

Every normaliser takes (query_hash, payload) and gives (query_hash, source, external_id, canonical_url, title, abstract,
pmid, pmcid, doi, authors, year). What cannot be parsed gives no rows, and :func:`fan_out` reports it by source."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "query_hash string, source string, external_id string, canonical_url string, title string, abstract string, pmid string, pmcid string, doi string, authors array<string>, year int"
_COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def _text(node: ET.Element | None) -> str | None:
    words = " ".join("".join(node.itertext()).split()) if node is not None else ""
    return words or None


def parse_summaries(payload: str) -> list[dict]:
    """Encyclopedia answers: <document url> with <content name="title|FullSummary|snippet">."""
    out = []
    for d in ET.fromstring(payload).iter("document"):
        content = {c.get("name"): _text(c) for c in d.iter("content")}
        url = d.get("url")
        out.append({"external_id": url, "canonical_url": url, "title": content.get("title"), "abstract": content.get("FullSummary") or content.get("snippet")})
    return out


def parse_articles(payload: str) -> list[dict]:
    """Article sets: MedlineCitation with title, abstract parts, authors, year and ids."""
    out = []
    for a in ET.fromstring(payload).iter("PubmedArticle"):
        c = a.find("MedlineCitation")
        if c is None:
            continue
        ids: dict[str, str] = {}
        for i in a.iter("ArticleId"):
            if i.get("IdType") and _text(i):
                ids.setdefault(i.get("IdType"), _text(i))
        pmid = _text(c.find("PMID"))
        names = []
        for n in c.iter("Author"):
            first, last = _text(n.find("ForeName")) or _text(n.find("Initials")), _text(n.find("LastName"))
            names.append(" ".join(x for x in (first, last) if x))
        year = _text(next(iter(c.iter("Year")), None))
        out.append(
            {
                "external_id": pmid, "canonical_url": f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/" if pmid else None, "title": _text(c.find(".//ArticleTitle")),
                "abstract": "\n".join(t for t in map(_text, c.iter("AbstractText")) if t) or None, "pmid": pmid, "pmcid": ids.get("pmc"), "doi": ids.get("doi"),
                "authors": [n for n in names if n], "year": int(year) if year and year.isdigit() else None,
            }
        )
    return out


def _normalised(answers: DataFrame, source: str, parse: Callable[[str], list[dict]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, p in zip(b["query_hash"], b["payload"]):
                try:
                    found = parse(p) if p else []
                except ET.ParseError:
                    found = []
                rows += [{**dict.fromkeys(_COLUMNS), "authors": [], **r, "query_hash": q, "source": source} for r in found]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return answers.select("query_hash", "payload").mapInPandas(run, SCHEMA)


def summaries(answers: DataFrame) -> DataFrame:
    return _normalised(answers, "summaries", parse_summaries)


def articles(answers: DataFrame) -> DataFrame:
    return _normalised(answers, "articles", parse_articles)


def records(answers: DataFrame) -> DataFrame:
    """JSON answers with resultList.result[]; parsed in the JVM."""
    result = "struct<id:string,source:string,pmid:string,pmcid:string,doi:string,title:string,abstractText:string,authorString:string,pubYear:string>"
    each = answers.select("query_hash", F.explode(F.from_json("payload", f"struct<resultList:struct<result:array<{result}>>>")["resultList"]["result"]).alias("r"))
    return each.select(
        "query_hash", F.lit("records").alias("source"), F.col("r.id").alias("external_id"), F.concat(F.lit("https://europepmc.org/article/"), F.coalesce("r.source", F.lit("MED")), F.lit("/"), "r.id").alias("canonical_url"),
        F.col("r.title").alias("title"), F.col("r.abstractText").alias("abstract"), F.col("r.pmid").alias("pmid"), F.col("r.pmcid").alias("pmcid"), F.col("r.doi").alias("doi"),
        F.filter(F.transform(F.split(F.coalesce("r.authorString", F.lit("")), ","), lambda x: F.trim(F.regexp_replace(x, r"\.$", ""))), lambda x: x != "").alias("authors"), F.col("r.pubYear").try_cast("int").alias("year"),
    )


def fan_out(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all rows, rows by source); a source that is missing is simply absent."""
    rows = None
    for df in parts.values():
        rows = df if rows is None else rows.unionByName(df)
    return rows, rows.groupBy("source").agg(F.count("*").alias("rows"))


def once_per_identity(rows: DataFrame, order: str) -> DataFrame:
    """Rows of which no earlier kept row shares an identity (pmid, pmcid, doi in lower case, url): first wins, and a row
    that was dropped drops no other. Decided per query, whose answers are a bounded list."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[tuple[str, str]] = set()
        take = []
        for i, r in enumerate(pdf.sort_values(order).itertuples()):
            keys = {(k, v.lower() if k == "doi" else v) for k, v in (("pmid", r.pmid), ("pmcid", r.pmcid), ("doi", r.doi), ("url", r.canonical_url)) if isinstance(v, str) and v}
            if not keys & seen:
                take.append(i)
                seen |= keys
        return pdf.sort_values(order).iloc[take]

    return rows.groupBy("query_hash").applyInPandas(keep, rows.schema)
