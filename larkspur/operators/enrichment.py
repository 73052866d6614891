"""Queries that the own corpus cannot answer: terms to ask with, outside documents taken in, reports of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_column, clean_markup
from ..functions.urls import domain, url_hash
from . import concepts

#: Labels worth asking with, and the least score (fixed values).
ASKED_LABELS = ["PROBLEM", "SYMPTOM", "DISEASE", "ANATOMY", "TEST", "TREATMENT"]
LEAST_SCORE = 0.45
#: Headings of sections that are no content (fixed values).
NO_CONTENT = ["Publication metadata", "MeSH terms", "Journal"]
#: A tagger's own labels and ours (fixed values).
LABELS = {
    "Disease_disorder": "PROBLEM", "Sign_symptom": "SYMPTOM", "Medication": "TREATMENT", "Therapeutic_procedure": "TREATMENT",
    "Diagnostic_procedure": "TEST", "Lab_value": "TEST", "Biological_structure": "ANATOMY", "Biological_attribute": "ANATOMY",
}


def own_label(label: str | Column) -> Column:
    """Our label for a tagger's; null for one that has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), as_column(label))


def asked_terms(query: str | Column, ner: str | Column) -> Column:
    """What to ask with: entities of the query, else its concepts, else its parts between commas and "and".

    Entities count from LEAST_SCORE and three characters on, each once whatever its case, in the order of the text."""
    word = lambda e: F.trim(F.regexp_replace(e["text"], r"\s+", " "))
    good = F.filter(as_column(ner), lambda e: e["label"].isin(*ASKED_LABELS) & (e["score"] >= LEAST_SCORE) & (F.length(word(e)) >= 3) & ~word(e).startswith("##"))
    named = F.transform(F.array_sort(F.transform(good, lambda e, i: F.struct(e["start_char"].alias("a"), i.alias("i"), word(e).alias("w")))), lambda e: e["w"])
    lows = F.transform(named, lambda w: F.lower(w))
    once = F.filter(named, lambda w, i: F.array_position(lows, F.lower(w)) == i + 1)
    held = concepts.extract(query)
    parts = F.filter(F.transform(F.split(as_column(query), r"(?i),\s*|\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(F.size(once), F.lit(0)) > 0, once).when(F.size(held) > 0, held).otherwise(parts)


def has_content(sections: str | Column, abstract: str | Column) -> Column:
    """Whether an outside document has more to it than a title and publication data."""
    real = F.exists(F.coalesce(as_column(sections), F.array().cast("array<struct<heading:string,text:string>>")), lambda s: ~s["heading"].isin(*NO_CONTENT) & (F.trim(s["text"]) != ""))
    return F.coalesce(real, F.lit(False)) | (F.trim(F.coalesce(as_column(abstract), F.lit(""))) != "")


def to_acquired(external: DataFrame, fetched_at: str | Column) -> DataFrame:
    """Outside documents in the form of acquired ones; those without content are left out.

    external: query_hash, source, url, title, abstract, sections, authors, language. The seed is the query, its group the
    service; the id is the hash of the URL and the content hash that of the body."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    kept = F.filter("sections", lambda s: F.trim(s["text"]) != "")
    head = lambda s: F.coalesce(some(s["heading"]), F.lit("main"))
    clean = F.transform(kept, lambda s: F.struct(head(s).alias("heading"), clean_markup(s["text"]).alias("text")))
    joined = F.array_join(F.transform(clean, lambda s: F.when(s["heading"] == "main", s["text"]).otherwise(F.concat(s["heading"], F.lit("\n"), s["text"]))), "\n")
    body = F.coalesce(some(joined), some(clean_markup("abstract")), clean_markup("title"))
    rows = external.where(has_content("sections", "abstract")).withColumns({"_clean": clean, "_body": body})
    crawl = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.col("query_hash").alias("seed_id"), F.concat(F.lit("api_"), "source").alias("seed_group"))
    content = F.struct(F.lit("application/json").alias("mime_type"), some(clean_markup("title")).alias("title"), F.col("_clean").alias("sections"), F.col("_body").alias("body"))
    meta = F.struct(F.when(F.size("authors") > 0, F.array_join("authors", ", ")).alias("author"), F.coalesce("language", F.lit("en")).alias("language"))
    return rows.select(
        url_hash("url").alias("doc_id"), "url", domain("url").alias("source_domain"), as_column(fetched_at).alias("fetched_at"), crawl.alias("crawl"), content.alias("content"), meta.alias("page_meta"), F.sha2("_body", 256).alias("content_hash")
    )


def retrieval_counts(external: DataFrame, failed: DataFrame, by: str = "query_hash") -> DataFrame:
    """Documents by service and in all, and the services that failed, of each query. failed: (query_hash, source)."""
    n = external.groupBy(by, "source").agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"), F.sum("n").alias("total"))
    f = failed.groupBy(by).agg(F.array_sort(F.collect_set("source")).alias("failed"))
    return n.join(f, by, "full_outer").select(by, "by_source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("failed", F.array().cast("array<string>")).alias("failed"))


def dedup_counts(retrieved: DataFrame, fresh: DataFrame, by: str) -> DataFrame:
    """Retrieved, removed as duplicates and new documents, by a column."""
    a, b = retrieved.groupBy(by).agg(F.count("*").alias("retrieved")), fresh.groupBy(by).agg(F.count("*").alias("new_documents"))
    j = a.join(b, by, "left").withColumn("new_documents", F.coalesce("new_documents", F.lit(0)))
    return j.select(by, "retrieved", (F.col("retrieved") - F.col("new_documents")).alias("removed"), "new_documents")


def route(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that the corpus answers, and those that must ask outside. judged: with the column sufficient."""
    return judged.where("sufficient"), judged.where(~F.coalesce("sufficient", F.lit(False)))


def canonical_name(names: DataFrame, table: DataFrame, name: str = "name") -> DataFrame:
    """All columns and ``canonical``: the preferred name of a concept table (alias, preferred), else the name itself."""
    known = table.groupBy(F.lower(F.trim("alias")).alias("_a")).agg(F.min("preferred").alias("_p"))
    return names.join(known, F.lower(F.trim(F.col(name))) == F.col("_a"), "left").withColumn("canonical", F.coalesce("_p", F.col(name))).drop("_a", "_p")


def card_title(doc_title: str | Column, title: str | Column, heading: str | Column, url_title: str | Column, host: str | Column) -> Column:
    """What a result is called: the document's title, else the evidence's, its heading, the URL's words, the host."""
    some = lambda c: F.when(F.trim(as_column(c)) != "", F.trim(as_column(c)))
    return F.coalesce(*[some(c) for c in (doc_title, title, heading, url_title, host)])
