"""Scores, groups, diversity and evidence of candidates, for many queries at once."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicons import PREFERRED_SECTIONS, SOURCE_RELIABILITY
from ..functions.names import grouping_name
from ..functions.text import as_column, clamp, jaccard, lookup, round6, sigmoid
from ..functions.urls import source_of
from ..runtime import materialize
from . import concepts

WEIGHTS = {"cross_encoder": 0.65, "hybrid": 0.25, "symptom_coverage": 0.05, "authority": 0.05, "freshness": 0.0}


def section_score(heading: str | Column) -> Column:
    """The score of the first preferred section whose name the heading contains; 0.65 for none, 0.70 without a heading."""
    h = as_column(heading)
    out = F.when(h.isNull() | (F.trim(h) == ""), 0.70)
    for name, score in PREFERRED_SECTIONS:
        out = out.when(F.lower(F.trim(h)).contains(name), score)
    return out.otherwise(0.65)


def min_max(score: str | Column, by: str = "query_id") -> Column:
    """Into [0, 1] within each query; 1 when all are equal, null stays."""
    s = as_column(score)
    w = W.partitionBy(by)
    lo, hi = F.min(s).over(w), F.max(s).over(w)
    return F.when(s.isNull(), None).when(hi == lo, 1.0).otherwise((s - lo) / (hi - lo))


def maybe_sigmoid(score: str | Column, by: str = "query_id") -> Column:
    """Through the sigmoid for queries that have any score outside [0, 1]."""
    s = as_column(score)
    w = W.partitionBy(by)
    return F.when((F.min(s).over(w) < 0) | (F.max(s).over(w) > 1), sigmoid(s)).otherwise(s)


def normalise_scores(c: DataFrame, by: str = "query_id") -> DataFrame:
    """ce, hybrid, lexical and vector in [0, 1] within each query; a missing score counts 0."""
    c = c.withColumn("_ce", maybe_sigmoid("cross_encoder_score", by))
    zero = lambda s: F.coalesce(min_max(s, by), F.lit(0.0))
    return c.withColumns({"ce": zero("_ce"), "hybrid": zero("hybrid_score"), "lexical": zero("lexical_score"), "vector": zero("vector_score")}).drop("_ce")


def authority(source: str | Column, url: str | Column) -> Column:
    d = source_of(F.coalesce(F.when(as_column(source) != "", as_column(source)), as_column(url)))
    return F.when(d == "", 0.40).otherwise(lookup(d, SOURCE_RELIABILITY, F.lit(0.55)))


def freshness(dates: list[str], reference: str) -> Column:
    """Steps by age in days from the first date that can be read; 0.60 without any. ``reference`` is an ISO time in UTC."""
    parsed = [F.try_to_timestamp(F.col(d), F.lit(f)) for d in dates for f in ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd")]
    age = F.floor((F.unix_timestamp(F.to_timestamp(F.lit(reference), "yyyy-MM-dd'T'HH:mm:ssX")) - F.unix_timestamp(F.coalesce(*parsed))) / 86400)
    return F.when(age.isNull(), 0.60).when(age <= 180, 1.0).when(age <= 365, 0.85).when(age <= 730, 0.70).when(age <= 1825, 0.55).otherwise(0.40)


def signal(best: Column, top3: Column, n: Column) -> Column:
    """0.7 of the best, 0.2 of the mean of the best three, 0.1 of a density that five chunks fill."""
    return clamp(0.7 * best + 0.2 * top3 + 0.1 * F.least(F.lit(1.0), F.log(1.0 + n) / math.log(6)))


def problem_names(ner: str | Column, least: float = 0.5, most: int = 3) -> Column:
    """Up to ``most`` distinct conditions of a chunk's PROBLEM entities, the best first, as structs (name, display)."""
    found = F.transform(F.coalesce(as_column(ner), F.array().cast("array<struct<text:string,label:string,start_char:int,end_char:int,score:double>>")), lambda e, i: F.struct((-F.coalesce(e["score"], F.lit(0.0))).alias("s"), i.alias("i"), grouping_name(e["text"]).alias("name"), F.trim(e["text"]).alias("display"), F.upper(e["label"]).alias("label")))
    good = F.array_sort(F.filter(found, lambda e: (e["label"] == "PROBLEM") & (-e["s"] >= least) & (e["display"] != "") & (e["name"] != "")))
    names = F.transform(good, lambda e: e["name"])
    return F.slice(F.transform(F.filter(good, lambda e, i: F.array_position(names, e["name"]) == i + 1), lambda e: F.struct(e["name"].alias("name"), e["display"].alias("display"))), 1, most)


def group_rows(c: DataFrame, ner: str | None = None) -> DataFrame:
    """Each candidate under the groups of its conditions, or, without any, under that of its title or its document; one
    row per group and chunk. ``ner``: the column of the chunk's entities."""
    words = lambda x: F.trim(F.regexp_replace(x, r"[-_]+", " "))
    some = lambda x: F.when(F.trim(x) != "", F.trim(x))
    path = F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    slug = words(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", ""))
    title = grouping_name("title")
    shown = F.coalesce(some(F.col("title")), some(F.col("section_heading")), some(slug), some(words(F.col("doc_id"))), F.lit("unknown condition"))
    key = F.when(title != "", F.concat(F.lit("__doc_title__"), title)).otherwise(F.concat(F.lit("__doc_id__"), F.col("doc_id")))
    alone = F.struct(key.alias("group_key"), F.when(title != "", title).otherwise(grouping_name(shown)).alias("disease"), shown.alias("display"))
    names = problem_names(ner) if ner else F.array().cast("array<struct<name:string,display:string>>")
    groups = F.transform(names, lambda n: F.struct(n["name"].alias("group_key"), n["name"].alias("disease"), n["display"].alias("display")))
    rows = c.withColumn("_g", F.explode(F.when(F.size(groups) > 0, groups).otherwise(F.array(alone)))).select(*c.columns, "_g.*")
    first = W.partitionBy("query_id", "group_key", "chunk_id").orderBy("position")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def explanation() -> Column:
    """What is said about a scored group, from its columns; never empty."""
    ce, auth = F.col("cross_encoder"), F.col("authority")
    says = F.array_compact(
        F.array(
            F.when(ce >= 0.70, "High semantic relevance between the query and the retrieved evidence.").when(ce >= 0.45, "Moderate semantic relevance to the user's query."),
            F.when(F.size("matched") > 0, F.concat(F.lit("Matches symptoms or concepts from the query: "), F.array_join(F.slice("matched", 1, 4), ", "), F.lit("."))),
            F.when((auth >= 0.85) & (F.size("sources") > 0), F.concat(F.lit("Includes evidence from trusted clinical sources: "), F.array_join(F.slice("sources", 1, 3), ", "), F.lit("."))),
            F.when(F.col("evidences") >= 3, "Has several retrieved evidence chunks associated with this clinical condition."),
            F.when(F.coalesce(F.col("mmr"), F.lit(0.0)) != 0, "Selected by balancing relevance and diversity against other results."),
        )
    )
    return F.when(F.size(says) > 0, says).otherwise(F.array(F.lit("Informative result retrieved to support the differential analysis.")))


def score_groups(rows: DataFrame, queries: DataFrame, reference: str = "2024-06-01T00:00:00Z", weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, group_key, disease, display, component scores, relevance, evidences, sources, concepts).

    rows: what :func:`group_rows` gives, with normalised scores; queries: (query_id, query). All aggregation is by
    query and group; lists hold what one group of one query has."""
    w = weights or WEIGHTS
    g = ["query_id", "group_key"]
    rows = rows.withColumns({"src": source_of(F.coalesce(F.when(F.col("source_domain") != "", F.col("source_domain")), F.col("url"))), "auth": authority("source_domain", "url"), "fresh": freshness(["published_at", "fetched_at"], reference)})
    order = lambda s: W.partitionBy(*g).orderBy(F.col(s).desc(), F.col("position"))
    # a chunk's concepts are found before its text is left behind: only the texts of the first three evidences are gathered
    rows = rows.withColumns({"rc": F.row_number().over(order("ce")), "rh": F.row_number().over(order("hybrid")), "_e": F.row_number().over(W.partitionBy(*g).orderBy("position")), "_held": concepts.by_alias("text")})
    top = lambda s, r: F.avg(F.when(F.col(r) <= 3, F.col(s)))
    stats = rows.groupBy(*g).agg(
        F.min(F.struct("position", "disease", "display")).alias("_f"),
        F.count("*").alias("evidences"),
        signal(F.max("ce"), top("ce", "rc"), F.count("*")).alias("cross_encoder"),
        signal(F.max("hybrid"), top("hybrid", "rh"), F.count("*")).alias("hybrid"),
        F.max(F.when(F.col("rc") == 1, F.col("fresh"))).alias("_f1"),
        F.max(F.when(F.col("rc") <= 3, F.col("fresh"))).alias("_f3"),
        F.max("auth").alias("_a"),
        F.array_sort(F.collect_set(F.when(F.col("src") != "", F.col("src")))).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("concept_ids")))).alias("concepts"),
        F.array_distinct(F.flatten(F.collect_list("_held"))).alias("_held"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(F.col("_e") <= 3, F.struct("position", "text")))), lambda x: x["text"])).alias("_text"),
    )
    per_source = rows.where("src <> ''").groupBy(*g, "src").agg(F.max("auth").alias("a")).groupBy(*g).agg(F.avg("a").alias("_avg"), F.max("a").alias("_max"))
    stats = stats.join(per_source, g, "left").join(queries.select("query_id", concepts.of_query("query").alias("_asked")), "query_id", "left")
    held = F.array_union("concepts", "_held")
    asked = F.coalesce(F.size("_asked"), F.lit(0))
    matched = F.array_intersect("_asked", held)
    parts = {
        "symptom_coverage": F.when(asked <= 0, 0.5).otherwise(F.size(matched) / asked.cast("double")),
        "authority": clamp(F.coalesce(0.75 * F.col("_max") + 0.25 * F.col("_avg"), F.col("_a"))),
        "freshness": clamp(0.7 * F.col("_f1") + 0.3 * F.col("_f3")),
    }
    stats = stats.withColumns(parts).withColumn("matched", F.when(asked <= 0, F.array().cast("array<string>")).otherwise(F.array_sort(matched)))
    total = sum(w.values()) or 1.0
    relevance = sum((F.lit(v) * F.col(k) for k, v in w.items()), F.lit(0.0)) / total
    return stats.select(
        "query_id", "group_key", F.col("_f.disease").alias("disease"), F.col("_f.display").alias("display"), F.col("_f.position").alias("position"), "evidences", "sources", "concepts", "matched",
        *[round6(clamp(k)).alias(k) for k in w], round6(clamp(relevance)).alias("relevance"), "_text",
    )


def label(relevance: str = "relevance", ce: str = "cross_encoder", cov: str = "symptom_coverage", auth: str = "authority") -> Column:
    high = (F.col(relevance) >= 0.75) & (F.col(ce) >= 0.60) & ((F.col(cov) >= 0.50) | (F.col(auth) >= 0.85))
    return F.when(high, "High").when(F.col(relevance) >= 0.50, "Medium").otherwise("Low")


def evidence_score() -> Column:
    """0.65 of the reranker, 0.20 of the source's authority, 0.15 of the section."""
    return 0.65 * F.col("ce") + 0.20 * authority("source_domain", "url") + 0.15 * section_score("section_heading")


def _similar(a: pd.Series, b: pd.Series) -> float:
    if a["disease"] == b["disease"]:
        return 1.0
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    return min(1.0, 0.5 * jac(a["c"], b["c"]) + 0.3 * jac(a["t"], b["t"]) + 0.2 * jac(a["s"], b["s"]))


def _likeness(a: Column, b: Column) -> Column:
    """:func:`_similar` as a column, from two structs of disease, concepts, sources and words."""
    jac = lambda x: jaccard(a[x], b[x])
    return F.when(a["disease"] == b["disease"], 1.0).otherwise(F.least(F.lit(1.0), 0.5 * jac("concepts") + 0.3 * jac("words") + 0.2 * jac("sources")))


def _choose_in_rounds(groups: DataFrame, top: int, trade: float) -> DataFrame:
    """The choice of :func:`diversify` without bringing a query's groups together: a round is one aggregate, and only the
    groups chosen so far, ``top`` a query at most, are joined to the rest."""
    chosen = None
    for n in range(top):
        if chosen is None:
            left = groups.withColumn("_v", F.col("relevance"))
        else:
            held = chosen.groupBy("query_id").agg(F.collect_list(F.struct("group_key", "disease", "concepts", "sources", "words")).alias("_held"))
            left = groups.join(held, "query_id").where(~F.exists("_held", lambda h: h["group_key"] == F.col("group_key")))
            own = F.struct("disease", "concepts", "sources", "words")
            left = left.withColumn("_v", trade * F.col("relevance") - (1 - trade) * F.array_max(F.transform("_held", lambda h: _likeness(own, h))))
        # the keys before the lists are unique within a query, so the lists are carried and never compared
        best = F.min(F.struct((-F.col("_v")).alias("v"), (-F.col("relevance")).alias("r"), "position", "group_key", "disease", "relevance", "concepts", "sources", "words"))
        picks = left.groupBy("query_id").agg(best.alias("_b")).select("query_id", "_b.*", F.lit(n + 1).alias("rank"))
        picks = materialize(picks, "mmr-round")
        chosen = picks if chosen is None else chosen.unionByName(picks)
    as_python = F.udf(lambda v: round(v, 6), "double")
    return chosen.select("query_id", "group_key", "disease", "relevance", as_python(-F.col("v")).alias("mmr"), "rank")


def diversify(groups: DataFrame, top: int = 10, trade: float = 0.8, local: int = 1000) -> DataFrame:
    """(query_id, group_key, disease, relevance, mmr, rank): relevance against likeness to what is chosen already.

    groups: what :func:`score_groups` gives. The choice is that over all groups of a query: only those are left out whose
    relevance is more than (1 - trade) / trade below the ``top``-th best, which no likeness in [0, 1] can make up for. A
    query that keeps up to ``local`` groups is settled in one Python group, any larger one in distributed rounds."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("_text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 3))
    kept = materialize(groups.select("query_id", "group_key", "disease", "relevance", "position", "concepts", "sources", words.alias("words")), "groups")
    if trade > 0:
        slack = max(0.0, (1 - trade) / trade) + 1e-9
        last = kept.select("query_id", "relevance").withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("relevance").desc()))).where(F.col("_r") == top)
        kept = kept.join(last.select("query_id", (F.col("relevance") - slack).alias("_least")), "query_id", "left").where(F.col("_least").isNull() | (F.col("relevance") >= F.col("_least"))).drop("_least")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["relevance", "position", "group_key"], ascending=[False, True, True])
        items = [{"disease": r.disease, "c": set(r.concepts), "s": set(r.sources), "t": set(r.words), "rel": r.relevance, "key": r.group_key} for r in left.itertuples()]
        chosen: list[tuple[dict, float]] = []
        near = [0.0] * len(items)
        while items and len(chosen) < top:
            value = [i["rel"] if not chosen else trade * i["rel"] - (1 - trade) * n for i, n in zip(items, near)]
            at = max(range(len(items)), key=lambda k: (value[k], items[k]["rel"], -k))
            pick = items.pop(at)
            near.pop(at)
            chosen.append((pick, round(value[at], 6)))
            near = [max(n, _similar(i, pick)) for i, n in zip(items, near)]
        return pd.DataFrame([(pdf.query_id.iloc[0], i["key"], i["disease"], i["rel"], v, n + 1) for n, (i, v) in enumerate(chosen)], columns=["query_id", "group_key", "disease", "relevance", "mmr", "rank"])

    kind = groups.schema["query_id"].dataType.simpleString()
    settle = lambda g: g.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, group_key string, disease string, relevance double, mmr double, rank int")
    large = materialize(kept.groupBy("query_id").count().where(F.col("count") > local).select("query_id"), "large-queries")
    if large.isEmpty():
        return settle(kept)
    rounds = _choose_in_rounds(materialize(kept.join(large, "query_id", "left_semi"), "large-groups"), top, trade)
    return settle(kept.join(large, "query_id", "left_anti")).unionByName(rounds)


def select_evidence(rows: DataFrame, most: int = 3, same: float = 0.85) -> DataFrame:
    """(query_id, group_key, chunk_id, place): the best chunks of each group, none nearly equal to a better one.

    An array fold over the group's chunks; no Python."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 3))
    item = F.struct((-round6(evidence_score())).alias("s"), F.col("position").alias("p"), F.col("chunk_id").alias("chunk_id"), words.alias("w"))
    g = rows.groupBy("query_id", "group_key").agg(F.array_sort(F.collect_list(item)).alias("l"))
    add = lambda acc, e: F.when((F.size(acc) >= most) | F.exists(acc, lambda o: jaccard(o["w"], e["w"]) >= same), acc).otherwise(F.concat(acc, F.array(e)))
    chosen = F.aggregate("l", F.slice("l", 1, 0), add)
    return g.select("query_id", "group_key", F.posexplode(chosen).alias("place", "e")).select("query_id", "group_key", F.col("e.chunk_id").alias("chunk_id"), (F.col("place") + 1).alias("place"))
