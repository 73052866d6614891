"""Queries over windows, groups, positioning, sufficiency and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicons import ACRONYMS
from ..operators import context, diseases, entities, positioning, sufficiency
from ..runtime import materialize, table
from .registry import query
from .text_queries import SOURCE_SQL, r6


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """One row per query and chunk with its best scores, and its place by hybrid score from 0."""
    c = table(spark, d, "positioning_candidates")
    rest = ["doc_id", "text", "title", "url", "source_domain", "section_heading", "fetched_at", "published_at"]
    best = c.groupBy("query_id", "chunk_id").agg(
        *[F.max(s).alias(s) for s in ("lexical_score", "vector_score", "hybrid_score", "cross_encoder_score")], *[F.min(x).alias(x) for x in rest], F.array_sort(F.array_distinct(F.flatten(F.collect_list("concept_ids")))).alias("concept_ids")
    )
    return best.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("hybrid_score").desc(), "chunk_id")) - 1)


CANDIDATES_SQL = """cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, chunk_id) - 1 AS position FROM (
  SELECT query_id, chunk_id, max(lexical_score) AS lexical_score, max(vector_score) AS vector_score, max(hybrid_score) AS hybrid_score, max(cross_encoder_score) AS cross_encoder_score, min(doc_id) AS doc_id, min(text) AS text, min(title) AS title, min(url) AS url,
    min(source_domain) AS source_domain, min(section_heading) AS section_heading, min(fetched_at) AS fetched_at, min(published_at) AS published_at FROM positioning_candidates GROUP BY query_id, chunk_id))"""


def _mm(s: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    return f"coalesce(CASE WHEN {s} IS NULL THEN NULL WHEN max({s}) {w} = min({s}) {w} THEN 1.0 ELSE ({s} - min({s}) {w}) / (max({s}) {w} - min({s}) {w}) END, 0.0)"


_CE = "CASE WHEN min(cross_encoder_score) OVER (PARTITION BY query_id) < 0 OR max(cross_encoder_score) OVER (PARTITION BY query_id) > 1 THEN CASE WHEN cross_encoder_score >= 0 THEN 1 / (1 + exp(-cross_encoder_score)) ELSE exp(cross_encoder_score) / (1 + exp(cross_encoder_score)) END ELSE cross_encoder_score END"
NORMAL_SQL = f"{CANDIDATES_SQL}, sig AS (SELECT *, {_CE} AS sce FROM cand), norm AS (SELECT *, {_mm('sce')} AS ce, {_mm('hybrid_score')} AS hybrid, {_mm('lexical_score')} AS lexical, {_mm('vector_score')} AS vector FROM sig)"


@query("g06_g07_m02_normalized_scores", f"WITH {NORMAL_SQL} SELECT query_id, chunk_id, {r6('ce')} AS ce, {r6('hybrid')} AS hybrid, {r6('lexical')} AS lexical, {r6('vector')} AS vector FROM norm")
def g06(spark: SparkSession, d: str) -> DataFrame:
    n = positioning.normalise_scores(_candidates(spark, d))
    return n.select("query_id", "chunk_id", *[text.round6(c).alias(c) for c in ("ce", "hybrid", "lexical", "vector")])


@query("g01_rank_in_list", f"WITH {CANDIDATES_SQL} SELECT query_id, chunk_id, CAST(position + 1 AS INTEGER) AS rank FROM cand WHERE position < 5")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).where("position < 5").select("query_id", "chunk_id", (F.col("position") + 1).alias("rank"))


_AUTH = "CASE WHEN {s} = '' THEN 0.4 WHEN {s} = 'medlineplus.gov' THEN 1.0 WHEN {s} IN ('cdc.gov', 'who.int', 'mayoclinic.org') THEN 0.95 WHEN {s} IN ('nhs.uk', 'msdmanuals.com') THEN 0.9 ELSE 0.55 END"
_SRC = SOURCE_SQL.format("coalesce(nullif(source_domain, ''), url)")
_FRESH = "CASE WHEN age IS NULL THEN 0.6 WHEN age <= 180 THEN 1.0 WHEN age <= 365 THEN 0.85 WHEN age <= 730 THEN 0.7 WHEN age <= 1825 THEN 0.55 ELSE 0.4 END"


@query(
    "m08_m09_authority_freshness",
    f"""WITH {CANDIDATES_SQL}, x AS (SELECT query_id, chunk_id, {_SRC} AS s, (floor((1717200000 - epoch(coalesce(try_strptime(published_at, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(published_at, '%Y-%m-%d'), try_strptime(fetched_at, '%Y-%m-%dT%H:%M:%SZ')))) / 86400)) AS age FROM cand)
    SELECT query_id, chunk_id, CAST({_AUTH.format(s='s')} AS DOUBLE) AS authority, CAST({_FRESH} AS DOUBLE) AS freshness FROM x""",
)
def m08(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return c.select("query_id", "chunk_id", positioning.authority("source_domain", "url").cast("double").alias("authority"), positioning.freshness(["published_at", "fetched_at"], "2024-06-01T00:00:00Z").cast("double").alias("freshness"))


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in their groups; a chunk's entities are those of its first hit."""
    ner = table(spark, d, "search_hits").where("chunk_id is not null").groupBy("chunk_id").agg(F.min_by("ner_entities", "hit_id").alias("ner"))
    return positioning.group_rows(positioning.normalise_scores(_candidates(spark, d)).join(ner, "chunk_id", "left"), "ner")


def _group_name_sql(x: str) -> str:
    n = rf"regexp_replace(lower(trim(coalesce({x}, ''), ' ')), '[_\-]+', ' ', 'g')"
    n = rf"regexp_replace(regexp_replace({n}, '^\d+\s+', ''), '\s+', ' ', 'g')"
    n = rf"regexp_replace(regexp_replace({n}, '\s+(?:symptoms?|signs?|disease|disorder|syndrome)\s*$', ''), '^[ .,:;]+|[ .,:;]+$', '', 'g')"
    return f"coalesce(map_extract_value(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in ACRONYMS.items())}}}, {n}), {n})"


_SLUG = r"trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '\.[A-Za-z0-9]+$', ''), '[-_]+', ' ', 'g'), ' ')"


@query(
    "m03_groups",
    f"""WITH {CANDIDATES_SQL}, ner AS (SELECT chunk_id, arg_min(ner_entities, hit_id) AS ner FROM search_hits WHERE chunk_id IS NOT NULL GROUP BY chunk_id), c AS (SELECT cand.*, ner FROM cand LEFT JOIN ner USING (chunk_id)),
    e AS (SELECT query_id, chunk_id, name, trim(u.text, ' ') AS display, u.score AS score, i FROM (SELECT *, {_group_name_sql('u.text')} AS name FROM (SELECT query_id, chunk_id, ner[i] AS u, i FROM (SELECT query_id, chunk_id, ner, unnest(range(1, len(ner) + 1)) AS i FROM c))) WHERE upper(u.label) = 'PROBLEM' AND coalesce(u.score, 0) >= 0.5 AND trim(u.text, ' ') <> '' AND name <> ''),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, i) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id, name ORDER BY score DESC, i) AS k FROM e) WHERE k = 1) WHERE r <= 3),
    t AS (SELECT *, {_group_name_sql('title')} AS tk, coalesce(nullif(trim(title, ' '), ''), nullif(trim(section_heading, ' '), ''), nullif({_SLUG}, ''), nullif(trim(regexp_replace(doc_id, '[-_]+', ' ', 'g'), ' '), ''), 'unknown condition') AS shown FROM c),
    g AS (SELECT c.query_id, f.name AS group_key, f.display, c.chunk_id, c.position FROM f JOIN c USING (query_id, chunk_id) UNION ALL
      SELECT query_id, CASE WHEN tk <> '' THEN '__doc_title__' || tk ELSE '__doc_id__' || doc_id END, shown, chunk_id, position FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = t.query_id AND f.chunk_id = t.chunk_id))
    SELECT query_id, group_key, arg_min(display, position) AS display, count(DISTINCT chunk_id) AS evidences FROM g GROUP BY query_id, group_key""",
)
def m03(spark: SparkSession, d: str) -> DataFrame:
    g = _grouped(spark, d).groupBy("query_id", "group_key").agg(F.min(F.struct("position", "display")).alias("f"), F.count("*").alias("evidences"))
    return g.select("query_id", "group_key", F.col("f.display").alias("display"), "evidences")


def _sig(col: str) -> str:
    return f"greatest(0.0, least(1.0, 0.7 * max({col}) + 0.2 * avg(CASE WHEN r_{col} <= 3 THEN {col} END) + 0.1 * least(1.0, ln(1.0 + count(*)) / {__import__('math').log(6)!r})))"


@query(
    "f11_group_signals",
    f"""WITH {NORMAL_SQL}, n6 AS (SELECT query_id, doc_id, chunk_id, position, ce, hybrid FROM norm), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY ce DESC, position) AS r_ce, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY hybrid DESC, position) AS r_hybrid FROM n6)
    SELECT query_id, doc_id, {r6(_sig('ce'))} AS ce_signal, {r6(_sig('hybrid'))} AS hybrid_signal, count(*) AS evidences FROM rk GROUP BY query_id, doc_id""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    n = positioning.normalise_scores(_candidates(spark, d))
    order = lambda s: W.partitionBy("query_id", "doc_id").orderBy(F.col(s).desc(), "position")
    n = n.withColumns({"rc": F.row_number().over(order("ce")), "rh": F.row_number().over(order("hybrid"))})
    top = lambda s, r: F.avg(F.when(F.col(r) <= 3, F.col(s)))
    return n.groupBy("query_id", "doc_id").agg(text.round6(positioning.signal(F.max("ce"), top("ce", "rc"), F.count("*"))).alias("ce_signal"), text.round6(positioning.signal(F.max("hybrid"), top("hybrid", "rh"), F.count("*"))).alias("hybrid_signal"), F.count("*").alias("evidences"))


@query(
    "f12_f13_group_authority_freshness",
    f"""WITH {NORMAL_SQL}, x AS (SELECT query_id, doc_id, position, ce, {_SRC} AS s, (floor((1717200000 - epoch(coalesce(try_strptime(published_at, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(published_at, '%Y-%m-%d'), try_strptime(fetched_at, '%Y-%m-%dT%H:%M:%SZ')))) / 86400)) AS age FROM norm),
    y AS (SELECT *, CAST({_AUTH.format(s='s')} AS DOUBLE) AS a, CAST({_FRESH} AS DOUBLE) AS f, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY ce DESC, position) AS r FROM x),
    fr AS (SELECT query_id, doc_id, {r6('0.7 * max(CASE WHEN r = 1 THEN f END) + 0.3 * max(CASE WHEN r <= 3 THEN f END)')} AS freshness, max(a) AS any_a FROM y GROUP BY ALL),
    au AS (SELECT query_id, doc_id, {r6('0.75 * max(a) + 0.25 * avg(a)')} AS authority FROM (SELECT query_id, doc_id, s, max(a) AS a FROM y WHERE s <> '' GROUP BY ALL) GROUP BY ALL)
    SELECT query_id, doc_id, coalesce(authority, any_a) AS authority, freshness FROM fr LEFT JOIN au USING (query_id, doc_id)""",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    n = positioning.normalise_scores(_candidates(spark, d))
    n = n.withColumns({"s": positioning.source_of(F.coalesce(F.when(F.col("source_domain") != "", F.col("source_domain")), F.col("url"))), "a": positioning.authority("source_domain", "url").cast("double"), "f": positioning.freshness(["published_at", "fetched_at"], "2024-06-01T00:00:00Z").cast("double")})
    n = n.withColumn("r", F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.col("ce").desc(), "position")))
    fr = n.groupBy("query_id", "doc_id").agg(text.round6(0.7 * F.max(F.when(F.col("r") == 1, F.col("f"))) + 0.3 * F.max(F.when(F.col("r") <= 3, F.col("f")))).alias("freshness"), F.max("a").alias("any_a"))
    au = n.where("s <> ''").groupBy("query_id", "doc_id", "s").agg(F.max("a").alias("a")).groupBy("query_id", "doc_id").agg(text.round6(0.75 * F.max("a") + 0.25 * F.avg("a")).alias("authority"))
    return fr.join(au, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("authority", "any_a").alias("authority"), "freshness")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return positioning.score_groups(_grouped(spark, d), table(spark, d, "query_log").select("query_id", "query"))


@query("m04_c42_scored_groups")
def m04(spark: SparkSession, d: str) -> DataFrame:
    g = _scored(spark, d)
    return g.select("query_id", "group_key", "display", "evidences", "sources", "matched", "cross_encoder", "hybrid", "symptom_coverage", "authority", "freshness", "relevance", positioning.label().alias("label"))


@query("m06_g12_diversified")
def m06(spark: SparkSession, d: str) -> DataFrame:
    return positioning.diversify(_scored(spark, d))


@query("m07_g11_evidence")
def m07(spark: SparkSession, d: str) -> DataFrame:
    return positioning.select_evidence(_grouped(spark, d))


@query("m10_positioned")
def m10(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain: normalise, group, score, diversify, choose evidence."""
    rows = materialize(_grouped(spark, d), "grouped")
    scored = materialize(positioning.score_groups(rows, table(spark, d, "query_log").select("query_id", "query")), "scored")
    best = positioning.diversify(scored)
    proof = positioning.select_evidence(rows).groupBy("query_id", "group_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("evidence"))
    return best.join(scored.select("query_id", "group_key", "display", positioning.label().alias("label")), ["query_id", "group_key"]).join(proof, ["query_id", "group_key"], "left")


@query(
    "g10_evidence_order",
    f"""WITH {NORMAL_SQL}, x AS (SELECT query_id, chunk_id, {r6("0.65 * ce + 0.20 * " + _AUTH.format(s="s") + " + 0.15 * sec")} AS score FROM (SELECT *, {_SRC} AS s, CASE WHEN section_heading IS NULL OR trim(section_heading) = '' THEN 0.7 WHEN contains(lower(section_heading), 'symptoms') THEN 1.0 WHEN contains(lower(section_heading), 'overview') THEN 0.95 WHEN contains(lower(section_heading), 'causes') THEN 0.9 WHEN contains(lower(section_heading), 'diagnosis') THEN 0.9 WHEN contains(lower(section_heading), 'treatment') THEN 0.75 WHEN contains(lower(section_heading), 'main') THEN 0.7 ELSE 0.65 END AS sec FROM norm))
    SELECT query_id, chunk_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM x) WHERE r <= 5""",
)
def g10(spark: SparkSession, d: str) -> DataFrame:
    n = positioning.normalise_scores(_candidates(spark, d)).select("query_id", "chunk_id", text.round6(positioning.evidence_score()).alias("score"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))).where("rank <= 5")


def _ranked_hits(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "hit_id")) - 1)
    return h.select(F.col("query_id").alias("query"), "position", F.coalesce("chunk_id", "doc_id").alias("chunk_id"), "title", "url", F.col("section_heading").alias("heading"), F.col("ner_entities").alias("ner"))


@query("f15_l03_conditions")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return diseases.aggregate(_ranked_hits(spark, d))


@query("g08_best_entity", "SELECT hit_id, e.text AS entity, e.score AS score FROM (SELECT hit_id, list_filter(ner_entities, lambda e: e.label = 'PROBLEM' AND e.score >= 0.5) AS l FROM search_hits) CROSS JOIN LATERAL (SELECT l[list_position(list_transform(l, lambda x: x.score), list_max(list_transform(l, lambda x: x.score)))] AS e) WHERE len(l) > 0")
def g08(spark: SparkSession, d: str) -> DataFrame:
    best = F.array_max(F.transform(F.filter("ner_entities", lambda e: (e["label"] == "PROBLEM") & (e["score"] >= 0.5)), lambda e, i: F.struct(e["score"].alias("score"), (-i).alias("i"), e["text"].alias("t"))))
    return table(spark, d, "search_hits").select("hit_id", best.alias("b")).where("b is not null").select("hit_id", F.col("b.t").alias("entity"), F.col("b.score").alias("score"))


@query("g17_entities_without_overlap")
def g17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", entities.without_overlaps("ner_entities").alias("entities"))


@query(
    "g18_merged_spans",
    """WITH e AS (SELECT hit_id, content, u.label AS label, u.start_char AS a, u.end_char AS b FROM (SELECT hit_id, content, unnest(ner_entities) AS u FROM search_hits)),
    l AS (SELECT *, lag(b) OVER w AS pb, lag(label) OVER w AS pl FROM e WINDOW w AS (PARTITION BY hit_id ORDER BY a, b, label)),
    f AS (SELECT *, CASE WHEN pl = label AND a - pb BETWEEN 0 AND 4 AND NOT regexp_matches(coalesce(substr(content, pb + 1, a - pb), ''), '[.!?;:]') THEN 0 ELSE 1 END AS fresh FROM l),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY hit_id ORDER BY a, b, label ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT hit_id, label, min(a) AS start_char, max(b) AS end_char, count(*) AS spans FROM g GROUP BY hit_id, label, island""",
)
def g18(spark: SparkSession, d: str) -> DataFrame:
    return entities.merged_spans(table(spark, d, "search_hits"), "hit_id", "ner_entities", "content")


@query(
    "g09_top_entities_per_chunk",
    f"""WITH e AS (SELECT hit_id, i, u.score AS score, {_group_name_sql('u.text')} AS name FROM (SELECT hit_id, ner_entities[i] AS u, i FROM (SELECT hit_id, ner_entities, unnest(range(1, len(ner_entities) + 1)) AS i FROM search_hits)) WHERE upper(u.label) = 'PROBLEM' AND u.score >= 0.5 AND trim(u.text, ' ') <> ''),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hit_id, name ORDER BY score DESC, i) AS n FROM e WHERE name <> '') WHERE n = 1)
    SELECT hit_id, name, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY score DESC, i) AS r FROM k) WHERE r <= 3""",
)
def g09(spark: SparkSession, d: str) -> DataFrame:
    names = positioning.problem_names("ner_entities")
    return table(spark, d, "search_hits").select("hit_id", F.posexplode(names).alias("p", "n")).select("hit_id", F.col("n.name").alias("name"), (F.col("p") + 1).alias("rank"))


@query(
    "h08_h09_distinct_evidence",
    f"WITH {CANDIDATES_SQL} SELECT query_id, doc_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id, doc_id ORDER BY position) AS INTEGER) AS place FROM cand",
)
def h08(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("query_id", "doc_id", "chunk_id", F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("position")).alias("place"))


@query(
    "e10_linked_results",
    f"""WITH {CANDIDATES_SQL}, a AS (SELECT query_id, chunk_id, lower(title) AS name, position FROM cand WHERE title IS NOT NULL), h AS (SELECT query_id, lower(title) AS name, min(hit_id) AS hit_id FROM search_hits WHERE title IS NOT NULL GROUP BY ALL),
    b AS (SELECT query_id, chunk_id, min(hit_id) AS hit_id FROM search_hits WHERE chunk_id IS NOT NULL GROUP BY ALL)
    SELECT c.query_id, c.chunk_id, coalesce(h.hit_id, b.hit_id) AS hit_id, CASE WHEN h.hit_id IS NOT NULL THEN 'name' WHEN b.hit_id IS NOT NULL THEN 'chunk' END AS linked_by FROM cand c LEFT JOIN h ON c.query_id = h.query_id AND lower(c.title) = h.name LEFT JOIN b ON c.query_id = b.query_id AND c.chunk_id = b.chunk_id""",
)
def e10(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits")
    h = hits.where("title is not null").groupBy("query_id", F.lower("title").alias("name")).agg(F.min("hit_id").alias("h1"))
    b = hits.where("chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.min("hit_id").alias("h2"))
    c = _candidates(spark, d).select("query_id", "chunk_id", F.lower("title").alias("name")).join(h, ["query_id", "name"], "left").join(b, ["query_id", "chunk_id"], "left")
    return c.select("query_id", "chunk_id", F.coalesce("h1", "h2").alias("hit_id"), F.when(F.col("h1").isNotNull(), "name").when(F.col("h2").isNotNull(), "chunk").alias("linked_by"))


# sufficiency ---------------------------------------------------------------------------------------------------------


def _results(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).where("cross_encoder_score is not null")
    w = W.partitionBy("query_id").orderBy(F.col("cross_encoder_score").desc(), "chunk_id")
    return c.select("query_id", F.row_number().over(w).alias("rank"), "doc_id", "source_domain", "text", F.col("cross_encoder_score").alias("score"))


_SUFF = f"""WITH {CANDIDATES_SQL}, r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cross_encoder_score DESC, chunk_id) AS rank, doc_id, source_domain, text, cross_encoder_score AS s FROM cand WHERE cross_encoder_score IS NOT NULL),
  n AS (SELECT *, CASE WHEN s BETWEEN 0 AND 1 THEN s WHEN s >= 0 THEN 1 / (1 + exp(-s)) ELSE exp(s) / (1 + exp(s)) END AS n FROM r),
  last AS (SELECT query_id, doc_id, arg_max(lower(trim(source_domain)), rank) AS d FROM n WHERE n >= 0.5 AND trim(source_domain) <> '' GROUP BY ALL), div AS (SELECT query_id, count(DISTINCT d) AS diversity FROM last GROUP BY ALL),
  pd AS (SELECT query_id, doc_id, max(n) AS best, max(CASE WHEN rank = 1 THEN n END) AS first FROM n GROUP BY ALL), base AS (SELECT query_id, count(CASE WHEN best >= 0.5 THEN 1 END) AS useful, max(first) AS confidence FROM pd GROUP BY ALL),
  t AS (SELECT query_id, lower(string_agg(text, chr(10) ORDER BY rank)) AS t FROM n WHERE rank <= 10 GROUP BY ALL),
  q AS (SELECT query_id, list_filter(list_transform(string_split(query, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS terms FROM query_log),
  j AS (SELECT q.query_id, useful IS NULL AS none, coalesce(confidence, 0.0) AS confidence, coalesce(useful, 0) AS useful, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda x: contains(coalesce(t, ''), lower(x)))) / CAST(len(terms) AS DOUBLE) ELSE 1.0 END AS coverage, coalesce(diversity, 0) AS diversity FROM q LEFT JOIN base USING (query_id) LEFT JOIN div USING (query_id) LEFT JOIN t USING (query_id)),
  z AS (SELECT *, CASE WHEN none THEN 1.0 ELSE 0.35 * (1 - confidence) + 0.25 * greatest(0, 3 - useful) / 3.0 + 0.25 * (1 - coverage) + 0.15 * greatest(0, 2 - diversity) / 2.0 END AS insufficiency FROM j)"""


@query(
    "n01_n03_f06_f07_sufficiency",
    f"{_SUFF} SELECT query_id, {r6('confidence')} AS confidence, useful, {r6('coverage')} AS coverage, diversity, {r6('insufficiency')} AS insufficiency, (NOT none AND confidence >= 0.5 AND useful >= 3 AND coverage >= 0.5 AND diversity >= 2 AND insufficiency < 0.45) AS sufficient FROM z",
)
def n03(spark: SparkSession, d: str) -> DataFrame:
    terms = F.filter(F.transform(F.split("query", ","), lambda x: F.trim(x)), lambda x: x != "")
    a = sufficiency.assess(_results(spark, d), table(spark, d, "query_log").select("query_id", terms.alias("terms")))
    return a.select("query_id", text.round6("confidence").alias("confidence"), "useful", text.round6("coverage").alias("coverage"), "diversity", text.round6("insufficiency").alias("insufficiency"), "sufficient")


# context -------------------------------------------------------------------------------------------------------------


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return context.build_context(c.select("query_id", (F.col("position") + 1).alias("rank"), "chunk_id", "doc_id", "text"))


@query("g13_o03_context_blocks")
def g13(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d)


@query(
    "g13_per_document_cap",
    f"WITH {CANDIDATES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY position) AS per FROM cand WHERE trim(text) <> '') SELECT query_id, chunk_id, CAST(b AS INTEGER) AS block FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS b FROM k WHERE per <= 2) WHERE b <= 10",
)
def g13_cap(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).where("trim(text) <> ''").withColumn("per", F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("position"))).where("per <= 2")
    return c.withColumn("block", F.row_number().over(W.partitionBy("query_id").orderBy("position"))).where("block <= 10").select("query_id", "chunk_id", "block")


@query("o03_prompt_context")
def o03(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "positioning_candidates").groupBy("query_id", "chunk_id").agg(F.min("source_domain").alias("source_domain"), F.min("section_heading").alias("section_heading"), F.min("url").alias("url"))
    return context.prompt_context(_blocks(spark, d).join(meta, ["query_id", "chunk_id"]))


@query("o05_o06_citations")
def o06(spark: SparkSession, d: str) -> DataFrame:
    """An extractive answer (the first sentence of each of the first three blocks, cited, and one citation of a block
    that does not exist), and what its citations refer to."""
    b = _blocks(spark, d)
    part = F.concat(F.regexp_extract("text", r"^[^.]*\.?", 0), F.lit(" [CHUNK "), F.col("block").cast("string"), F.lit("]"))
    answers = b.where("block <= 3").groupBy("query_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", part.alias("p")))), lambda x: x["p"]), " "), F.lit(" [CHUNK 99]")).alias("answer"))
    return context.citations(answers, b)


@query("h06_citation_numbers", "SELECT query_id, list_distinct(regexp_extract_all(query, '[0-9]+')) AS refs FROM query_log WHERE len(list_distinct(regexp_extract_all(query, '[0-9]+'))) < 2")
def h06(spark: SparkSession, d: str) -> DataFrame:
    refs = F.array_distinct(F.regexp_extract_all("query", F.lit("[0-9]+"), F.lit(0)))
    return table(spark, d, "query_log").select("query_id", refs.alias("refs")).where(F.size("refs") < 2)


@query("o07_differential", f"WITH {CANDIDATES_SQL} SELECT query_id, doc_id, coalesce((list_sort(list_distinct(list(url) FILTER (url IS NOT NULL))))[1:3], []) AS urls FROM cand GROUP BY query_id, doc_id")
def o07(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).groupBy("query_id", "doc_id").agg(F.slice(F.array_sort(F.collect_set("url")), 1, 3).alias("urls"))


@query("o02_composed_queries")
def o02(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda label: F.array_distinct(F.transform(F.filter("ner_entities", lambda e: e["label"] == label), lambda e: e["text"]))
    q = table(spark, d, "query_log").select("query_id", "query")
    semantic, lexical_ = context.compose("query", pick("PROBLEM"), pick("TREATMENT"), pick("TEST"))
    return table(spark, d, "search_hits").join(q, "query_id").select("hit_id", semantic.alias("semantic"), lexical_.alias("lexical"))


@query("c35_c36_chart_values")
def c35(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", context.vitals("text").alias("vitals"), context.demographics("text").alias("person"))
