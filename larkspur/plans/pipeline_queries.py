"""Queries over whole pipelines: two-stage search, feedback, enrichment, charts and prompts, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicons import CONCEPTS_ES, SYNONYMS
from ..operators import charts, concepts, enrichment, evaluation, expansion, feedback, incremental, positioning, search, vectors
from ..runtime import table
from ..sources import crawl
from .ranking_queries import CANDIDATES_SQL, _blocks, _candidates
from .registry import query
from .retrieval_queries import _COS, _ROUND, CONCEPTS_SQL, FIELDS, _index, _ordered_sql, _prf_sql, hybrid_sql
from .text_queries import fold_sql, r6, tokens_sql

# expansion in SQL ----------------------------------------------------------------------------------------------------


def _texts(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _named(q: str, term: str) -> str:
    return f"regexp_matches({q}, '(?i)(^|[^a-z0-9]){term.replace('-', '[-]')}($|[^a-z0-9])')"


def synonyms_sql(q: str) -> str:
    """The expanded text of a query: variants in the order of the table, each once, none that the query has, 12 at most."""
    parts = []
    for term, variants in SYNONYMS.items():
        parts.append(f"CASE WHEN {_named('t', term)} THEN {_texts(variants)} ELSE [] END")
        parts += [f"CASE WHEN {_named('t', v)} THEN {_texts([term, *variants])} ELSE [] END" for v in variants]
    found = "flatten([" + ", ".join(parts) + "])"
    return f"""(SELECT CASE WHEN len(k) = 0 THEN q ELSE t || ' ' || array_to_string(k, ' ') END FROM (SELECT q, t, (list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i))[1:12] AS k
      FROM (SELECT q, t, list_filter(l, lambda x: NOT contains(lower(t), lower(x))) AS f FROM (SELECT q, t, {found} AS l FROM (SELECT {q} AS q, trim({q}, ' ') AS t)))))"""


_SYN = f"syn AS (SELECT query_id, session_id, query, {synonyms_sql('query')} AS expanded FROM query_log)"


@query("k01_synonyms", f"WITH {_SYN} SELECT query_id, expanded FROM syn")
def k01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log").select("query_id", expansion.expand_synonyms("query").alias("expanded"))


# two-stage search ----------------------------------------------------------------------------------------------------


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log").select(F.col("query_id").alias("query"), F.col("query").alias("text"))


_SHARE = f"len(list_intersect(list_distinct({tokens_sql('q.query')}), list_distinct({tokens_sql('t.text')}))) / CAST(greatest(len(list_distinct({tokens_sql('q.query')})), 1) AS DOUBLE)"


@query(
    "j12_two_stage",
    f"""WITH {_SYN}, asked AS (SELECT query_id, expanded AS query FROM syn), {hybrid_sql('asked')}, found AS ({_ordered_sql('SELECT * FROM fused', 100)}),
    pairs AS (SELECT f.query, f.item, f.rank AS original_rank, {r6(_SHARE)} AS score FROM found f JOIN query_log q ON q.query_id = f.query LEFT JOIN (SELECT doc_id, coalesce(title, '') || ' ' || coalesce(text, '') AS text FROM documents) t ON t.doc_id = f.item)
    SELECT query, item, original_rank, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, original_rank) AS rank FROM pairs) WHERE rank <= 10""",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved by the query with its synonyms, reranked by the query as it was asked."""
    docs = table(spark, d, "documents")
    asked = _queries(spark, d)
    expanded = asked.select("query", expansion.expand_synonyms("text").alias("text"))
    titles = docs.select(F.col("doc_id").alias("doc"), F.col("title").alias("text"))
    texts = docs.select(F.col("doc_id").alias("item"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    return search.two_stage(_index(spark, d), asked, expanded, titles, texts, FIELDS)


@query(
    "j03_match_all",
    f"""WITH dc AS (SELECT DISTINCT doc_id AS doc, c FROM (SELECT doc_id, unnest({CONCEPTS_SQL.format('text')}) AS c FROM documents)), qc AS (SELECT query_id AS query, {CONCEPTS_SQL.format('query')} AS l FROM query_log),
    both_ AS (SELECT DISTINCT query, doc FROM (SELECT query, unnest(l) AS c FROM qc) JOIN dc USING (c) UNION ALL SELECT query, doc_id AS doc FROM qc, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10) WHERE len(l) = 0)
    SELECT query, doc, 1.0::DOUBLE AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc) AS rank FROM both_) WHERE rank <= 10""",
)
def j03(spark: SparkSession, d: str) -> DataFrame:
    """What the queries would get if only their concepts were sent and no words."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), concepts.extract("text").alias("concepts"))
    qs = table(spark, d, "query_log").select(F.col("query_id").alias("query"), F.lit("").alias("text"), concepts.extract("query").alias("concepts"))
    return search.match_all(docs, qs)


@query(
    "j07_knn_filtered_first",
    f"""WITH pairs AS (SELECT CAST(q.vec_id AS VARCHAR) AS query, CAST(v.vec_id AS VARCHAR) AS item, {r6(_COS)} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 AND v.label < 4)
    SELECT query, item, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM pairs) WHERE rank <= 10""",
)
def j07(spark: SparkSession, d: str) -> DataFrame:
    """Filters come before the search, so that k neighbours are found whatever they leave."""
    v = table(spark, d, "embeddings")
    kept = v.where(search.request(v, {"label": F.col("label") < 4})).select(F.col("vec_id").alias("id"), "embedding")
    return vectors.top_similar(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "embedding"), kept, 10)


@query(
    "i20_query_vectors",
    f"""WITH e AS (SELECT query_id, d, sum(s) AS v FROM (SELECT query_id, (instr('0123456789abcdef', substr(h, 1, 1)) * 16 - 16 + instr('0123456789abcdef', substr(h, 2, 1)) - 1) % 64 AS d, CASE WHEN substr(h, 3, 1) < '8' THEN 1 ELSE -1 END AS s
      FROM (SELECT query_id, md5(unnest(list_distinct({tokens_sql('query')}))) AS h FROM query_log)) GROUP BY ALL), n AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM e GROUP BY query_id HAVING sum(v * v) > 0)
    SELECT query_id, CAST(d AS INTEGER) AS place, {r6('v / n')} AS value FROM e JOIN n USING (query_id) WHERE v <> 0""",
)
def i20(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "query_log").select("query_id", F.posexplode(search.embed("query")).alias("place", "value"))
    return e.where("value <> 0").select("query_id", "place", text.round6("value").alias("value"))


# feedback ------------------------------------------------------------------------------------------------------------


@query(
    "k04_vote_fields",
    "SELECT hit_id, CASE WHEN coalesce(trim(session_id, ' '), '') = '' THEN 'session_id' WHEN coalesce(trim(query, ' '), '') = '' THEN 'query' WHEN coalesce(trim(chunk_id, ' '), '') = '' THEN 'chunk_id' WHEN coalesce(trim(doc_id, ' '), '') = '' THEN 'doc_id' END AS missing FROM search_hits JOIN query_log USING (query_id)",
)
def k04(spark: SparkSession, d: str) -> DataFrame:
    """Every hit as a vote of its session: which of them could not be stored, and why."""
    votes = table(spark, d, "search_hits").select("hit_id", "query_id", "chunk_id", "doc_id").join(table(spark, d, "query_log").select("query_id", "session_id", "query"), "query_id")
    good, bad = feedback.split_valid(votes)
    return good.select("hit_id", F.lit(None).cast("string").alias("missing")).unionByName(bad.select("hit_id", "missing"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes from the reranker's sign: what it scores above zero counts as liked, what it scores below as not."""
    return _candidates(spark, d).where("cross_encoder_score is not null").select(F.col("query_id").alias("query"), F.col("chunk_id").alias("chunk"), (F.col("cross_encoder_score") > 0).alias("relevant"), "position")


_LIKED = """liked AS (SELECT query_id, position, text FROM cand WHERE cross_encoder_score > 0),
  each AS (SELECT query_id, position, t[p] AS term, p FROM (SELECT query_id, position, t, unnest(range(1, len(t) + 1)) AS p FROM (SELECT query_id, position, regexp_extract_all(lower(text), '[a-z]{4,}') AS t FROM liked))),
  counted AS (SELECT e.query_id, term, count(*) AS n, min(position * 1000000 + p) AS first FROM each e JOIN query_log q USING (query_id) WHERE term NOT IN ('and', 'or', 'the', 'of', 'in', 'to', 'for', 'with', 'patient', 'patients', 'disease', 'symptoms') AND NOT list_contains(regexp_split_to_array(lower(q.query), '\\s+'), term) GROUP BY e.query_id, term),
  best AS (SELECT query_id, string_agg(term, ' ' ORDER BY r) AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS r FROM counted) WHERE r <= 10 GROUP BY query_id)"""


@query("k03_relevance_feedback", f"WITH {CANDIDATES_SQL}, {_LIKED} SELECT q.query_id AS query, CASE WHEN t IS NULL THEN q.query ELSE trim(q.query, ' ') || ' ' || t END AS expanded FROM query_log q LEFT JOIN best USING (query_id)")
def k03(spark: SparkSession, d: str) -> DataFrame:
    chunks = _candidates(spark, d).select(F.col("query_id").alias("query"), F.col("chunk_id").alias("chunk"), "text")
    liked = _votes(spark, d).where("relevant").join(chunks, ["query", "chunk"]).select("query", "position", "text")
    qs = _queries(spark, d)
    return expansion.expand_by_terms(qs, expansion.frequent_terms(liked, qs, 10, expansion.FEEDBACK_STOPWORDS))


@query(
    "k05_refined",
    f"""WITH {CANDIDATES_SQL}, {_LIKED}, refined AS (SELECT q.query_id, CASE WHEN t IS NULL THEN q.query ELSE trim(q.query, ' ') || ' ' || t END AS query FROM query_log q LEFT JOIN best USING (query_id)),
    pool AS (SELECT * FROM cand WHERE coalesce(cross_encoder_score, 1) > 0),
    s AS (SELECT p.query_id AS query, p.chunk_id AS item, p.position + 1 AS original_rank, {r6(_SHARE.replace('t.text', 'p.text'))} AS score FROM pool p JOIN refined q USING (query_id))
    SELECT query, item, original_rank, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, original_rank) AS rank FROM s) WHERE rank <= 10""",
)
def k05(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without those voted down, reranked by the query that the liked ones refine."""
    c = _candidates(spark, d).select(F.col("query_id").alias("query"), F.col("chunk_id").alias("item"), (F.col("position") + 1).cast("long").alias("rank"), "text")
    left = c.join(feedback.excluded(_votes(spark, d)), ["query", "item"], "left_anti")
    refined = k03(spark, d).select("query", F.col("expanded").alias("text"))
    q = refined.select("query", F.array_distinct(text.tokens("text")).alias("_q"))
    s = left.join(q, "query").select("query", "item", F.col("rank").alias("original_rank"), text.round6(F.size(F.array_intersect("_q", F.array_distinct(text.tokens("text")))) / F.greatest(F.size("_q"), F.lit(1)).cast("double")).alias("score"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "original_rank"))).where("rank <= 10")


@query(
    "k06_b11_expansion_log",
    f"""WITH {_SYN}, {_prf_sql(5, 8)}, prf AS (SELECT q.query_id, q.query, q.session_id, trim(q.query, ' ') || ' ' || t AS expanded FROM query_log q JOIN (SELECT query_id, string_agg(term, ' ' ORDER BY r) AS t FROM best GROUP BY query_id) b USING (query_id))
    SELECT session_id, query_id AS query, query AS original, expanded, strategy FROM (SELECT session_id, query_id, query, expanded, 'synonym' AS strategy FROM syn UNION ALL SELECT session_id, query_id, query, expanded, 'pseudo_relevance' FROM prf) WHERE expanded <> query""",
)
def k06(spark: SparkSession, d: str) -> DataFrame:
    qs = _queries(spark, d)
    ranked = _candidates(spark, d).select(F.col("query_id").alias("query"), (F.col("position") + 1).alias("rank"), "text")
    steps = {"synonym": qs.withColumn("expanded", expansion.expand_synonyms("text")), "pseudo_relevance": qs.join(expansion.pseudo_relevance(ranked, qs), "query")}
    return feedback.expansion_log(steps, table(spark, d, "query_log").select(F.col("query_id").alias("query"), "session_id"))


# scalar functions and predicates ---------------------------------------------------------------------------------------


@query("c14_dates", "SELECT arrival_seq, strftime(coalesce(try_strptime(regexp_extract(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}'), '%Y-%m-%dT%H:%M:%S')), '%Y-%m-%dT%H:%M:%S') AS date FROM (SELECT arrival_seq, 'updated ' || coalesce(page_meta.updated_at, page_meta.published_at) AS s FROM acquired)")
def c14(spark: SparkSession, d: str) -> DataFrame:
    """Dates found inside other words."""
    s = F.concat(F.lit("updated "), F.coalesce("page_meta.updated_at", "page_meta.published_at"))
    return table(spark, d, "acquired").select("arrival_seq", text.normalize_date(s).alias("date"))


_NATIVE = list(enrichment.LABELS)


@query("c41_labels", "SELECT hit_id, CASE " + " ".join(f"WHEN hit_id % {len(_NATIVE) + 1} = {i} THEN '{enrichment.LABELS[n]}'" for i, n in enumerate(_NATIVE)) + " END AS label FROM search_hits")
def c41(spark: SparkSession, d: str) -> DataFrame:
    """A tagger's labels, dealt out over the hits, under our names; one of them is unknown."""
    native = F.get(text.literal_array([*_NATIVE, "Duration"]), (F.col("hit_id") % (len(_NATIVE) + 1)).cast("int"))
    return table(spark, d, "search_hits").select("hit_id", enrichment.own_label(native).alias("label"))


@query(
    "c43_explanations",
    """SELECT query_id, chunk_id, CASE WHEN len(l) = 0 THEN ['Informative result retrieved to support the differential analysis.'] ELSE l END AS says FROM (SELECT query_id, chunk_id, list_filter([
      CASE WHEN cross_encoder_score >= 0.7 THEN 'High semantic relevance between the query and the retrieved evidence.' WHEN cross_encoder_score >= 0.45 THEN 'Moderate semantic relevance to the user''s query.' END,
      CASE WHEN len(concept_ids) > 0 THEN 'Matches symptoms or concepts from the query: ' || array_to_string(concept_ids[1:4], ', ') || '.' END,
      CASE WHEN hybrid_score >= 0.85 AND source_domain IS NOT NULL THEN 'Includes evidence from trusted clinical sources: ' || source_domain || '.' END,
      CASE WHEN chunk_index >= 3 THEN 'Has several retrieved evidence chunks associated with this clinical condition.' END,
      CASE WHEN coalesce(vector_score, 0) <> 0 THEN 'Selected by balancing relevance and diversity against other results.' END], lambda x: x IS NOT NULL) AS l FROM positioning_candidates)""",
)
def c43(spark: SparkSession, d: str) -> DataFrame:
    """Explanations of rows whose columns stand for a group's scores."""
    c = table(spark, d, "positioning_candidates").select(
        "query_id", "chunk_id", F.col("cross_encoder_score").alias("cross_encoder"), F.col("hybrid_score").alias("authority"), F.col("concept_ids").alias("matched"),
        F.array_compact(F.array("source_domain")).alias("sources"), F.col("chunk_index").alias("evidences"), F.col("vector_score").alias("mmr"),
    )
    return c.select("query_id", "chunk_id", positioning.explanation().alias("says"))


@query(
    "i06_concepts_es",
    "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches({fold_sql('text')}, '{text.phrase_pattern(v)}') THEN '{k}' END".replace("\\ ", " ") for k, v in sorted(CONCEPTS_ES.items())) + "], lambda x: x IS NOT NULL) AS concepts FROM documents WHERE text IS NOT NULL",
)
def i06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", concepts.extract(text.fold("text"), CONCEPTS_ES).alias("concepts"))


# enrichment ----------------------------------------------------------------------------------------------------------


@query(
    "n04_asked_terms",
    f"""WITH e AS (SELECT hit_id, u.start_char AS a, i, regexp_replace(trim(u.text, ' '), '\\s+', ' ', 'g') AS w FROM (SELECT hit_id, ner_entities[i] AS u, i FROM (SELECT hit_id, ner_entities, unnest(range(1, len(ner_entities) + 1)) AS i FROM search_hits))
      WHERE u.label IN ('PROBLEM', 'SYMPTOM', 'DISEASE', 'ANATOMY', 'TEST', 'TREATMENT') AND u.score >= 0.45 AND length(regexp_replace(trim(u.text, ' '), '\\s+', ' ', 'g')) >= 3 AND NOT starts_with(trim(u.text, ' '), '##')),
    f AS (SELECT *, row_number() OVER (PARTITION BY hit_id, lower(w) ORDER BY a, i) AS r FROM e), g AS (SELECT hit_id, list(w ORDER BY a, i) AS l FROM f WHERE r = 1 GROUP BY hit_id)
    SELECT h.hit_id, CASE WHEN l IS NOT NULL THEN l WHEN len({CONCEPTS_SQL.format('q.query')}) > 0 THEN {CONCEPTS_SQL.format('q.query')} ELSE list_filter(list_transform(regexp_split_to_array(q.query, '(?i),\\s*|\\s+and\\s+'), lambda x: trim(x, ' ')), lambda x: x <> '') END AS terms
    FROM search_hits h JOIN query_log q USING (query_id) LEFT JOIN g USING (hit_id)""",
)
def n04(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").select("hit_id", "query_id", "ner_entities").join(table(spark, d, "query_log").select("query_id", "query"), "query_id")
    return h.select("hit_id", enrichment.asked_terms("query", "ner_entities").alias("terms"))


def _external(spark: SparkSession, d: str) -> DataFrame:
    """Acquired pages in the form of what a service returns."""
    return table(spark, d, "acquired").select(
        "arrival_seq", F.substring(F.sha1("url"), 1, 8).alias("query_hash"), F.lit("medlineplus").alias("source"), "url", F.col("content.title").alias("title"), F.lit(None).cast("string").alias("abstract"),
        F.transform("content.sections", lambda s: F.struct(s["heading"].alias("heading"), s["text"].alias("text"))).alias("sections"), F.array_compact(F.array("page_meta.author")).alias("authors"), F.col("page_meta.language").alias("language"),
    )


_REAL = "len(list_filter(content.sections, lambda s: s.heading NOT IN ('Publication metadata', 'MeSH terms', 'Journal') AND trim(s.text, ' ') <> '')) > 0"


@query("d13_real_content", f"SELECT arrival_seq, coalesce({_REAL}, false) AS real FROM acquired")
def d13(spark: SparkSession, d: str) -> DataFrame:
    return _external(spark, d).select("arrival_seq", enrichment.has_content("sections", "abstract").alias("real"))


@query(
    "n06_as_acquired",
    f"SELECT substr(sha1(url), 1, 16) AS doc_id, url, 'api_medlineplus' AS seed_group, substr(sha1(url), 1, 8) AS seed_id, page_meta.author AS author, coalesce(page_meta.language, 'en') AS language, len(list_filter(content.sections, lambda s: trim(s.text, ' ') <> '')) AS n_sections FROM acquired WHERE {_REAL}",
)
def n06(spark: SparkSession, d: str) -> DataFrame:
    a = enrichment.to_acquired(_external(spark, d), F.lit("2024-06-01T00:00:00Z"))
    return a.select("doc_id", "url", F.col("crawl.seed_group").alias("seed_group"), F.col("crawl.seed_id").alias("seed_id"), F.col("page_meta.author").alias("author"), F.col("page_meta.language").alias("language"), F.size("content.sections").cast("long").alias("n_sections"))


@query("f21_dedup_counts", "SELECT crawl.seed_group AS seed_group, count(*) AS retrieved, count(*) - count(DISTINCT url) AS removed, count(DISTINCT url) AS new_documents FROM acquired GROUP BY 1")
def f21(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "acquired").select("arrival_seq", "url", F.col("crawl.seed_group").alias("seed_group"))
    return enrichment.dedup_counts(a, a.dropDuplicates(["seed_group", "url"]), "seed_group")


@query(
    "n07_routed",
    """WITH c AS (SELECT query_id, count(*) AS n FROM positioning_candidates WHERE cross_encoder_score > 0 GROUP BY query_id)
    SELECT q.query_id, coalesce(n, 0) >= 3 AS local, CASE WHEN coalesce(n, 0) >= 3 THEN NULL ELSE substr(sha1(q.query), 1, 8) END AS seed FROM query_log q LEFT JOIN c USING (query_id)""",
)
def n07(spark: SparkSession, d: str) -> DataFrame:
    """Which queries are answered from the corpus, and under which seed the others would be asked outside."""
    n = table(spark, d, "positioning_candidates").where("cross_encoder_score > 0").groupBy("query_id").agg(F.count("*").alias("n"))
    judged = table(spark, d, "query_log").select("query_id", "query").join(n, "query_id", "left").withColumn("sufficient", F.coalesce("n", F.lit(0)) >= 3)
    good, rest = enrichment.route(judged)
    seed = F.substring(F.sha1("query"), 1, 8)
    return good.select("query_id", F.lit(True).alias("local"), F.lit(None).cast("string").alias("seed")).unionByName(rest.select("query_id", F.lit(False).alias("local"), seed.alias("seed")))


_ALIASES = [(v.lower(), k) for k, vs in SYNONYMS.items() for v in vs]


@query("l04_canonical_names", "WITH t(alias, preferred) AS (VALUES " + ", ".join(f"('{a}', '{p}')" for a, p in _ALIASES) + "), k AS (SELECT alias, min(preferred) AS p FROM t GROUP BY alias) SELECT query_id, n AS name, coalesce(p, n) AS canonical FROM (SELECT query_id, trim(unnest(string_split(query, ',')), ' ') AS n FROM query_log) LEFT JOIN k ON alias = lower(n)")
def l04(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "query_log").select("query_id", F.explode(F.split("query", ",")).alias("name")).withColumn("name", F.trim("name"))
    return enrichment.canonical_name(names, spark.createDataFrame(_ALIASES, "alias string, preferred string"))


@query(
    "l05_card_titles",
    "SELECT hit_id, coalesce(nullif(trim(a.title, ' '), ''), nullif(trim(h.title, ' '), ''), nullif(trim(section_heading, ' '), ''), lower(regexp_extract(h.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))) AS title FROM search_hits h LEFT JOIN (SELECT doc_id, min(content.title) AS title FROM acquired GROUP BY doc_id) a USING (doc_id)",
)
def l05(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.urls import domain

    a = table(spark, d, "acquired").groupBy("doc_id").agg(F.min("content.title").alias("dt"))
    h = table(spark, d, "search_hits").select("hit_id", "doc_id", "title", "section_heading", "url").join(a, "doc_id", "left")
    return h.select("hit_id", enrichment.card_title("dt", "title", "section_heading", F.lit(None).cast("string"), domain("url")).alias("title"))


# crawling and runs ---------------------------------------------------------------------------------------------------


@query("q02_fetch_times", "SELECT url, TIMESTAMP '2024-01-01 00:00:00' + to_seconds((row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) ORDER BY depth, url) - 1) * 2) AS not_before FROM (SELECT url, min(crawl.depth) AS depth FROM acquired GROUP BY url)")
def q02(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "acquired").groupBy("url").agg(F.min("crawl.depth").alias("depth"))
    return crawl.fetch_times(f, 2).select("url", F.col("not_before").cast("timestamp_ntz").alias("not_before"))


@query("f20_crawl_counters", "SELECT crawl.seed_group AS seed_group, count(*) AS fetched, count(CASE WHEN content.mime_type <> 'text/html' THEN 1 END) AS failed, count(CASE WHEN content.mime_type = 'text/html' AND batch_id = 0 THEN 1 END) AS kept FROM acquired GROUP BY 1")
def f20(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a crawl that took HTML only and had its limit after the first batch."""
    a = table(spark, d, "acquired").select(F.col("crawl.seed_group").alias("seed_group"), F.when(F.col("content.mime_type") == "text/html", 200).otherwise(0).alias("status"), "batch_id")
    return crawl.counters(a, a.where("status = 200 and batch_id = 0"))


@query("b13_bad_rows", "SELECT arrival_seq, CASE WHEN content.title IS NULL OR trim(content.title, ' ') = '' THEN 'no title' WHEN content_hash IS NULL THEN 'no hash' END AS problem FROM acquired WHERE content.title IS NULL OR trim(content.title, ' ') = '' OR content_hash IS NULL")
def b13(spark: SparkSession, d: str) -> DataFrame:
    problem = F.expr("case when coalesce(trim(content.title), '') = '' then 'no title' when content_hash is null then 'no hash' end")
    return table(spark, d, "acquired").select("arrival_seq", problem.alias("problem")).where("problem is not null")


@query("b14_table_sizes", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("documents", "search_hits", "embeddings")))
def b14(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.runs import index_sizes

    return index_sizes(spark, {t: f"{d}/{t}.parquet" for t in ("documents", "search_hits", "embeddings")}).select("name", "rows")


@query("i18_chunks_without_manifest", "SELECT arrival_seq, doc_id, sha256(content.body) AS content_hash FROM acquired WHERE content.body IS NOT NULL AND batch_id > 0")
def i18(spark: SparkSession, d: str) -> DataFrame:
    """What a run that asks no manifest takes in: every new page."""
    return table(spark, d, "acquired").where("content.body is not null and batch_id > 0").select("arrival_seq", "doc_id", F.sha2("content.body", 256).alias("content_hash"))


_MODES = ["lexical_score", "vector_score", "hybrid_score", "cross_encoder_score"]


@query(
    "p11_modes",
    "WITH hit AS (SELECT query_id, chunk_id, max(CASE WHEN len(concept_ids) > 0 THEN 1 ELSE 0 END) AS h, "
    + ", ".join(f"max({m}) AS {m}" for m in _MODES)
    + " FROM positioning_candidates GROUP BY ALL), ranked AS ("
    + " UNION ALL ".join(f"SELECT '{m[:-6]}' AS mode, query_id, h, row_number() OVER (PARTITION BY query_id ORDER BY {m} DESC, chunk_id) AS rank FROM hit WHERE {m} IS NOT NULL" for m in _MODES)
    + "), q AS (SELECT DISTINCT query_id FROM hit), m AS (SELECT unnest(['lexical', 'vector', 'hybrid', 'cross_encoder']) AS mode), per AS (SELECT m.mode, q.query_id, coalesce(sum(CASE WHEN rank <= 10 THEN h END), 0) / 10.0 AS p, coalesce(1.0 / min(CASE WHEN h = 1 THEN rank END), 0.0) AS rr FROM q CROSS JOIN m LEFT JOIN ranked r ON r.mode = m.mode AND r.query_id = q.query_id GROUP BY ALL)"
    + f" SELECT mode, count(*) AS queries, {r6('sum(p) / count(*)')} AS precision, {r6('sum(rr) / count(*)')} AS reciprocal_rank FROM per GROUP BY mode",
)
def p11(spark: SparkSession, d: str) -> DataFrame:
    """Several modes of ranking over the same queries, each evaluated by itself; a query without results in a mode scores 0."""
    c = table(spark, d, "positioning_candidates").groupBy("query_id", "chunk_id").agg(F.max(F.coalesce(F.size("concept_ids"), F.lit(0)) > 0).alias("hit"), *[F.max(m).alias(m) for m in _MODES])
    ranked = None
    for m in _MODES:
        part = c.where(F.col(m).isNotNull()).select(F.struct(F.lit(m[:-6]).alias("mode"), "query_id").alias("query"), F.row_number().over(W.partitionBy("query_id").orderBy(F.col(m).desc(), "chunk_id")).alias("rank"), "hit")
        ranked = part if ranked is None else ranked.unionByName(part)
    asked = c.select("query_id").distinct().select(F.explode(text.literal_array([m[:-6] for m in _MODES])).alias("mode"), "query_id").select(F.struct("mode", "query_id").alias("query"), F.lit(1).alias("n_relevant"))
    return evaluation.by_mode(ranked, asked, 10).select("mode", "queries", text.round6("precision").alias("precision"), text.round6("reciprocal_rank").alias("reciprocal_rank"))


@query(
    "p13_answers",
    f"WITH {CANDIDATES_SQL}, a AS (SELECT query_id, string_agg(text, ' ' ORDER BY position) AS answer FROM cand WHERE position < 3 AND text IS NOT NULL GROUP BY query_id), n AS (SELECT DISTINCT query_id, trim({fold_sql('u.text')}, ' ') AS name FROM (SELECT query_id, unnest(ner_entities) AS u FROM search_hits) WHERE u.label = 'PROBLEM' AND trim(u.text, ' ') <> '') SELECT query_id, bool_or(contains({fold_sql('answer')}, name)) AS names_it FROM a JOIN n USING (query_id) GROUP BY query_id",
)
def p13(spark: SparkSession, d: str) -> DataFrame:
    """Whether the answer to a query (its three best texts) names any condition that its hits are about."""
    best = _candidates(spark, d).where("position < 3 and text is not null")
    answers = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("answer"))
    names = table(spark, d, "search_hits").select("query_id", F.inline("ner_entities")).where("label = 'PROBLEM' and trim(text) <> ''").select("query_id", F.trim(text.fold("text")).alias("name")).distinct()
    return evaluation.answer_hits(answers, names.groupBy("query_id").agg(F.collect_list("name").alias("names")))


# charts and prompts --------------------------------------------------------------------------------------------------


def _charts(spark: SparkSession, d: str) -> DataFrame:
    """Queries written up as charts."""
    q = table(spark, d, "query_log").select("query_id", F.regexp_replace("query", r"[\r\n]", " ").alias("query"))
    chart = F.concat(F.lit("CC: "), F.trim("query"), F.lit(" now\nHPI: 58yo M, since monday\nVitals: T 38.5, HR 90, BP 120/80\nMedications: metformin, insulin\nAllergies: NKDA\nPMH: asthma; gout\n## End"))
    return q.select("query_id", chart.alias("text"))


@query(
    "o08_c35_c38_charts",
    "SELECT query_id, trim(regexp_replace(query, '[\\r\\n]', ' ', 'g'), ' ') || ' now' AS complaint, ['metformin', 'insulin'] AS medications, 0 AS allergies, ['asthma', 'gout'] AS comorbidities, 58 AS age, 'male' AS sex, 38.5::DOUBLE AS temperature, 120.0::DOUBLE AS systolic FROM query_log",
)
def o08(spark: SparkSession, d: str) -> DataFrame:
    c = charts.parse(_charts(spark, d))
    return c.select("query_id", "chart.chief_complaint", "chart.medications", F.size("chart.allergies").alias("allergies"), F.col("chart.person.comorbidities").alias("comorbidities"), F.col("chart.person.age").alias("age"), F.col("chart.person.sex").alias("sex"), F.col("chart.vitals.temperature").alias("temperature"), F.col("chart.vitals.systolic").alias("systolic")).withColumnRenamed("chief_complaint", "complaint")


@query("o01_o04_prompts")
def o04(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for each query: its chart, entities of its hits, conditions and context."""
    from ..operators import context, diseases
    from .ranking_queries import _ranked_hits

    c = charts.parse(_charts(spark, d)).select("query_id", "chart")
    ner = table(spark, d, "search_hits").withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("hit_id"))).where("_r = 1").select("query_id", "ner_entities")
    ranked = diseases.aggregate(_ranked_hits(spark, d), most=5).groupBy(F.col("query").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("display").alias("name"), "evidence"))).alias("diseases"))
    meta = table(spark, d, "positioning_candidates").groupBy("query_id", "chunk_id").agg(F.min("source_domain").alias("source_domain"), F.min("section_heading").alias("section_heading"), F.min("url").alias("url"))
    evidence = context.prompt_context(_blocks(spark, d).join(meta, ["query_id", "chunk_id"]))
    q = table(spark, d, "query_log").select("query_id", "query")
    j = q.join(c, "query_id").join(ner, "query_id", "left").join(ranked, "query_id", "left").join(evidence, "query_id", "left")
    j = j.withColumn("found", charts.entities(F.coalesce("ner_entities", F.array().cast("array<struct<text:string,label:string,start_char:int,end_char:int,score:double>>"))))
    return j.select("query_id", charts.prompt(charts.serialise(), "found", "diseases", "context", "query").alias("prompt"))


@query("o05_answers")
def o05(spark: SparkSession, d: str) -> DataFrame:
    return charts.answer(_blocks(spark, d))
