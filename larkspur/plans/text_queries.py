"""Queries over scans, scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text, urls
from ..functions.lexicons import CONCEPTS_EN, STOPWORDS_EN, STOPWORDS_ES
from ..operators import concepts
from ..runtime import spread, table
from .registry import query


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


FOLD = "translate(lower({0}), '" + text.ACCENTED + "', '" + text.PLAIN + "')"


def fold_sql(x: str) -> str:
    return FOLD.format(x)


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({fold_sql(x)}, '[a-z0-9]+')"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000 + 0.5) / 1000000.0)"


# scans ---------------------------------------------------------------------------------------------------------------


@query("a06_index_scan", "SELECT chunk_id, doc_id, length(text) AS n_chars FROM positioning_candidates WHERE source_domain IS NOT NULL AND NOT starts_with(source_domain, 'www.') AND embedding IS NULL")
def a06(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "positioning_candidates")
    return c.where(F.col("source_domain").isNotNull() & ~F.col("source_domain").startswith("www.") & F.col("embedding").isNull()).select("chunk_id", "doc_id", F.length("text").cast("long").alias("n_chars"))


@query("a07_chunk_hashes", "SELECT DISTINCT chunk_id, sha256(text) AS chunk_hash FROM positioning_candidates")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "positioning_candidates").select("chunk_id", F.sha2("text", 256).alias("chunk_hash")).distinct()


@query("a08_filtered_count", "SELECT count(*) AS n FROM documents WHERE lang = 'es' AND n_chars >= 500")
def a08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'es' and n_chars >= 500").agg(F.count("*").alias("n"))


@query("a09_point_get", "SELECT doc_id, title, source FROM documents WHERE doc_id = 7")
def a09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id = 7").select("doc_id", "title", "source").limit(1)


@query("a10_multi_get", "SELECT DISTINCT p.chunk_id, p.doc_id, p.section_index, p.chunk_index FROM positioning_candidates p WHERE p.chunk_id IN (SELECT chunk_id FROM search_hits WHERE chunk_id IS NOT NULL)")
def a10(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "search_hits").where("chunk_id is not null").select("chunk_id").distinct()
    return table(spark, d, "positioning_candidates").select("chunk_id", "doc_id", "section_index", "chunk_index").join(ids, "chunk_id", "left_semi").distinct()


@query("a19_seed_frontier", "SELECT DISTINCT crawl.seed_id AS seed_id, crawl.seed_group AS seed_group, CAST(0 AS INTEGER) AS depth, min(url) OVER (PARTITION BY crawl.seed_id, crawl.seed_group) AS url FROM acquired")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "acquired").groupBy(F.col("crawl.seed_id").alias("seed_id"), F.col("crawl.seed_group").alias("seed_group")).agg(F.min("url").alias("url")).select("seed_id", "seed_group", F.lit(0).alias("depth"), "url")


@query(
    "a01_required_fields",
    """SELECT arrival_seq, (doc_id IS NOT NULL AND trim(doc_id) <> '' AND url IS NOT NULL AND trim(url) <> '' AND content.body IS NOT NULL
       AND coalesce(len(list_filter(content.sections, lambda s: s.heading IS NULL OR trim(s.heading) = '' OR s.text IS NULL OR trim(s.text) = '')), 0) = 0) AS valid,
       nullif(trim(content.title), '') AS title, nullif(trim(page_meta.author), '') AS author FROM acquired""",
)
def a01(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "acquired")
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    bad = F.size(F.filter("content.sections", lambda s: blank(s["heading"]) | blank(s["text"])))
    valid = ~blank(F.col("doc_id")) & ~blank(F.col("url")) & F.col("content.body").isNotNull() & (F.greatest(bad, F.lit(0)) == 0)
    opt = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return a.select("arrival_seq", valid.alias("valid"), opt(F.col("content.title")).alias("title"), opt(F.col("page_meta.author")).alias("author"))


# scalar functions ----------------------------------------------------------------------------------------------------


@query(
    "c01_clean_markup",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '(?i)<\s*(?:br|/p|/div|/li|/ul|/ol|/h[1-6]|p|div|li|ul|ol|h[1-6])\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned
        FROM documents""",
)
def c01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_markup("text").alias("cleaned"))


@query(
    "c02_clean_sections",
    """SELECT arrival_seq, list_transform(list_filter(content.sections, lambda s: s.text IS NOT NULL AND trim(s.text, ' ') <> ''), lambda s: coalesce(nullif(trim(s.heading, ' '), ''), 'main') || ': ' || trim(s.text, ' ')) AS sections FROM acquired""",
)
def c02(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter("content.sections", lambda s: s["text"].isNotNull() & (F.trim(s["text"]) != ""))
    head = lambda s: F.when(F.trim(s["heading"]) != "", F.trim(s["heading"])).otherwise("main")
    return table(spark, d, "acquired").select("arrival_seq", F.transform(kept, lambda s: F.concat(head(s), F.lit(": "), F.trim(s["text"]))).alias("sections"))


@query(
    "c03_body_from_sections",
    """SELECT arrival_seq, array_to_string(list_transform(list_filter(content.sections, lambda s: s.text IS NOT NULL), lambda s: CASE WHEN s.heading IS NULL OR s.heading = 'main' THEN s.text ELSE s.heading || chr(10) || s.text END), chr(10)) AS body FROM acquired""",
)
def c03(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.filter("content.sections", lambda s: s["text"].isNotNull()), lambda s: F.when(s["heading"].isNull() | (s["heading"] == "main"), s["text"]).otherwise(F.concat(s["heading"], F.lit("\n"), s["text"])))
    return table(spark, d, "acquired").select("arrival_seq", F.array_join(parts, "\n").alias("body"))


@query("c04_normalized_urls")
def c04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("url").distinct().select("url", urls.normalize_url("url").alias("normalized"))


@query("c05_domains", "SELECT hit_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain FROM search_hits")
def c05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", urls.domain("url").alias("domain"))


SOURCE_SQL = """regexp_replace(regexp_replace(trim(CASE WHEN contains(lower(trim(coalesce({0}, ''))), '://') THEN regexp_extract(lower(trim(coalesce({0}, ''))), '://([^/?#]*)', 1) ELSE lower(trim(coalesce({0}, ''))) END), '^/+|/+$', '', 'g'), '^www\\.', '')"""


@query("c07_sources", "SELECT hit_id, " + SOURCE_SQL.format("coalesce(source_domain, url)") + " AS source FROM search_hits")
def c07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", urls.source_of(F.coalesce("source_domain", "url")).alias("source"))


@query("c08_c10_url_and_query_hashes", "SELECT h.hit_id, substr(sha1(h.url), 1, 16) AS doc_key, substr(sha1(q.query), 1, 8) AS query_hash FROM search_hits h JOIN query_log q ON h.query_id = q.query_id")
def c08(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_log").select("query_id", F.substring(F.sha1("query"), 1, 8).alias("query_hash"))
    return table(spark, d, "search_hits").select("hit_id", "query_id", urls.url_hash("url").alias("doc_key")).join(q, "query_id").drop("query_id")


@query("c09_content_hash", "SELECT arrival_seq, sha256(content.body) AS content_hash, sha256(content.body) = lower(content_hash) AS same FROM acquired")
def c09(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2("content.body", 256)
    return table(spark, d, "acquired").select("arrival_seq", h.alias("_h"), (h == F.lower("content_hash")).alias("same")).withColumnRenamed("_h", "content_hash")


@query("c11_c12_ids", "SELECT query_id, chunk_id, 'emb_' || chunk_id || '_' || substr(sha256(chunk_id || ':hash-64:1'), 1, 8) AS embedding_id, doc_id || ':' || section_index || ':' || chunk_index AS built_id FROM positioning_candidates")
def c11(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "positioning_candidates")
    emb = F.concat(F.lit("emb_"), "chunk_id", F.lit("_"), F.substring(F.sha2(F.concat("chunk_id", F.lit(":hash-64:1")), 256), 1, 8))
    return c.select("query_id", "chunk_id", emb.alias("embedding_id"), F.concat_ws(":", "doc_id", "section_index", "chunk_index").alias("built_id"))


@query("c13_iso_timestamps", "SELECT hit_id, strftime(logged_at, '%Y-%m-%dT%H:%M:%SZ') AS logged_iso FROM search_hits")
def c13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", F.date_format("logged_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("logged_iso"))


@query(
    "c15_ages",
    """SELECT chunk_id, query_id, CAST(greatest(0, floor((epoch(TIMESTAMP '2024-06-01 00:00:00') - epoch(strptime(coalesce(published_at, fetched_at), '%Y-%m-%dT%H:%M:%SZ'))) / 86400)) AS BIGINT) AS age_days FROM positioning_candidates""",
)
def c15(spark: SparkSession, d: str) -> DataFrame:
    t = F.try_to_timestamp(F.coalesce("published_at", "fetched_at"), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    age = F.greatest(F.lit(0), F.floor((F.lit(1717200000) - F.unix_timestamp(t)) / 86400)).cast("long")
    return table(spark, d, "positioning_candidates").select("chunk_id", "query_id", age.alias("age_days"))


@query("c16_slug_titles")
def c16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", text.title_case(urls.slug_words("url")).alias("url_title"))


@query("c17_titles")
def c17(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "acquired")
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    head = F.try_element_at(F.filter(F.transform("content.sections", lambda s: some(s["heading"])), lambda h: h.isNotNull() & ~F.lower(h).isin("main", "summary")), F.lit(1))
    return a.select("arrival_seq", F.coalesce(some(F.col("content.title")), head, text.title_case(urls.slug_words("url")), some(F.col("source_domain")), F.concat(F.lit("Document "), F.substring("doc_id", 1, 8))).alias("title"))


NORMAL_SQL = f"trim(regexp_replace({fold_sql('''regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '[\\x{2010}-\\x{2015}\\x{2212}]', '-', 'g')''')}, '\\s+', ' ', 'g'), ' ')"


@query("c19_normalized_text", f"SELECT doc_id, {NORMAL_SQL} AS normalized FROM documents")
def c19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize_text("text").alias("normalized"))


SYMPTOM_SQL = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9áéíóúñü]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("c20_c21_symptom_phrases", f"SELECT query_id, {SYMPTOM_SQL.format('query')} AS normalized, contains(' ' || {SYMPTOM_SQL.format('query')} || ' ', ' chest pain ') AS chest_pain FROM query_log")
def c20(spark: SparkSession, d: str) -> DataFrame:
    n = text.normalize_symptom("query")
    return table(spark, d, "query_log").select("query_id", n.alias("normalized"), text.contains_phrase(n, "chest pain").alias("chest_pain"))


@query("c22_c23_c24_condition_names")
def c22(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "search_hits").where("title is not null").select("title").distinct()
    return t.select("title", names.ranking_name("title").alias("ranking"), names.grouping_name("title").alias("grouping"), names.judged_name("title").alias("judged"))


@query("c24_judged_names", f"SELECT DISTINCT title, trim(regexp_replace({fold_sql('title')}, '\\s+', ' ', 'g')) AS judged FROM documents WHERE title IS NOT NULL")
def c24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("title is not null").select("title").distinct().select("title", names.judged_name("title").alias("judged"))


@query("c25_display_titles", "SELECT doc_id, trim(regexp_replace(regexp_replace(title, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS shown FROM documents")
def c25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.display_title("title").alias("shown"))


@query("c26_previews", "SELECT hit_id, CASE WHEN length(content) <= 200 THEN content ELSE regexp_replace(substring(content, 1, 200), ' [^ ]*$', '') || '...' END AS preview FROM search_hits")
def c26(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", text.preview("content").alias("preview"))


@query(
    "c28_c29_scores",
    f"""SELECT query_id, chunk_id, {r6("greatest(0.0, least(1.0, CASE WHEN cross_encoder_score BETWEEN 0 AND 1 THEN cross_encoder_score WHEN cross_encoder_score >= 0 THEN 1/(1+exp(-cross_encoder_score)) ELSE exp(cross_encoder_score)/(1+exp(cross_encoder_score)) END))")} AS score FROM positioning_candidates WHERE cross_encoder_score IS NOT NULL""",
)
def c28(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "positioning_candidates").where("cross_encoder_score is not null")
    return c.select("query_id", "chunk_id", text.round6(text.clamp(text.unit_score("cross_encoder_score"))).alias("score"))


_J = f"list_distinct({tokens_sql('q.query')})"
_K = f"list_distinct({tokens_sql('h.content')})"


@query(
    "c30_c31_token_sets",
    f"""SELECT hit_id, {r6("CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END")} AS jaccard,
        {r6("CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE) END")} AS coverage
        FROM (SELECT hit_id, {_J} AS a, {_K} AS b FROM search_hits h JOIN query_log q USING (query_id) WHERE h.content IS NOT NULL)""",
)
def c30(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_log").select("query_id", F.array_distinct(text.tokens("query")).alias("a"))
    h = table(spark, d, "search_hits").where("content is not null").select("hit_id", "query_id", F.array_distinct(text.tokens("content")).alias("b")).join(q, "query_id")
    return h.select("hit_id", text.round6(text.jaccard("a", "b")).alias("jaccard"), text.round6(text.coverage("a", "b")).alias("coverage"))


@query("c32_c33_name_matches")
def c32(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").select("item_id", F.explode("relevant_disease_names").alias("name")).select("item_id", "name", text.name_tokens("name").alias("e"))
    return e.select("item_id", "name", text.head_token("e").alias("head"), text.is_match(text.name_tokens(F.lit("early wasting disease")), "e").alias("matches"))


@query(
    "c39_api_queries",
    """SELECT query_id, array_to_string(t, ' ') AS plain, '(' || array_to_string(list_transform(t, lambda x: '"' || x || '"'), ' OR ') || ')' AS any_term, '(' || array_to_string(list_transform(t, lambda x: '"' || x || '"'), ' AND ') || ')' AS all_terms
       FROM (SELECT query_id, list_filter(list_transform(string_split(query, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS t FROM query_log)""",
)
def c39(spark: SparkSession, d: str) -> DataFrame:
    t = F.filter(F.transform(F.split("query", ","), lambda x: F.trim(x)), lambda x: x != "")
    quoted = F.transform("t", lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    join = lambda s: F.concat(F.lit("("), F.array_join(quoted, s), F.lit(")"))
    return table(spark, d, "query_log").select("query_id", t.alias("t")).select("query_id", F.array_join("t", " ").alias("plain"), join(" OR ").alias("any_term"), join(" AND ").alias("all_terms"))


@query(
    "c45_section_scores",
    """SELECT DISTINCT section_heading, CASE WHEN section_heading IS NULL OR trim(section_heading) = '' THEN 0.7 WHEN contains(lower(section_heading), 'symptoms') THEN 1.0 WHEN contains(lower(section_heading), 'overview') THEN 0.95
       WHEN contains(lower(section_heading), 'causes') THEN 0.9 WHEN contains(lower(section_heading), 'diagnosis') THEN 0.9 WHEN contains(lower(section_heading), 'treatment') THEN 0.75 WHEN contains(lower(section_heading), 'main') THEN 0.7 ELSE 0.65 END AS score
       FROM positioning_candidates""",
)
def c45(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.positioning import section_score

    return table(spark, d, "positioning_candidates").select("section_heading").distinct().select("section_heading", section_score("section_heading").cast("double").alias("score"))


# predicates ----------------------------------------------------------------------------------------------------------


@query("d01_denied_urls", "SELECT hit_id, (starts_with(lower(url), 'mailto:') OR starts_with(lower(url), 'javascript:') OR starts_with(lower(url), 'tel:') OR regexp_matches(lower(url), '/login|/signin|/signup|/search|/cookie|/privacy|/terms')) AS denied FROM search_hits")
def d01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", urls.is_denied("url").alias("denied"))


@query("d02_whitelist", "SELECT hit_id, url FROM search_hits WHERE regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '(^|\\.)(rivermed\\.org\\.example|quietclinic\\.example)$')")
def d02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").where(urls.within("url", ["rivermed.org.example", "quietclinic.example"])).select("hit_id", "url")


@query(
    "d03_persist_policy",
    """SELECT arrival_seq, CASE WHEN starts_with(mime, 'text/html') THEN wc >= 200 AND NOT az AND NOT (n > 0 AND short / n > 0.6 AND wc < 800) WHEN mime = 'application/pdf' THEN wc >= 200 ELSE false END AS persisted FROM (
         SELECT arrival_seq, content.mime_type AS mime, len(regexp_extract_all(content.body, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+')) AS wc, regexp_matches(content.body, '\\bA\\s+B\\s+C\\s+D\\s+E\\b') AS az,
           CAST(len(list_filter(string_split(content.body, chr(10)), lambda l: trim(l, ' ') <> '' AND len(regexp_extract_all(l, '[^\\s]+')) <= 3)) AS DOUBLE) AS short, len(list_filter(string_split(content.body, chr(10)), lambda l: trim(l, ' ') <> '')) AS n FROM acquired)""",
)
def d03(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.corpus import should_persist

    return table(spark, d, "acquired").select("arrival_seq", should_persist("content.mime_type", "content.body").alias("persisted"))


@query(
    "d04_kept_sections",
    """SELECT arrival_seq, i - 1 AS section_index, trim(content.sections[i].heading, ' ') AS heading FROM (SELECT arrival_seq, content, unnest(range(1, len(content.sections) + 1)) AS i FROM acquired)
       WHERE length(trim(content.sections[i].text, ' ')) >= 50 AND lower(trim(content.sections[i].heading, ' ')) NOT IN ('products & services','associated procedures','mayo clinic press','from mayo clinic to your inbox','sorry something went wrong with your subscription','thank you for subscribing!','thank you for subscribing','news from mayo clinic','related','find out more','on this page')""",
)
def d04(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.chunking import kept_sections

    return kept_sections(table(spark, d, "acquired")).select("arrival_seq", F.col("section_index").cast("long").alias("section_index"), "heading")


@query("d05_d07_vector_filters", "SELECT query_id, chunk_id FROM positioning_candidates WHERE section_heading IN ('Symptoms', 'Causes') AND NOT starts_with(doc_id, '0') AND vector_score >= 0.3")
def d05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "positioning_candidates").where("section_heading in ('Symptoms', 'Causes') and not startswith(doc_id, '0') and vector_score >= 0.3").select("query_id", "chunk_id")


@query("d06_lexical_filters", "SELECT hit_id FROM search_hits WHERE mime_type = 'text/html' AND fetched_at >= '2023-06-01T00:00:00Z' AND fetched_at <= '2023-12-31T23:59:59Z' AND list_has_any(concept_ids, ['FEVER', 'DIABETES'])")
def d06(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").where("mime_type = 'text/html' and fetched_at between '2023-06-01T00:00:00Z' and '2023-12-31T23:59:59Z'")
    return h.where(F.arrays_overlap("concept_ids", text.literal_array(["FEVER", "DIABETES"]))).select("hit_id")


@query(
    "d08_entity_filter",
    "SELECT hit_id, len(list_filter(ner_entities, lambda e: e.label IN ('PROBLEM','TREATMENT','TEST','ANATOMY') AND length(trim(e.text)) >= 3 AND len(regexp_extract_all(e.text, '[^\\s]+')) <= 6 AND e.score >= 0.5)) AS kept FROM search_hits",
)
def d08(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.entities import kept_entities

    return table(spark, d, "search_hits").select("hit_id", F.greatest(F.size(kept_entities("ner_entities")), F.lit(0)).cast("long").alias("kept"))


@query("d12_usable_candidates", "SELECT query_id, chunk_id FROM positioning_candidates WHERE text IS NOT NULL AND trim(text) <> ''")
def d12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "positioning_candidates").where("text is not null and trim(text) <> ''").select("query_id", "chunk_id")


# analysis ------------------------------------------------------------------------------------------------------------


@query("i01_token_counts", f"SELECT doc_id, len({tokens_sql('text')}) AS n_tokens, len(list_distinct({tokens_sql('text')})) AS n_distinct FROM documents WHERE text IS NOT NULL")
def i01(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


_WT = "regexp_extract_all({0}, '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*')"
_NORM_TOK = _WT.format(NORMAL_SQL)
_LANG = f"CASE WHEN len(list_filter({_NORM_TOK}[1:500], lambda t: t IN ({in_list(STOPWORDS_ES)}))) > len(list_filter({_NORM_TOK}[1:500], lambda t: t IN ({in_list(STOPWORDS_EN)}))) THEN 'es' ELSE 'en' END"


@query("i02_language", f"SELECT doc_id, {_LANG} AS guessed FROM documents WHERE text IS NOT NULL")
def i02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.language_guess(text.word_tokens(text.normalize_text("text"))).alias("guessed"))


@query(
    "i03_f16_term_frequencies",
    f"""SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_filter(toks, lambda t: length(t) BETWEEN 2 AND 40 AND CASE WHEN lang = 'es' THEN t NOT IN ({in_list(STOPWORDS_ES)}) ELSE t NOT IN ({in_list(STOPWORDS_EN)}) END)) AS term
        FROM (SELECT doc_id, {_NORM_TOK} AS toks, {_LANG} AS lang FROM documents WHERE text IS NOT NULL)) GROUP BY term""",
)
def i03(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    docs = docs.select("doc_id", text.word_tokens(text.normalize_text("text")).alias("toks"))
    docs = docs.select("doc_id", F.explode(text.filter_tokens("toks", text.language_guess("toks"))).alias("term"))
    per_doc = docs.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query(
    "i05_concepts",
    "SELECT doc_id, list_sort(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{text.phrase_pattern(v)}') THEN '{k}' END".replace("\\ ", " ") for k, v in sorted(CONCEPTS_EN.items()))
    + "], lambda x: x IS NOT NULL)) AS concepts FROM documents WHERE text IS NOT NULL",
)
def i05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", concepts.extract("text").alias("concepts"))


@query("i19_embedding_text", "SELECT query_id, chunk_id, CASE WHEN section_heading IS NULL OR trim(section_heading) = '' OR lower(section_heading) = 'main' THEN text ELSE section_heading || ': ' || text END AS embedded FROM positioning_candidates")
def i19(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.chunking import embedding_text

    return table(spark, d, "positioning_candidates").select("query_id", "chunk_id", embedding_text("section_heading", "text").alias("embedded"))
