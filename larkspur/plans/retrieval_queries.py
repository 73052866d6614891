"""Queries over retrieval: BM25, vectors, fusion, expansion, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicons import RELEVANCE_STOPWORDS, SYNONYMS
from ..operators import concepts, evaluation, expansion, fusion, lexical, search, vectors
from ..runtime import table
from .registry import query
from .text_queries import fold_sql, in_list, r6, tokens_sql

FIELDS = {"title": 3.0, "text": 1.0}


def _index(spark: SparkSession, d: str) -> search.Index:
    return search.index_of(table(spark, d, "documents"), d, "doc_id", list(FIELDS))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return lexical.query_terms(table(spark, d, "query_log"), "query_id", "query")


def _best(spark: SparkSession, d: str, k: int, offset: int = 0, every_term: bool = False) -> DataFrame:
    return _index(spark, d).top(_terms(spark, d), FIELDS, k, offset, every_term)


POSTINGS_SQL = f"""
toks AS (
  SELECT doc_id, 'title' AS field, {tokens_sql('title')} AS t FROM documents WHERE title IS NOT NULL
  UNION ALL SELECT doc_id, 'text' AS field, {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL
), post AS (
  SELECT doc_id AS doc, field, term, len(any_value(t)) AS len, count(*) AS tf FROM (SELECT doc_id, field, t, unnest(t) AS term FROM toks WHERE len(t) > 0) GROUP BY doc_id, field, term
), sizes AS (SELECT field, count(*) AS n, avg(len) AS avg_len FROM (SELECT DISTINCT field, doc, len FROM post) GROUP BY field),
freq AS (SELECT field, term, count(*) AS df FROM post GROUP BY field, term),
terms AS (SELECT query_id AS query, n_terms, unnest(t) AS term FROM (SELECT query_id, len(list_distinct({tokens_sql('query')})) AS n_terms, list_distinct({tokens_sql('query')}) AS t FROM query_log)),
per_field AS (
  SELECT query, field, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))) AS s, count(*) AS found, max(n_terms) AS n_terms
  FROM terms JOIN post USING (term) JOIN freq USING (field, term) JOIN sizes USING (field) GROUP BY query, field, doc
), scored AS (SELECT query, doc, max(s * CASE field WHEN 'title' THEN 3.0 ELSE 1.0 END) AS score FROM per_field GROUP BY query, doc),
both_terms AS (SELECT query, doc, max(s * CASE field WHEN 'title' THEN 3.0 ELSE 1.0 END) AS score FROM per_field WHERE found = n_terms GROUP BY query, doc)"""
_ROUND = r6("score")


def top_sql(source: str, k: int, offset: int = 0) -> str:
    return f"SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query, doc, {_ROUND} AS score, row_number() OVER (PARTITION BY query ORDER BY {_ROUND} DESC, doc) AS rank FROM {source}) WHERE rank <= {k + offset} AND rank > {offset}"


@query("j01_bm25_topk", f"WITH {POSTINGS_SQL} {top_sql('scored', 10)}")
def j01(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, 10)


@query("j01_bm25_every_term", f"WITH {POSTINGS_SQL} {top_sql('both_terms', 10)}")
def j01_and(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, 10, every_term=True)


@query("g04_paging", f"WITH {POSTINGS_SQL} {top_sql('scored', 10, 10)}")
def g04(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, 10, offset=10)


@query("f02_total_hits", f"WITH {POSTINGS_SQL} SELECT query, count(*) AS hits FROM scored GROUP BY query")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).hits(_terms(spark, d))


CONCEPTS_SQL = (
    "list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({{0}}, '')), '{text.phrase_pattern(v)}') THEN '{k}' END".replace("\\ ", " ") for k, v in sorted(concepts.CONCEPTS_EN.items()))
    + "], lambda x: x IS NOT NULL)"
)


@query(
    "j02_concept_boost",
    f"""WITH {POSTINGS_SQL}, dc AS (SELECT doc_id AS doc, unnest({CONCEPTS_SQL.format('text')}) AS c FROM documents), qc AS (SELECT query_id AS query, unnest({CONCEPTS_SQL.format('query')}) AS c FROM query_log),
    shared AS (SELECT DISTINCT query, doc FROM qc JOIN dc USING (c)), boosted AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.doc, b.doc) AS doc, coalesce(a.score, 0.0) + CASE WHEN b.query IS NULL THEN 0.0 ELSE 3.0 END AS score FROM scored a FULL JOIN shared b ON a.query = b.query AND a.doc = b.doc)
    {top_sql('boosted', 10)}""",
)
def j02(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("concepts", concepts.extract("text"))
    asked = table(spark, d, "query_log").where("query_id IS NOT NULL").select(F.col("query_id").alias("query"), F.explode(concepts.extract("query")).alias("term"))
    return search.index_of(docs, d, "doc_id", list(FIELDS), "concepts").top(_terms(spark, d), FIELDS, 10, tags=asked)


@query(
    "j04_query_analysis",
    f"SELECT query_id, list_sort(c) AS concepts, CASE WHEN len(c) > 0 THEN 'or' ELSE 'and' END AS operator FROM (SELECT query_id, {CONCEPTS_SQL.format('query')} AS c FROM query_log)",
)
def j04(spark: SparkSession, d: str) -> DataFrame:
    c = concepts.extract("query")
    return table(spark, d, "query_log").select("query_id", c.alias("concepts"), F.when(F.size(c) > 0, "or").otherwise("and").alias("operator"))


@query("j05_highlights")
def j05(spark: SparkSession, d: str) -> DataFrame:
    top = _best(spark, d, 3)
    q = table(spark, d, "query_log").select(F.col("query_id").alias("query"), F.array_distinct(text.tokens("query")).alias("terms"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return top.join(q, "query").join(docs, "doc").select("query", "doc", "rank", lexical.highlight("text", "terms").alias("fragment"))


_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x))))"


@query(
    "j06_knn_topk",
    f"""WITH pairs AS (SELECT CAST(q.vec_id AS VARCHAR) AS query, CAST(v.vec_id AS VARCHAR) AS item, {r6(_COS)} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query, item, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM pairs) WHERE rank <= 10""",
)
def j06(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector as a query, against all."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.top_similar(v.where("id % 100 = 0"), v, 10)


@query(
    "j08_semantic_threshold",
    f"""WITH pairs AS (SELECT CAST(q.vec_id AS VARCHAR) AS query, CAST(v.vec_id AS VARCHAR) AS item, {r6(_COS)} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query, item, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM pairs WHERE score >= 0.3) WHERE rank <= 20""",
)
def j08(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.top_similar(v.where("id % 100 = 0"), v, 20, least=0.3)


# fusion over the rankings that the hits' scores give ------------------------------------------------------------------


def _rankings(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of each query's candidates: by lexical and by vector score."""
    c = table(spark, d, "positioning_candidates")
    parts = []
    for source in ("lexical", "vector"):
        w = W.partitionBy("query_id").orderBy(F.col("s").desc(), "chunk_id")
        best = c.where(F.col(f"{source}_score").isNotNull()).groupBy("query_id", "chunk_id").agg(F.max(f"{source}_score").alias("s"))
        parts.append(best.select(F.col("query_id").alias("query"), F.lit(source).alias("source"), F.col("chunk_id").alias("item"), F.row_number().over(w).alias("rank"), F.col("s").alias("score")))
    return parts[0].unionByName(parts[1])


RANKINGS_SQL = """rankings AS (
  SELECT query_id AS query, 'lexical' AS source, chunk_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank, s AS score FROM (SELECT query_id, chunk_id, max(lexical_score) AS s FROM positioning_candidates WHERE lexical_score IS NOT NULL GROUP BY ALL)
  UNION ALL SELECT query_id AS query, 'vector' AS source, chunk_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank, s AS score FROM (SELECT query_id, chunk_id, max(vector_score) AS s FROM positioning_candidates WHERE vector_score IS NOT NULL GROUP BY ALL))"""


def _ordered_sql(inner: str, k: int | None = None) -> str:
    cut = f" WHERE rank <= {k}" if k else ""
    return f"SELECT query, item, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query, item, {_ROUND} AS score, row_number() OVER (PARTITION BY query ORDER BY {_ROUND} DESC, item) AS rank FROM ({inner})){cut}"


@query("f08_rrf_fusion", f"WITH {RANKINGS_SQL} " + _ordered_sql("SELECT query, item, sum(1.0 / (60 + rank)) AS score FROM rankings GROUP BY query, item"))
def f08(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank(_rankings(spark, d))


_WS = "SELECT query, item, sum(w * CASE WHEN best > 0 THEN score / best ELSE score END) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query, source) AS best, CASE source WHEN 'lexical' THEN 0.5 WHEN 'vector' THEN 0.5 ELSE 0.0 END AS w FROM rankings) GROUP BY query, item"


@query("f09_weighted_sum", f"WITH {RANKINGS_SQL} " + _ordered_sql(_WS))
def f09(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted_sum(_rankings(spark, d), {"lexical": 0.5, "vector": 0.5})


@query("f10_borda", f"WITH {RANKINGS_SQL} " + _ordered_sql("SELECT query, item, CAST(sum(most - (rank - 1)) AS DOUBLE) AS score FROM (SELECT *, max(rank) OVER (PARTITION BY query) AS most FROM rankings) GROUP BY query, item"))
def f10(spark: SparkSession, d: str) -> DataFrame:
    return fusion.borda(_rankings(spark, d))


@query(
    "g14_interleave",
    f"WITH {RANKINGS_SQL} SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY r, t, item) AS INTEGER) AS rank FROM (SELECT query, item, rank AS r, t FROM (SELECT *, CASE source WHEN 'lexical' THEN 1 ELSE 2 END AS t, row_number() OVER (PARTITION BY query, item ORDER BY rank, CASE source WHEN 'lexical' THEN 1 ELSE 2 END) AS n FROM rankings) WHERE n = 1)",
)
def g14(spark: SparkSession, d: str) -> DataFrame:
    return fusion.interleave(_rankings(spark, d), ["lexical", "vector"])


@query("h01_unique_items", f"WITH {RANKINGS_SQL} SELECT DISTINCT query, item FROM rankings")
def h01(spark: SparkSession, d: str) -> DataFrame:
    return fusion.unique_items(_rankings(spark, d))


@query("h10_intersect", f"WITH {RANKINGS_SQL} SELECT query, item, max(score) AS score FROM rankings GROUP BY query, item HAVING count(DISTINCT source) = 2")
def h10(spark: SparkSession, d: str) -> DataFrame:
    return fusion.intersect(_rankings(spark, d), 2)


@query("h10_negate", f"WITH {RANKINGS_SQL} SELECT query, item, score FROM rankings a WHERE source = 'lexical' AND NOT EXISTS (SELECT 1 FROM rankings b WHERE b.source = 'vector' AND b.query = a.query AND b.item = a.item)")
def h10_negate(spark: SparkSession, d: str) -> DataFrame:
    return fusion.negate(_rankings(spark, d), "lexical", "vector")


def _vectors_sql(name: str, source: str, key: str, col: str) -> str:
    place = "(instr('0123456789abcdef', substr(h, 1, 1)) * 16 - 16 + instr('0123456789abcdef', substr(h, 2, 1)) - 1) % 64"
    return f"""{name}_v AS (SELECT id, d, sum(s) AS v FROM (SELECT id, {place} AS d, CASE WHEN substr(h, 3, 1) < '8' THEN 1 ELSE -1 END AS s FROM (SELECT id, md5(unnest(t)) AS h FROM (SELECT {key} AS id, list_distinct({tokens_sql(col)}) AS t FROM {source} WHERE {col} IS NOT NULL))) GROUP BY id, d HAVING sum(s) <> 0),
    {name}_n AS (SELECT id, sum(v * v) AS n FROM {name}_v GROUP BY id)"""


def hybrid_sql(source: str) -> str:
    """The CTEs of the hybrid search of a table of queries (query_id, query), the last of them ``fused``."""
    return f"""{POSTINGS_SQL.replace("FROM query_log", f"FROM {source}")}, lex AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY {_ROUND} DESC, doc) AS rank FROM scored),
    {_vectors_sql("q", source, "query_id", "query")}, {_vectors_sql("d", "documents", "doc_id", "title")},
    dots AS (SELECT q.id AS query, d.id AS doc, sum(q.v * d.v) AS dot FROM q_v q JOIN d_v d USING (d) GROUP BY q.id, d.id),
    sem0 AS (SELECT query, doc, {r6("dot / (sqrt(a.n) * sqrt(b.n))")} AS score FROM dots JOIN q_n a ON a.id = query JOIN d_n b ON b.id = doc),
    sem AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, CAST(doc AS VARCHAR)) AS rank FROM sem0 WHERE score >= 0.3),
    fused AS (SELECT query, doc AS item, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM lex WHERE rank <= 100 UNION ALL SELECT * FROM sem WHERE rank <= 100) GROUP BY query, doc)"""


@query("j09_hybrid", f"WITH {hybrid_sql('query_log')} " + _ordered_sql("SELECT * FROM fused", 10))
def j09(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over title and text fused with the cosine of hashed vectors of query and title (from 0.3 on), 100 candidates
    from each, the best ten of both."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("title").alias("text"))
    queries = table(spark, d, "query_log").select(F.col("query_id").alias("query"), F.col("query").alias("text"))
    return search.hybrid(_index(spark, d), queries, docs, FIELDS, top=10)


@query(
    "e01_e02_fused_with_metadata",
    f"""WITH {RANKINGS_SQL}, fused AS ({_ordered_sql("SELECT query, item, sum(1.0 / (60 + rank)) AS score FROM rankings GROUP BY query, item", 10)}),
    meta AS (SELECT query_id, chunk_id, min(doc_id) AS doc_id, min(title) AS title, min(url) AS url FROM positioning_candidates GROUP BY query_id, chunk_id)
    SELECT f.query, f.item, f.rank, m.doc_id, m.title, coalesce(m.url, h.url) AS url FROM fused f LEFT JOIN meta m ON f.query = m.query_id AND f.item = m.chunk_id LEFT JOIN (SELECT doc_id, min(url) AS url FROM search_hits GROUP BY doc_id) h ON m.doc_id = h.doc_id""",
)
def e01(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.reciprocal_rank(_rankings(spark, d), top=10)
    meta = table(spark, d, "positioning_candidates").groupBy(F.col("query_id").alias("query"), F.col("chunk_id").alias("item")).agg(F.min("doc_id").alias("doc_id"), F.min("title").alias("title"), F.min("url").alias("u"))
    hits = table(spark, d, "search_hits").groupBy("doc_id").agg(F.min("url").alias("hu"))
    return fused.join(meta, ["query", "item"], "left").join(hits, "doc_id", "left").select("query", "item", "rank", "doc_id", "title", F.coalesce("u", "hu").alias("url"))


_RR = "len(list_intersect(qt, ct)) / CAST(greatest(len(qt), 1) AS DOUBLE)"


@query(
    "g05_j11_rerank",
    f"""WITH base AS (SELECT p.query_id, chunk_id, max(hybrid_score) AS hybrid, min(text) AS text FROM positioning_candidates p GROUP BY ALL), pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, chunk_id) AS r FROM base),
    s AS (SELECT p.query_id, chunk_id, {r6(_RR)} AS score FROM (SELECT p.query_id, chunk_id, list_distinct({tokens_sql('q.query')}) AS qt, list_distinct({tokens_sql('p.text')}) AS ct FROM pool p JOIN query_log q USING (query_id) WHERE r <= 100) p)
    SELECT query_id, chunk_id, score, CAST(n - 1 AS INTEGER) AS new_position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM s) WHERE n <= 10 AND score >= 0.05""",
)
def g05(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best by hybrid score, reranked by the share of the query's words in the text (a stand-in for a model
    behind the same place in the plan); the threshold applies after the cut."""
    c = table(spark, d, "positioning_candidates").groupBy("query_id", "chunk_id").agg(F.max("hybrid_score").alias("hybrid"), F.min("text").alias("text"))
    pool = c.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("hybrid").desc(), "chunk_id"))).where("r <= 100")
    q = table(spark, d, "query_log").select("query_id", F.array_distinct(text.tokens("query")).alias("qt"))
    s = pool.join(q, "query_id").select("query_id", "chunk_id", text.round6(F.size(F.array_intersect("qt", F.array_distinct(text.tokens("text")))) / F.greatest(F.size("qt"), F.lit(1)).cast("double")).alias("score"))
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    return s.withColumn("n", n).where("n <= 10").where("score >= 0.05").select("query_id", "chunk_id", "score", (F.col("n") - 1).alias("new_position"))


# expansion -----------------------------------------------------------------------------------------------------------


@query("k01_synonym_hits", "SELECT query_id, " + ", ".join(f"regexp_matches(lower(query), '(^|[^a-z0-9]){k}($|[^a-z0-9])') AS {k.replace(' ', '_')}" for k in list(SYNONYMS)[:8]) + " FROM query_log")
def k01_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log").select("query_id", *[text.whole_term("query", k).alias(k.replace(" ", "_")) for k in list(SYNONYMS)[:8]])


def _prf_sql(n_docs: int, n_terms: int) -> str:
    return f"""texts AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, chunk_id) AS position FROM (SELECT query_id, chunk_id, max(hybrid_score) AS hybrid, min(text) AS text FROM positioning_candidates GROUP BY ALL)),
    each AS (SELECT query_id, position, t[p] AS term, p FROM (SELECT query_id, position, t, unnest(range(1, len(t) + 1)) AS p FROM (SELECT query_id, position, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS t FROM texts WHERE position <= {n_docs}))),
    counted AS (SELECT e.query_id, term, count(*) AS n, min(position * 1000000 + p) AS first FROM each e JOIN query_log q USING (query_id) WHERE term NOT IN ({in_list(RELEVANCE_STOPWORDS)}) AND NOT list_contains(regexp_split_to_array(lower(q.query), '\\s+'), term) GROUP BY e.query_id, term),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS r FROM counted) WHERE r <= {n_terms})"""


@query(
    "k02_g15_pseudo_relevance",
    f"""WITH {_prf_sql(5, 8)} SELECT q.query_id AS query, CASE WHEN t IS NULL THEN q.query ELSE trim(q.query, ' ') || ' ' || t END AS expanded FROM query_log q LEFT JOIN (SELECT query_id, string_agg(term, ' ' ORDER BY r) AS t FROM best GROUP BY query_id) b ON q.query_id = b.query_id""",
)
def k02(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "positioning_candidates").groupBy("query_id", "chunk_id").agg(F.max("hybrid_score").alias("h"), F.min("text").alias("text"))
    ranked = c.select(F.col("query_id").alias("query"), F.row_number().over(W.partitionBy("query_id").orderBy(F.col("h").desc(), "chunk_id")).alias("rank"), "text")
    return expansion.pseudo_relevance(ranked, table(spark, d, "query_log").select(F.col("query_id").alias("query"), F.col("query").alias("text")))


# evaluation ----------------------------------------------------------------------------------------------------------


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector as a query; a neighbour under the same label is a hit."""
    v = table(spark, d, "embeddings")
    top = vectors.top_similar(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "embedding"), v.select(F.col("vec_id").alias("id"), "embedding"), 20)
    label = v.select(F.col("vec_id").cast("string").alias("query"), F.col("label").alias("lq"))
    hits = top.join(label, "query").join(v.select(F.col("vec_id").cast("string").alias("item"), "label"), "item").select("query", "rank", (F.col("lq") == F.col("label")).alias("hit"))
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    relevant = v.where("vec_id % 100 = 0").join(sizes, "label").select(F.col("vec_id").cast("string").alias("query"), "n_relevant")
    return hits, relevant


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """At cut 10. The corpus is every vector that is searched, a query's own included."""
    hits, relevant = _hits(spark, d)
    corpus = vectors.searched(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return evaluation.metrics(hits, relevant, 10, corpus_size=corpus)


_EVAL = f"""pairs AS (SELECT CAST(q.vec_id AS VARCHAR) AS query, CAST(v.vec_id AS VARCHAR) AS item, q.label = v.label AS hit, {r6(_COS)} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM pairs), top AS (SELECT * FROM ranked WHERE rank <= 20),
  rel AS (SELECT CAST(q.vec_id AS VARCHAR) AS query, CAST((SELECT count(*) - 1 FROM embeddings v WHERE v.label = q.label) AS DOUBLE) AS r FROM embeddings q WHERE vec_id % 100 = 0),
  run AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY query ORDER BY rank) AS sofar FROM top),
  agg AS (SELECT rel.query, r, coalesce(sum(CASE WHEN hit AND rank <= 10 THEN 1 END), 0) AS n, count(CASE WHEN rank <= 10 THEN 1 END) AS shown, coalesce(sum(CASE WHEN hit THEN CAST(sofar AS DOUBLE) / rank END), 0.0) AS gain, min(CASE WHEN hit THEN rank END) AS first,
    coalesce(sum(CASE WHEN hit AND rank <= 10 THEN 1 / log2(rank + 1.0) END), 0.0) AS dcg, coalesce(sum(CASE WHEN hit AND rank <= r THEN 1 END), 0) AS at_r FROM rel LEFT JOIN run USING (query) GROUP BY rel.query, r),
  per AS (SELECT query, n / 10.0 AS precision, CASE WHEN r > 0 THEN n / r ELSE 0.0 END AS recall, CASE WHEN r > 0 THEN gain / r ELSE 0.0 END AS average_precision, coalesce(1.0 / first, 0.0) AS reciprocal_rank, CAST(n > 0 AS INTEGER) AS hit, coalesce(CAST(first = 1 AS INTEGER), 0) AS top1, coalesce(CAST(first <= 3 AS INTEGER), 0) AS top3,
    CASE WHEN r > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(10, r) AS INTEGER) + 1), lambda i: 1 / log2(i + 1.0))) ELSE 0.0 END AS ndcg, CASE WHEN r > 0 THEN at_r / r ELSE 0.0 END AS r_precision, CASE WHEN corpus - r > 0 THEN (shown - n) / (corpus - r) ELSE 0.0 END AS fallout FROM agg, (SELECT count(*) AS corpus FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0))"""
_METRICS = ["precision", "recall", "average_precision", "reciprocal_rank", "ndcg", "r_precision", "fallout"]


@query("p01_p10_metrics", f"WITH {_EVAL} SELECT query, hit, top1, top3, " + ", ".join(f"{r6(m)} AS {m}" for m in _METRICS) + f", {r6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1 FROM per")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query", "hit", "top1", "top3", *[text.round6(c).alias(c) for c in [*_METRICS, "f1"]])


@query("f17_macro_average", f"WITH {_EVAL} SELECT count(*) AS queries, " + ", ".join(f"{r6(f'sum({m}) / count(*)')} AS {m}" for m in _METRICS) + " FROM per")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.macro(_metrics(spark, d), _METRICS).select("queries", *[text.round6(c).alias(c) for c in _METRICS])


@query("e09_p12_name_hits")
def e09(spark: SparkSession, d: str) -> DataFrame:
    """Documents ranked for the questions of the evaluation items; a title that names a relevant condition is a hit."""
    items = table(spark, d, "eval_items")
    top = _index(spark, d).top(lexical.query_terms(items, "item_id", "query"), FIELDS, 10)
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "title")
    ranked = top.join(titles, "doc").select("query", "rank", F.array_compact(F.array("title")).alias("aliases"))
    qrels = items.select(F.col("item_id").alias("query"), F.col("relevant_disease_names").alias("names"))
    return evaluation.metrics(evaluation.name_hits(ranked, qrels), qrels.select("query", F.size("names").alias("n_relevant")), 10)
