"""Queries over keyed tables, joins, facets, statistics and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import chunking, corpus, incremental, lexical
from ..runtime import table
from .registry import query
from .text_queries import r6


def _acquired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "acquired").select("arrival_seq", "batch_id", "doc_id", "url", F.lower("content_hash").alias("content_hash"), F.col("content.body").alias("body"), F.col("content.mime_type").alias("mime_type"), "source_domain", "page_meta", "crawl")


@query(
    "b03_upsert_documents",
    """WITH new AS (SELECT doc_id, lower(content_hash) AS content_hash, arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY arrival_seq DESC) AS r FROM acquired WHERE batch_id > 0) WHERE r = 1),
    old AS (SELECT doc_id, lower(content_hash) AS content_hash, arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY arrival_seq DESC) AS r FROM acquired WHERE batch_id = 0) WHERE r = 1)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""",
)
def b03(spark: SparkSession, d: str) -> DataFrame:
    a = _acquired(spark, d).select("doc_id", "content_hash", "arrival_seq", "batch_id")
    one = lambda rows: incremental.latest(rows.drop("batch_id"), ["doc_id"], ["arrival_seq"])
    return incremental.upsert(one(a.where("batch_id = 0")), one(a.where("batch_id > 0")), ["doc_id"])


@query("b06_delete_by_ids", "SELECT DISTINCT chunk_id FROM positioning_candidates WHERE chunk_id NOT IN (SELECT chunk_id FROM search_hits WHERE chunk_id IS NOT NULL)")
def b06(spark: SparkSession, d: str) -> DataFrame:
    return incremental.delete(table(spark, d, "positioning_candidates").select("chunk_id").distinct(), table(spark, d, "search_hits").where("chunk_id is not null"), ["chunk_id"])


@query("b08_latest_manifest", "SELECT doc_id, lower(content_hash) AS content_hash, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY indexed_at DESC, lower(content_hash) DESC) AS r FROM manifest) WHERE r = 1")
def b08(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("doc_id", F.lower("content_hash").alias("content_hash"), "indexed_at")
    return incremental.latest(m, ["doc_id"], ["indexed_at"])


@query(
    "b09_b10_votes",
    "SELECT user_id, product, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS product, event_type, event_id, ts FROM events)) WHERE r = 1 AND event_type <> (SELECT min(event_type) FROM events)",
)
def b09(spark: SparkSession, d: str) -> DataFrame:
    """Events as votes: a user's last event on an item counts, unless its type (the first in the alphabet) takes it back."""
    e = table(spark, d, "events").select("user_id", F.floor("value").alias("product"), "event_type", "event_id", "ts")
    kind = e.agg(F.min("event_type")).first()[0]
    return incremental.current_votes(e, ["user_id", "product"], "ts", "event_id", "event_type", kind).select("user_id", "product", "event_type", "event_id")


@query(
    "b12_g19_runs",
    "SELECT r.session_id, r.n, q.query_id, q.created_at FROM (SELECT session_id, count(*) AS n FROM query_log WHERE session_id IS NOT NULL GROUP BY session_id) r JOIN query_log q USING (session_id)",
)
def b12(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_log").where("session_id is not null")
    return q.groupBy("session_id").agg(F.count("*").alias("n")).join(q.select("session_id", "query_id", "created_at"), "session_id")


@query("e03_with_documents", "SELECT h.hit_id, h.doc_id, a.url, a.seed_group FROM search_hits h LEFT JOIN (SELECT doc_id, min(url) AS url, min(crawl.seed_group) AS seed_group FROM acquired GROUP BY doc_id) a ON h.doc_id = a.doc_id")
def e03(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "acquired").groupBy("doc_id").agg(F.min("url").alias("url"), F.min("crawl.seed_group").alias("seed_group"))
    return table(spark, d, "search_hits").select("hit_id", "doc_id").join(a, "doc_id", "left").select("hit_id", "doc_id", "url", "seed_group")


@query("e04_q03_not_in_manifest", "SELECT arrival_seq, doc_id FROM acquired a WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.doc_id = a.doc_id AND lower(m.content_hash) = sha256(a.content.body) AND m.pipeline_version = 'p3.1')")
def e04(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "acquired").select("arrival_seq", "doc_id", F.sha2("content.body", 256).alias("content_hash"))
    return incremental.skip_known(a, table(spark, d, "manifest"), "p3.1").select("arrival_seq", "doc_id")


@query("e05_chunks_to_embed", "SELECT DISTINCT chunk_id FROM positioning_candidates p WHERE NOT EXISTS (SELECT 1 FROM positioning_candidates o WHERE o.chunk_id = p.chunk_id AND o.embedding IS NOT NULL AND len(o.embedding) > 0)")
def e05(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "positioning_candidates")
    return c.select("chunk_id").distinct().join(c.where("embedding is not null and size(embedding) > 0").select("chunk_id"), "chunk_id", "left_anti")


@query("e06_e07_new_documents", "SELECT arrival_seq FROM acquired a WHERE batch_id > 0 AND NOT EXISTS (SELECT 1 FROM acquired o WHERE o.batch_id = 0 AND o.url = a.url) AND NOT EXISTS (SELECT 1 FROM acquired o WHERE o.batch_id = 0 AND o.content.body = a.content.body)")
def e06(spark: SparkSession, d: str) -> DataFrame:
    a = _acquired(spark, d).select("arrival_seq", "batch_id", "url", F.sha2("body", 256).alias("h"))
    return corpus.without_known_identities(a.where("batch_id > 0"), a.where("batch_id = 0"), ["url", "h"]).select("arrival_seq")


@query("d10_excluded", "SELECT query_id, chunk_id FROM positioning_candidates p WHERE NOT EXISTS (SELECT 1 FROM positioning_candidates o WHERE o.query_id = p.query_id AND o.chunk_id = p.chunk_id AND o.cross_encoder_score < 0)")
def d10(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "positioning_candidates")
    return c.select("query_id", "chunk_id").join(c.where("cross_encoder_score < 0").select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")


_FACET = "SELECT '{0}' AS field, CAST({0} AS VARCHAR) AS value, count(*) AS n FROM documents WHERE {0} IS NOT NULL GROUP BY {0}"


@query("f01_facets", "SELECT field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM (" + " UNION ALL ".join(_FACET.format(f) for f in ("lang", "source")) + ")) WHERE r <= 20")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return lexical.facets(table(spark, d, "documents"), ["lang", "source"])


@query("f03_g16_headings", "SELECT heading, count(*) AS n FROM (SELECT unnest(content.sections).heading AS heading FROM acquired) GROUP BY heading ORDER BY n DESC, heading LIMIT 20")
def f03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "acquired").select(F.explode("content.sections.heading").alias("heading")).groupBy("heading").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "heading").limit(20)


@query("f03_dimension_counts", "SELECT content.mime_type AS mime_type, page_meta.language AS language, crawl.seed_group AS seed_group, crawl.depth AS depth, count(*) AS n FROM acquired GROUP BY ALL")
def f03_dims(spark: SparkSession, d: str) -> DataFrame:
    a = _acquired(spark, d)
    return a.groupBy("mime_type", F.col("page_meta.language").alias("language"), F.col("crawl.seed_group").alias("seed_group"), F.col("crawl.depth").alias("depth")).agg(F.count("*").alias("n"))


@query(
    "f04_length_statistics",
    "SELECT source, count(l) AS n, CAST(floor(avg(l)) AS BIGINT) AS avg, min(l) AS min, max(l) AS max, " + ", ".join(f"CAST(floor(quantile_cont(l, {p / 100}) + 0.000001) AS BIGINT) AS p{p}" for p in (50, 90, 95, 99)) + " FROM (SELECT source, CAST(n_chars AS BIGINT) AS l FROM documents) GROUP BY source",
)
def f04(spark: SparkSession, d: str) -> DataFrame:
    return corpus.length_statistics(table(spark, d, "documents"), "source", F.col("n_chars").cast("long"))


@query("f05_duplicate_totals", "SELECT count(*) AS groups, coalesce(sum(c), 0)::BIGINT AS rows, coalesce(sum(c - 1), 0)::BIGINT AS extra FROM (SELECT count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def f05(spark: SparkSession, d: str) -> DataFrame:
    return corpus.duplicate_totals(table(spark, d, "documents"), F.sha2("text", 256))


@query("f18_phase_statistics", f"SELECT content.mime_type AS mime_type, count(*) AS docs, {r6('avg(len(regexp_extract_all(content.body, chr(92) || chr(119) || chr(43))))')} AS avg_words FROM acquired GROUP BY 1".replace("chr(92) || chr(119) || chr(43)", "'[A-Za-z0-9_]+'"))
def f18(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_count("body", F.lit("[A-Za-z0-9_]+"))
    return _acquired(spark, d).groupBy("mime_type").agg(F.count("*").alias("docs"), (F.floor(F.avg(words) * 1000000 + 0.5) / 1000000.0).alias("avg_words"))


@query("f19_run_counters", "SELECT mime, count(*) AS rows, count(CASE WHEN known THEN 1 END) AS skipped, count(CASE WHEN NOT known THEN 1 END) AS sent FROM (SELECT content.mime_type AS mime, EXISTS (SELECT 1 FROM manifest m WHERE m.doc_id = a.doc_id) AS known FROM acquired a) GROUP BY mime")
def f19(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("doc_id").distinct().withColumn("known", F.lit(True))
    a = _acquired(spark, d).select("doc_id", F.col("mime_type").alias("mime")).join(m, "doc_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return incremental.run_counts(a, "mime", {"skipped": "known", "sent": "not known"})


@query("h02_multi_index_union", "SELECT 'hits' AS corpus, doc_id, url FROM search_hits UNION ALL SELECT 'acquired' AS corpus, doc_id, url FROM acquired")
def h02(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda t: table(spark, d, t).select("doc_id", "url")
    return pick("search_hits").withColumn("corpus", F.lit("hits")).unionByName(pick("acquired").withColumn("corpus", F.lit("acquired"))).select("corpus", "doc_id", "url")


@query("h03_distinct_ids", "SELECT DISTINCT doc_id FROM search_hits")
def h03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("doc_id").distinct()


@query(
    "h04_crawl_dedup",
    "WITH u AS (SELECT * FROM (SELECT arrival_seq, url, sha256(content.body) AS h, row_number() OVER (PARTITION BY url ORDER BY arrival_seq) AS r FROM acquired) WHERE r = 1) SELECT arrival_seq, url FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY arrival_seq) AS k FROM u) WHERE k = 1",
)
def h04(spark: SparkSession, d: str) -> DataFrame:
    a = _acquired(spark, d).select("arrival_seq", "url", F.sha2("body", 256).alias("h"))
    return corpus.first_by_key(corpus.first_by_key(a, ["url"], ["arrival_seq"]), ["h"], ["arrival_seq"]).select("arrival_seq", "url")


@query("h07_terms_once", "SELECT query_id, term, min(p) AS place FROM (SELECT query_id, lower(t[p]) AS term, p FROM (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS p FROM (SELECT query_id, string_split(query, ' ') AS t FROM query_log))) GROUP BY query_id, term")
def h07(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "query_log").select("query_id", F.posexplode(F.split("query", " ")).alias("p", "t"))
    return e.groupBy("query_id", F.lower("t").alias("term")).agg((F.min("p") + 1).cast("long").alias("place"))


@query("i07_i16_i17_chunks")
def i07(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "acquired").select("arrival_seq", "doc_id", "content"), ["arrival_seq", "doc_id"])


@query(
    "i16_prepared_documents",
    """SELECT arrival_seq, length(body) AS n_chars, n_sections, substr(fetched_at, 1, 10) AS fetched_day, lang FROM (SELECT arrival_seq, array_to_string(list_transform(list_filter(content.sections, lambda s: s.text IS NOT NULL), lambda s: s.text), chr(10)) AS body, len(content.sections) AS n_sections, fetched_at, lower(substr(page_meta.language, 1, 2)) AS lang FROM acquired)""",
)
def i16(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "acquired")
    body = F.array_join(F.filter("content.sections.text", lambda t: t.isNotNull()), "\n")
    return a.select("arrival_seq", F.length(body).cast("long").alias("n_chars"), F.size("content.sections").cast("long").alias("n_sections"), F.substring("fetched_at", 1, 10).alias("fetched_day"), F.lower(F.substring("page_meta.language", 1, 2)).alias("lang"))


# event time, as batch; the streaming forms are in larkspur.streaming --------------------------------------------------


@query("q05_tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "q06_sessions",
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, sid",
)
def q06(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("f", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1))
    e = e.withColumn("sid", F.sum("f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "sid").agg(F.min("ts").alias("started"), F.count("*").alias("events")).drop("sid")


@query("q04_late_queries", "SELECT query_id, received_at - created_at > INTERVAL 1 DAY AS late FROM query_log")
def q04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log").select("query_id", (F.col("received_at") - F.col("created_at") > F.expr("interval 1 day")).alias("late"))


# the star schema: facets, percentiles and top-k at the scale of lineitem ------------------------------------------------


@query("x01_lineitem_facets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(floor(sum(l_quantity) + 0.5) AS BIGINT) AS quantity, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL")
def x01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.floor(F.sum("l_quantity") + 0.5).cast("long").alias("quantity"), F.count_distinct("l_orderkey").alias("orders"))


@query("x02_top_orders_per_nation", "SELECT n_name, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (SELECT n_name, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE r <= 5")
def x02(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("n_name").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))).where("rank <= 5").select("n_name", "o_orderkey", "o_totalprice", "rank")
