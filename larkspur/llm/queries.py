"""Queries over the text operators and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import boilerplate, encoder, history, knn, leakage, sitelines, spam, splitter, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.find_spam(table(spark, d, "search_hits"))


def p1_by_source(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_by_source(table(spark, d, "search_hits"))


def _acquired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "acquired").select("batch_id", "arrival_seq", "doc_id", F.col("content.body").alias("body"))


def _p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = history.rows_of(_acquired(spark, d), body="body")
    past = history.History.create(spark)
    past.start(rows.where("at.b = 0"))
    return history.check(past, rows.where("at.b > 0")).pairs


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Batch 0 is the history; the rows after it are one increment, settled in the order of their arrival."""
    return _p2_pairs(spark, d).select(F.least("doc", "accepted").alias("doc_id_a"), F.greatest("doc", "accepted").alias("doc_id_b")).distinct()


def p2_accepted_hash(spark: SparkSession, d: str) -> DataFrame:
    """Each repeat with the document that it repeats and that document's hash in the manifest."""
    return history.with_manifest(_p2_pairs(spark, d), table(spark, d, "manifest"))


def p2_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """The same batch by batch, each against the growing index: repeats and accepted documents of each batch."""
    rows = history.rows_of(_acquired(spark, d), body="body")
    past = history.History.create(spark)
    past.start(rows.where("at.b = 0"))
    out = None
    for batch in sorted(r[0] for r in rows.where("at.b > 0").select("at.b").distinct().toLocalIterator()):
        found = history.check_and_append(past, rows.where(F.col("at.b") == batch))
        line = found.pairs.agg(F.lit(batch).alias("batch_id"), F.count_distinct("doc").alias("repeats"), F.count("*").alias("pairs")).crossJoin(found.accepted.agg(F.count("*").alias("accepted")))
        out = line if out is None else out.unionByName(line)
    return out if out is not None else spark.createDataFrame([], "batch_id long, repeats long, pairs long, accepted long")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.find_repeated_lines(table(spark, d, "search_hits"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits").select("hit_id", "doc_id", "source_domain", "content")
    return sitelines.remove_lines(hits, sitelines.find_repeated_lines(hits)).select("hit_id", "clean_content")


def p3_cut_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.cut_repeated_chunks(table(spark, d, "search_hits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.find_boilerplate(table(spark, d, "search_hits"))


def p4_article(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_text(table(spark, d, "search_hits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest_pairs(table(spark, d, "positioning_candidates")).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest(table(spark, d, "positioning_candidates")).withColumnRenamed("id", "chunk_id").withColumnRenamed("near_id", "near_chunk_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split_oversized(table(spark, d, "search_hits"), table(spark, d, "chunk_configs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the splitter cuts: each has a first piece."""
    return p6_pieces(spark, d).where("piece_no = 0").select("hit_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoder.encode(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return encoder.round_trip_report(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_longest(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leakage.clean_documents(docs.select("doc_id", "source", "n_chars"), leakage.find_leaks(docs, table(spark, d, "eval_items")))


def _p9_scored(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_documents(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _p9_scored(spark, d).where("offends").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _p9_scored(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(_p9_scored(spark, d))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_by_source, p2_found, p2_accepted_hash, p2_by_batch, p3_found, p3_clean, p3_cut_chunks, p4_found, p4_article, p5_found, p5_neighbours, p6_found, p6_pieces, p7_ids, p7_round_trip, p8_found, p8_longest, p8_clean, p9_found, p9_scores, p9_rates)
}

_LINES = """
lines AS (
  SELECT hit_id, doc_id, src, i - 1 AS line_no, parts[i] AS raw FROM (
    SELECT hit_id, doc_id, regexp_replace(lower(trim(source_domain)), '^www\\.', '') AS src, string_split(content, chr(10)) AS parts, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i
    FROM search_hits WHERE source_domain IS NOT NULL AND trim(source_domain) <> '' AND content IS NOT NULL AND doc_id IS NOT NULL)
), normal AS (
  SELECT hit_id, doc_id, src, line_no, trim(regexp_replace(regexp_replace(lower(raw), '\\d+', '0', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS line FROM lines
), often AS (
  SELECT src, line FROM normal WHERE length(line) >= 20 GROUP BY src, line HAVING count(DISTINCT doc_id) >= 6
)"""
_SPACES = "'[^\\x{0009}-\\x{000d}\\x{0020}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"

SQL: dict[str, str] = {
    "p3_found": f"WITH {_LINES} SELECT hit_id, CAST(line_no AS INTEGER) AS line_no FROM normal JOIN often USING (src, line)",
    "p3_clean": f"""WITH {_LINES}, gone AS (SELECT hit_id, line_no FROM normal JOIN often USING (src, line)),
        kept AS (SELECT l.hit_id, string_agg(raw, chr(10) ORDER BY l.line_no) AS clean_content FROM lines l ANTI JOIN gone g ON l.hit_id = g.hit_id AND l.line_no = g.line_no GROUP BY l.hit_id)
        SELECT h.hit_id, CASE WHEN g.hit_id IS NULL THEN h.content ELSE coalesce(k.clean_content, '') END AS clean_content
        FROM search_hits h LEFT JOIN (SELECT DISTINCT hit_id FROM gone) g ON g.hit_id = h.hit_id LEFT JOIN kept k ON k.hit_id = h.hit_id""",
    "p6_found": f"SELECT hit_id FROM search_hits JOIN chunk_configs ON config_name = chunk_config WHERE content IS NOT NULL AND len(regexp_extract_all(content, {_SPACES})) > chunk_size",
    "p8_clean": None,
}
SQL = {k: v for k, v in SQL.items() if v}
