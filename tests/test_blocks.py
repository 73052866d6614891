"""Search by blocks of documents: equal to scores of all pairs, which are neither made by Spark nor shuffled."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import blocks, lexical, search, vectors
from larkspur.plans import registry

FIELDS = {"title": 3.0, "text": 1.0}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(i, None if i % 7 == 0 else f"{words[i % 40]} common", None if i % 11 == 0 else " ".join(words[(i * j) % 40] for j in range(1, 2 + i % 9)) + " rare" * (i == 5)) for i in range(400)]
    asked = [(q, f"common {words[q % 40]} {words[q * 3 % 40]} unknown{q % 2}" if q % 3 else words[q % 40]) for q in range(300)] + [(900, "nothing known"), (901, ""), (902, "rare")]
    return spark.createDataFrame(docs, "doc int, title string, text string").repartition(3), spark.createDataFrame(asked, "query int, text string")


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK", 50), ("WIDTH", 120), ("PACK", 20), ("ROWS", 7)):
        monkeypatch.setattr(blocks, name, value)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def parts(spark, corpus):
    docs, q = corpus
    post = lexical.postings(docs, "doc", "title", "title").unionByName(lexical.postings(docs, "doc", "text", "text")).cache()
    return post, lexical.field_sizes(post).cache(), lexical.query_terms(q, "query", "text")


def test_hits_are_those_of_all_pairs(spark, corpus, parts, small):
    post, sizes, terms = parts
    want = lexical.bm25(post, terms, sizes, FIELDS).groupBy("query").agg(F.count("*").alias("hits"))
    assert rows(search.Index.build(corpus[0], "doc", list(FIELDS)).hits(terms)) == rows(want)


def test_total_hits_score_no_pair(spark, monkeypatch):
    monkeypatch.setattr(lexical, "score", None)
    assert registry.queries()["f02_total_hits"](spark, SF).count() > 0


def shuffled(spark):
    """Records written to shuffles in this application so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def of_query(spark, name, sf):
    """Records that a query of this project shuffles."""
    run = registry.queries()[name]
    run(spark, sf).count()  # the index is stored by now
    before = shuffled(spark)
    run(spark, sf).count()
    return shuffled(spark) - before


def test_best_are_those_of_all_pairs(spark, corpus, parts, small):
    post, sizes, terms = parts
    want = lexical.top_k(lexical.bm25(post, terms, sizes, FIELDS), 5).select("query", "doc", "score", "rank")
    assert rows(search.Index.build(corpus[0], "doc", list(FIELDS)).top(terms, FIELDS, 5)) == rows(want)


def test_ties_of_text_keys_and_of_packs_over_several_parts(spark, corpus, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", "same words") for i in range(300)], "doc string, text string").repartition(3)
    terms = lexical.query_terms(spark.createDataFrame([(1, "same")], "q int, t string"), "q", "t")
    monkeypatch.setattr(blocks, "BLOCK", 40)
    assert [r["doc"] for r in search.Index.build(docs, "doc", ["text"]).top(terms, {"text": 1.0}, 4).orderBy("rank").collect()] == ["d0", "d1", "d10", "d100"]
    assert search.Index.build(docs, "doc", ["text"]).top(terms.where("term = 'none'"), {"text": 1.0}, 4).count() == 0


def test_topk_shuffles_no_pairs(spark):
    sf = "/root/testdata/sf0.01"  # 1 000 documents, 200 queries
    assert of_query(spark, "j01_bm25_topk", sf) < 30_000


def test_vectors_are_those_of_all_pairs(spark, corpus, small):
    docs, q = corpus[0].select("doc", F.col("title").alias("text")), corpus[1]
    v = lambda df, key: df.select(F.col(key).alias("id"), search.embed("text").alias("embedding"))
    want = vectors.top_similar(v(q, "query"), v(docs, "doc"), 6, 0.3, same_ids=False).select(F.col("query").cast("int"), F.col("item").cast("int"), "score", "rank")
    assert rows(search.semantic(q, docs, 6, 0.3)) == rows(want)


def test_hybrid_asks_for_the_same_words_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i} red", f"red fever {i}") for i in range(60)], "doc int, title string, text string")
    index, sent = search.Index.build(docs, "doc", list(FIELDS)), []
    similar = blocks.similar
    monkeypatch.setattr(blocks, "similar", lambda v, sets, *a: sent.append(len(sets)) or similar(v, sets, *a))
    q = spark.createDataFrame([(i, "Red fever" if i % 2 else "fever, red") for i in range(50)], "query int, text string")
    assert search.hybrid(index, q, docs.select("doc", F.col("title").alias("text")), FIELDS, top=10).count() == 500 and sent == [1]


def test_rerank_gives_shares_and_moves_asked_words_only(spark):
    texts = spark.createDataFrame([(1, "a b b " + "x " * 50), (2, None), (3, "c")], "item int, text string")
    found = spark.createDataFrame([(7, 1, 2), (7, 2, 1), (7, 3, 3), (7, 4, 4), (8, 3, 1), (9, 1, 1), (10, 1, 1)], "query int, item int, rank int")
    q = spark.createDataFrame([(7, "A b c d"), (8, "c c"), (9, ""), (11, "a")], "query int, text string")
    want = [(7, 1, 2, 0.5, 1), (7, 2, 1, 0.0, 3), (7, 3, 3, 0.25, 2), (8, 3, 1, 1.0, 1), (9, 1, 1, 0.0, 1)]
    assert rows(search.rerank(found, q, texts, 3)) == want


def test_two_stage_reranks_the_same_words_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i} red", f"red fever {i}") for i in range(60)], "doc int, title string, text string")
    index, seen = search.Index.build(docs, "doc", list(FIELDS)), []
    rerank = search.rerank
    monkeypatch.setattr(search, "rerank", lambda c, q, *a: seen.append(q.count()) or rerank(c, q, *a))
    q = spark.createDataFrame([(i, "Red fever" if i % 2 else "fever, red") for i in range(50)], "query int, text string")
    titles, texts = docs.select("doc", F.col("title").alias("text")), docs.select(F.col("doc").alias("item"), "text")
    assert search.two_stage(index, q, q, titles, texts, FIELDS).groupBy("query").count().where("count = 10").count() == 50 and seen == [1]


def test_every_term_is_that_of_all_pairs(spark, corpus, parts, small, monkeypatch):
    post, sizes, terms = parts
    want = lexical.top_k(lexical.bm25(post, terms, sizes, FIELDS, every_term=True), 5).select("query", "doc", "score", "rank")
    got = rows(search.Index.build(corpus[0], "doc", list(FIELDS)).top(terms, FIELDS, 5, every_term=True))
    assert got and got == rows(want)
    monkeypatch.setattr(lexical, "score", None)
    assert registry.queries()["j01_bm25_every_term"](spark, SF).count() > 0


def test_tags_add_to_documents_with_and_without_terms(spark, corpus, parts, small, monkeypatch):
    post, sizes, terms = parts
    docs = corpus[0].withColumn("tags", F.when(F.col("doc") % 9 == 0, F.array(F.lit("A"), F.lit("B"))).when(F.col("doc") % 9 == 1, F.array(F.lit("B"))))
    tags = spark.createDataFrame([(3, "A"), (3, "B"), (4, "B"), (901, "A"), (5, "C")], "query int, term string")
    owned = docs.select("doc", F.col("tags").alias("concepts"))
    asking = tags.groupBy("query").agg(F.collect_set("term").alias("concepts"))
    want = lexical.top_k(lexical.concept_boost(lexical.bm25(post, terms, sizes, FIELDS), owned, asking), 60).select("query", "doc", "score", "rank")
    assert rows(search.Index.build(docs, "doc", list(FIELDS), "tags").top(terms, FIELDS, 60, tags=tags)) == rows(want)
    monkeypatch.setattr(lexical, "score", None)
    assert registry.queries()["j02_concept_boost"](spark, SF).count() > 0


def test_paging_goes_on_where_the_page_before_ends(spark, corpus, parts, small, monkeypatch):
    post, sizes, terms = parts
    want = lexical.top_k(lexical.bm25(post, terms, sizes, FIELDS), 4, offset=3).select("query", "doc", "score", "rank")
    assert rows(search.Index.build(corpus[0], "doc", list(FIELDS)).top(terms, FIELDS, 4, 3)) == rows(want)
    monkeypatch.setattr(lexical, "score", None)
    assert registry.queries()["g04_paging"](spark, SF).count() > 0


def test_highlights_score_no_pair(spark, monkeypatch):
    monkeypatch.setattr(lexical, "score", None)
    assert registry.queries()["j05_highlights"](spark, SF).where("fragment LIKE '%<em>%'").count() > 0
