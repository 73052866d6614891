"""Functions and operators against literal expectations."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions import names, text, urls
from larkspur.operators import chunking, concepts, context, corpus, diseases, entities, evaluation, expansion, fusion, incremental, lexical, positioning, sufficiency, vectors
from larkspur.plans import retrieval_queries


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_clean_text(spark):
    assert one(spark, '<p><span class="qt0">Cough</span> &amp; wheezing</p><ul><li>Asthma</li></ul>', text.clean_text) == "Cough & wheezing\nAsthma"
    assert one(spark, None, text.clean_text) is None and one(spark, "a\r\nb \t c", text.clean_markup) == "a\nb c"


def test_names(spark):
    assert one(spark, "  COPD Symptoms ", names.grouping_name) == "chronic obstructive pulmonary disease"
    assert one(spark, "Heart Failure Disease", names.grouping_name) == "heart failure"
    assert one(spark, "Acromegaly - Symptoms and causes", names.ranking_name) == "acromegaly"
    assert one(spark, "ENFERMEDAD\tDE  ADDISON", names.judged_name) == "enfermedad de addison" and one(spark, None, names.judged_name) == ""


def test_urls(spark):
    assert one(spark, "https://www.mayoclinic.org/foo", urls.source_of) == "mayoclinic.org" and one(spark, None, urls.source_of) == ""
    assert urls.strip_url("https://a.example/p?utm_source=x&b=1&c=#top") == "https://a.example/p?b=1&c="
    assert one(spark, "https://U@Host.example:80/x", urls.domain) == "u@host.example:80"
    assert one(spark, "https://a.example/x/pmc123.html", urls.slug_words) == "x" and one(spark, "https://a.example/", urls.slug_words) is None
    assert one(spark, "mailto:a@b", urls.is_denied) and one(spark, "https://a.example/Login", urls.is_denied) and not one(spark, "https://a.example/x", urls.is_denied)
    assert one(spark, "https://x.cdc.gov/a", lambda c: urls.within(c, ["cdc.gov"])) and not one(spark, "https://xcdc.gov/a", lambda c: urls.within(c, ["cdc.gov"]))


def test_title_case_and_preview(spark):
    assert one(spark, "o'neil 2nd", text.title_case) == "O'Neil 2Nd"
    assert one(spark, "ab " * 100, text.preview).endswith("ab...") and one(spark, "short", text.preview) == "short"


def test_min_max(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, None), (2, 1.0), (2, 3.0)], "query_id int, s double")
    got = [(r.query_id, r.s, r.y) for r in df.withColumn("y", positioning.min_max("s")).collect()]
    assert sorted(got, key=str) == sorted([(1, 2.0, 1.0), (1, 2.0, 1.0), (1, None, None), (2, 1.0, 0.0), (2, 3.0, 1.0)], key=str)


def test_freshness_and_authority(spark):
    df = spark.createDataFrame([("2026-04-01", None), (None, None), ("2020-01-01T00:00:00Z", None)], "updated string, published string")
    assert [r.y for r in df.select(positioning.freshness(["updated", "published"], "2026-05-01T00:00:00Z").alias("y")).collect()] == [1.0, 0.6, 0.4]
    df = spark.createDataFrame([("www.cdc.gov", None), (None, "https://nhs.uk/x"), ("a.example", None), (None, None)], "s string, u string")
    assert [r.y for r in df.select(positioning.authority("s", "u").alias("y")).collect()] == [0.95, 0.9, 0.55, 0.4]


def test_synonyms(spark):
    assert one(spark, "family history of migraines", expansion.expand_synonyms) == "family history of migraines"
    out = one(spark, "possible MI with chest pain", expansion.expand_synonyms)
    assert "myocardial infarction" in out and "heart attack" in out


def test_pseudo_relevance(spark):
    ranked = spark.createDataFrame([(1, 1, "myocardial troponin rise"), (1, 2, "troponin and myocardial injury")], "query int, rank int, text string")
    q = spark.createDataFrame([(1, "chest pain"), (2, "other")], "query int, text string")
    out = {r.query: r.expanded for r in expansion.pseudo_relevance(ranked, q, terms=3).collect()}
    assert out[1].startswith("chest pain ") and "myocardial" in out[1] and "troponin" in out[1] and out[2] == "other"


def test_fusion(spark):
    r = spark.createDataFrame([("q", "a", "x", 1, 9.0), ("q", "a", "y", 2, 3.0), ("q", "b", "y", 1, 0.5), ("q", "b", "z", 2, 0.1)], "query string, source string, item string, rank int, score double")
    assert [x["item"] for x in fusion.reciprocal_rank(r).orderBy("rank").collect()] == ["y", "x", "z"]
    assert [(x["item"], x["score"]) for x in fusion.borda(r).orderBy("rank").collect()] == [("y", 3.0), ("x", 2.0), ("z", 1.0)]
    assert [x["item"] for x in fusion.interleave(r, ["a", "b"]).orderBy("rank").collect()] == ["x", "y", "z"]
    assert [x["item"] for x in fusion.intersect(r, 2).collect()] == ["y"] and [x["item"] for x in fusion.negate(r, "a", "b").collect()] == ["x"]
    assert {x["item"]: x["score"] for x in fusion.weighted_sum(r, {"a": 0.5, "b": 0.5}).collect()}["y"] == pytest.approx(0.5 / 3 + 0.5, abs=1e-6)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, i + 1, [n]) for i, n in enumerate(["alpha", "beta", "gamma"])], "query int, rank int, aliases array<string>")
    qrels = spark.createDataFrame([(1, ["alpha", "beta", "xenon", "yttrium"]), (2, ["alpha"])], "query int, names array<string>")
    hits = evaluation.name_hits(ranked, qrels)
    m = {r["query"]: r for r in evaluation.metrics(hits, qrels.select("query", F.size("names").alias("n_relevant")), 3).collect()}
    assert m[1].recall == 0.5 and m[1].precision == pytest.approx(2 / 3) and m[1].reciprocal_rank == 1.0 and m[1].average_precision == 0.5
    assert m[2].recall == 0.0 and m[2].hit == 0
    mac = evaluation.macro(spark.createDataFrame([(1.0, None), (None, 0.5)], "p double, r double"), ["p", "r"]).first()
    assert (mac.p, mac.r) == (0.5, 0.25)


def test_fallout_counts_the_vectors_searched(spark, tmp_path):
    """1250 usable vectors, 1100 of them under one label; null, empty and zero vectors are not searched."""
    rows = [(i, "a" if i < 1100 else "b", [1.0, i / 1250]) for i in range(1250)] + [(1301, "b", None), (1302, "b", []), (1303, "b", [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    assert vectors.searched(v.withColumnRenamed("vec_id", "id")).first().corpus_size == 1250
    v.where("size(embedding) = 2 and vec_id < 1250").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {r["query"]: r for r in retrieval_queries.p01(spark, str(tmp_path)).collect()}
    assert out["1100"].precision < 1  # at the border of the labels, some of the ten are of the other
    for q, r in out.items():
        shown, relevant = 10 * (1 - r.precision), 1099 if int(q) < 1100 else 149
        assert r.fallout == pytest.approx(shown / (1250 - relevant), abs=1e-6)
    assert retrieval_queries.f17(spark, str(tmp_path)).first().fallout == pytest.approx(sum(r.fallout for r in out.values()) / len(out), abs=1e-6)


def test_name_matching(spark):
    ok = lambda r, e: spark.createDataFrame([(r, e)], "r string, e string").select(text.is_match(text.name_tokens("r"), text.name_tokens("e")).alias("m")).first().m
    assert ok("Hemolytic anemia due to G6PD", "Hemolytic anemia") and ok("pancreatitis attack", "acute pancreatitis") and not ok("acute bronchitis", "acute pancreatitis") and not ok("x", "")


def test_diversify_prefers_difference_when_asked(spark):
    rows = [("pneumonia", 0.95, 0, ["A"], ["s"], "lung infection cough"), ("covid", 0.93, 1, ["A"], ["s"], "lung infection cough"), ("fracture", 0.74, 2, ["B"], ["t"], "bone break")]
    g = spark.createDataFrame([(1, k, k, *r) for k, *r in rows], "query_id int, group_key string, disease string, relevance double, position int, concepts array<string>, sources array<string>, _text string")
    pick = lambda t: [r.group_key for r in positioning.diversify(g, 2, t).orderBy("rank").collect()]
    assert pick(0.5) == ["pneumonia", "fracture"] and pick(0.95) == ["pneumonia", "covid"]


def _mmr(groups, top, trade):
    """Over all groups, as the definition has it; groups: (key, disease, relevance, position, concepts, sources, words)."""
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    like = lambda a, b: 1.0 if a[1] == b[1] else min(1.0, 0.5 * jac(a[4], b[4]) + 0.3 * jac(a[6], b[6]) + 0.2 * jac(a[5], b[5]))
    left, chosen = sorted(groups, key=lambda g: (-g[2], g[3])), []
    while left and len(chosen) < top:
        value = lambda g: trade * g[2] - (1 - trade) * max(like(g, c) for c, _ in chosen) if chosen else g[2]
        best = max(left, key=lambda g: (value(g), g[2], -g[3]))
        chosen.append((best, round(value(best), 6)))
        left.remove(best)
    return [(g[0], v, n + 1) for n, (g, v) in enumerate(chosen)]


@pytest.mark.parametrize("local", [1000, 50])
def test_diversify_chooses_among_all_groups_of_a_hot_query(spark, local):
    """300 groups of one hot query: the 250 most relevant are alike, and what differs from them comes after."""
    rows = [(f"g{i:03}", f"g{i:03}", round(0.95 - i / 10000, 6), i, ["A", "B"], ["s"], f"lung infection cough w{i % 3}xx") for i in range(250)]
    rows += [(f"g{i:03}", f"g{i:03}", round(0.90 - i / 5000, 6), i, [f"C{i % 7}"], [f"t{i % 5}"], f"bone break number{i % 11}") for i in range(250, 300)]
    small = [("a", "a", 0.9, 0, ["A"], ["s"], "lung cough"), ("b", "b", 0.1, 1, [], [], "")]
    g = spark.createDataFrame([(q, *r) for q, l in ((1, rows), (2, small)) for r in l], "query_id int, group_key string, disease string, relevance double, position int, concepts array<string>, sources array<string>, _text string").repartition(3)
    out = positioning.diversify(g, local=local).collect()
    for q, l in ((1, rows), (2, small)):
        want = _mmr([(*r[:4], set(r[4]), set(r[5]), {w for w in r[6].split() if len(w) >= 3}) for r in l], 10, 0.8)
        assert sorted(((r.group_key, r.mmr, r["rank"]) for r in out if r.query_id == q), key=lambda r: r[2]) == want
    assert sum(r.group_key >= "g100" for r in out if r.query_id == 1) > 5


def test_evidence_drops_near_copies(spark):
    c = spark.createDataFrame([(1, "g", f"c{i}", i, t, 0.9 - i / 10, "a.example", None, "Symptoms") for i, t in enumerate(["one two three four", "one two three four", "other words here"])], "query_id int, group_key string, chunk_id string, position int, text string, ce double, source_domain string, url string, section_heading string")
    assert [r.chunk_id for r in positioning.select_evidence(c).orderBy("place").collect()] == ["c0", "c2"]


def test_sufficiency(spark):
    good = [(1, i, f"d{i}", f"s{i}.example", "cough and fever", 0.9) for i in (1, 2, 3, 4)]
    r = spark.createDataFrame(good, "query_id int, rank int, doc_id string, source_domain string, text string, score double")
    q = spark.createDataFrame([(1, ["cough", "fever"]), (2, [])], "query_id int, terms array<string>")
    out = {x.query_id: x for x in sufficiency.assess(r, q).collect()}
    assert out[1].sufficient and out[1].failed == [] and not out[2].sufficient and out[2].failed == ["no_local_results"] and out[2].insufficiency == 1.0


def test_conditions(spark):
    ner = [[("Asthma", "PROBLEM", 0, 6, 0.9)], [("pain", "PROBLEM", 0, 4, 0.99)], []]
    rows = [("q", i, f"c{i}", t, None, "Overview", n) for i, (n, t) in enumerate(zip(ner, ["x", "Heart failure - Symptoms", None]))]
    df = spark.createDataFrame(rows, f"query string, position int, chunk_id string, title string, url string, heading string, ner {entities.ENTITY}")
    assert [(r.disease, r.rank, r.from_ner) for r in diseases.aggregate(df).orderBy("rank").collect()] == [("asthma", 1, True), ("heart failure", 2, False)]


def test_entities(spark):
    df = spark.createDataFrame([([("a b", "PROBLEM", 0, 5, 0.6), ("b", "PROBLEM", 3, 8, 0.9), ("c", "TEST", 10, 12, 0.7)],)], f"ner {entities.ENTITY}")
    assert [e.start_char for e in df.select(entities.without_overlaps("ner").alias("e")).first().e] == [3, 10]
    assert entities.merge_adjacent([(0, 4, "P"), (5, 9, "P"), (11, 12, "T")], "aaaa bbbb. c") == [(0, 9, "P"), (11, 12, "T")]
    tag = entities.gazetteer_tagger({"fever": "PROBLEM"})
    assert spark.createDataFrame([("high Fever now",), (None,)], "t string").select(tag("t").alias("e")).collect()[0].e[0].start_char == 5


def test_concepts(spark):
    assert one(spark, "Sudden chest pain and febrile, no fever", concepts.extract) == ["CHEST_PAIN", "FEVER"] and one(spark, None, concepts.extract) == []
    assert one(spark, "tiene fiebre", concepts.by_alias) == ["FEVER"]


def test_chunk_ids(spark):
    docs = spark.createDataFrame([("doc1", (["S1", "S2"],))], "doc_id string, x struct<a:array<string>>").select("doc_id", F.struct(F.array(F.struct(F.lit("S1").alias("heading"), F.lit(("p" * 900 + "\n\n") * 3).alias("text")), F.struct(F.lit("S2").alias("heading"), F.lit("y" * 60).alias("text")), F.struct(F.lit("Related").alias("heading"), F.lit("y" * 60).alias("text"))).alias("sections")).alias("content"))
    got = sorted((r.chunk_id, r.chunk_index) for r in chunking.chunk_documents(docs, ["doc_id"]).collect())
    assert got == [("doc1:0:0", 0), ("doc1:0:1", 1), ("doc1:1:0", 0)]
    assert chunking.sentences("Hi. This is a sentence that is long enough. No.") == ["Hi. This is a sentence that is long enough. No."]
    assert chunking.semantic_pieces("", lambda s: s) == []


def test_context(spark):
    cut = lambda t, n: spark.range(1).select(context.shorten(F.lit(t), n).alias("t")).first().t
    assert cut("abc def", 100) == "abc def" and cut("word " * 100, 50) == ("word " * 10).strip() and cut("x" * 60, 50) == "x" * 50
    assert cut("one two ! three four", 15) == "one two !" and cut("aaaaaaaaaaaa b cccccc", 16) == "aaaaaaaaaaaa b"
    ranked = spark.createDataFrame([(1, i, f"c{i}", "d1" if i < 4 else "d2", "some text " * 200) for i in range(1, 6)] + [(1, 6, "c6", "d3", " ")], "query_id int, rank int, chunk_id string, doc_id string, text string")
    got = [(r.block, r.chunk_id) for r in context.build_context(ranked).orderBy("block").collect()]
    assert got == [(1, "c1"), (2, "c2"), (3, "c4"), (4, "c5")]
    v = spark.createDataFrame([("HR 92, BP: 120/80, Temp 101.3 F, SpO2 97%",)], "t string").select(context.vitals("t").alias("v"), context.demographics(F.lit("a 45-year-old woman")).alias("p")).first()
    assert (v.v.heart_rate, v.v.systolic, v.v.diastolic, v.v.spo2, v.v.temperature) == (92, 120, 80, 97, 38.5) and (v.p.age, v.p.sex) == (45, "female")


def test_keyed_tables(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(incremental.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(incremental.delete(old, new, ["k"]).collect()) == [(1, "a")]
    log = spark.createDataFrame([(1, 1, "yes"), (1, 2, "gone"), (2, 1, "yes")], "k int, t int, kind string").withColumn("s", F.col("t"))
    assert [r.k for r in incremental.current_votes(log, ["k"], "t", "s", "kind", "gone").collect()] == [2]
    assert sorted(corpus.first_by_key(spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, n int"), ["k"], ["n"]).collect(), key=str) == sorted([("a", 1), (None, 3), (None, 4)], key=str)


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, embedding array<float>")
    assert [(r["query"], r["item"], r["rank"]) for r in vectors.top_similar(v.where("id = 'a'"), v, 2).orderBy("rank").collect()] == [("a", "b", 1), ("a", "c", 2)]
    assert vectors.top_similar(v.limit(0), v, 2).count() == 0


def test_lexical_every_term_and_highlight(spark):
    d = spark.createDataFrame([(1, "red fever"), (2, "fever"), (3, None)], "doc int, t string")
    p = lexical.postings(d, "doc", "t", "t")
    q = lexical.query_terms(spark.createDataFrame([(7, "red fever")], "q int, t string"), "q", "t")
    assert {r.doc for r in lexical.bm25(p, q, lexical.field_sizes(p)).collect()} == {1, 2}
    assert {r.doc for r in lexical.bm25(p, q, lexical.field_sizes(p), every_term=True).collect()} == {1}
    assert spark.range(1).select(lexical.highlight(F.lit("a Fever came"), F.array(F.lit("fever"))).alias("h")).first().h == "<em>Fever</em> came"


def test_contract_names():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 90
    json.dumps(s)
