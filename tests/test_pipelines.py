"""Two-stage search, feedback, enrichment, charts, crawls and runs on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import charts, chunking, enrichment, entities, evaluation, feedback, lexical, positioning, search, vectors
from larkspur.sources import crawl, runs

ENT = "array<struct<text:string,label:string,start_char:int,end_char:int,score:double>>"


def test_index_gives_the_scores_of_postings(spark):
    docs = spark.createDataFrame([(1, "red fever", "long text on red fever and more"), (2, None, "fever"), (3, "blue", None), (4, "", "")], "doc int, title string, text string")
    q = spark.createDataFrame([(7, "red fever"), (8, "nothing here"), (9, "")], "query int, text string")
    index, boosts = search.Index.build(docs, "doc", ["title", "text"]), {"title": 3.0, "text": 1.0}
    terms = lexical.query_terms(q, "query", "text")
    post = lexical.postings(docs, "doc", "title", "title").unionByName(lexical.postings(docs, "doc", "text", "text"))
    rows = lambda df: sorted((r["query"], r["doc"], round(r["score"], 9)) for r in df.collect())
    assert rows(index.scores(terms, boosts)) == rows(lexical.bm25(post, terms, lexical.field_sizes(post), boosts)) and {r[1] for r in rows(index.scores(terms, boosts))} == {1, 2}
    assert {r[1] for r in rows(index.scores(terms, boosts, every_term=True))} == {1}


def test_two_stage_asks_with_the_expansion_and_reranks_with_the_query(spark):
    docs = spark.createDataFrame([(1, "heart attack", "heart attack in adults"), (2, "mi", "mi mi mi"), (3, "knee", "mi and knee pain")], "doc_id int, title string, text string")
    asked = spark.createDataFrame([(1, "mi pain")], "query int, text string")
    expanded = spark.createDataFrame([(1, "mi pain heart attack")], "query int, text string")
    index = search.Index.build(docs, "doc_id", ["title", "text"])
    titles, texts = docs.selectExpr("doc_id as doc", "title as text"), docs.selectExpr("doc_id as item", "text")
    run = lambda gone=None: [(r["item"], r["score"]) for r in search.two_stage(index, asked, expanded, titles, texts, {"title": 3.0, "text": 1.0}, excluded=gone).orderBy("rank").collect()]
    got = run()
    assert got[0] == (3, 1.0) and {i for i, _ in got} == {1, 2, 3} and dict(got)[1] == 0.0
    assert {i for i, _ in run(spark.createDataFrame([(1, 3)], "query int, item int"))} == {1, 2}


def test_match_all_and_requests(spark):
    docs = spark.createDataFrame([(i, ["FEVER"] if i % 2 else []) for i in range(30)], "doc int, concepts array<string>")
    q = spark.createDataFrame([(1, " ", ["FEVER"]), (2, None, []), (3, "words", ["FEVER"])], "query int, text string, concepts array<string>")
    got = {}
    for r in search.match_all(docs, q, 3).collect():
        got.setdefault(r["query"], []).append(r.doc)
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 3, 5], 2: [0, 1, 2]}
    assert docs.where(search.request(docs, {})).count() == 30 and docs.where(search.request(docs, {"a": F.col("doc") < 5, "b": F.size("concepts") > 0})).count() == 2
    assert [r["query_id"] for r in search.by_session(spark.createDataFrame([(2,), (1,)], "query_id int"))] == [1, 2]


def test_vectors_keep_ties_by_id_and_pool(spark):
    v = spark.createDataFrame([(str(i), [1.0, 0.0]) for i in range(9)] + [("q", [1.0, 0.1])], "id string, embedding array<float>")
    assert [r["item"] for r in vectors.top_similar(v.where("id = 'q'"), v, 3).orderBy("rank").collect()] == ["0", "1", "2"]
    row = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0]],)], "v array<array<double>>").select(search.pool("v").alias("m"), search.pool("v", "max").alias("x"), search.pool("v", "cls").alias("c")).first()
    assert row.m == pytest.approx([0.6, 0.8]) and row.x == pytest.approx([0.6, 0.8]) and row.c == [1.0, 0.0]
    e = spark.createDataFrame([("a b",), ("",), (None,)], "t string").select(search.embed("t").alias("e")).collect()
    assert sum(x * x for x in e[0].e) == pytest.approx(1.0) and e[1].e is None and e[2].e is None


def test_feedback(spark):
    cols = "vote_id int, session_id string, query string, chunk_id string, doc_id string, kind string, created_at int"
    votes = spark.createDataFrame([(1, "s", "q", "c", "d", "yes", 1), (2, "s", "q", "c", "d", "retract", 2), (3, "s", "q", "c2", "d", "yes", 1), (4, " ", "q", "c", "d", "yes", 1), (5, "s", "q", None, "d", "yes", 1)], cols)
    assert [r.vote_id for r in feedback.current(votes).collect()] == [3]
    assert {r.vote_id: r.missing for r in feedback.split_valid(votes)[1].collect()} == {4: "session_id", 5: "chunk_id"}
    steps = {"synonym": spark.createDataFrame([(1, "mi", "mi heart attack"), (2, "x", "x")], "query int, text string, expanded string")}
    log = feedback.expansion_log(steps, spark.createDataFrame([(1, "s")], "query int, session_id string")).collect()
    assert [(r.session_id, r.original, r.expanded, r.strategy) for r in log] == [("s", "mi", "mi heart attack", "synonym")]
    judged = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "b", False)], "query int, chunk string, relevant boolean")
    assert [r.item for r in feedback.excluded(judged).collect()] == ["b"]


def test_groups_by_conditions_then_title_then_document(spark):
    rows = [
        (1, "c1", "doc-a", "Asthma Symptoms", None, None, 0, [("COPD", "PROBLEM", 0, 4, 0.9), ("copd", "PROBLEM", 9, 13, 0.8), ("Asthma", "PROBLEM", 20, 26, 0.95), ("cough", "TEST", 0, 1, 0.9)]),
        (1, "c2", "doc-a", "Asthma Symptoms", None, None, 1, [("flu", "PROBLEM", 0, 3, 0.2)]),
        (1, "c3", "doc-only", None, " ", "http://h.example/", 2, None),
        (1, "c4", "d4", None, None, "http://h.example/x/heart-failure.html", 3, []),
    ]
    c = spark.createDataFrame(rows, f"query_id int, chunk_id string, doc_id string, title string, section_heading string, url string, position int, ner {ENT}")
    got = {(r.chunk_id, r.group_key): (r.disease, r.display) for r in positioning.group_rows(c, "ner").collect()}
    assert got == {
        ("c1", "asthma"): ("asthma", "Asthma"), ("c1", "chronic obstructive pulmonary disease"): ("chronic obstructive pulmonary disease", "COPD"), ("c2", "__doc_title__asthma"): ("asthma", "Asthma Symptoms"),
        ("c3", "__doc_id__doc-only"): ("doc only", "doc only"), ("c4", "__doc_id__d4"): ("heart failure", "heart failure"),
    }
    assert {r.group_key for r in positioning.group_rows(c.drop("ner")).collect()} == {"__doc_title__asthma", "__doc_id__doc-only", "__doc_id__d4"}


def test_explanations(spark):
    rows = [(0.8, 0.9, ["fever"], ["a.example"], 3, 0.5), (0.5, 0.9, [], [], 1, None), (0.1, 0.1, [], ["a.example"], 1, 0.0)]
    df = spark.createDataFrame(rows, "cross_encoder double, authority double, matched array<string>, sources array<string>, evidences int, mmr double")
    assert [len(r.e) for r in df.select(positioning.explanation().alias("e")).collect()] == [5, 1, 1]


def test_merged_spans(spark):
    df = spark.createDataFrame([(1, "high fever. and cough", [("high", "PROBLEM", 0, 4, 0.9), ("fever", "PROBLEM", 5, 10, 0.9), ("and", "PROBLEM", 12, 15, 0.9), ("cough", "TEST", 16, 21, 0.9)]), (2, None, None), (3, "x", [])], f"k int, t string, n {ENT}")
    assert sorted((r.k, r.label, r.start_char, r.end_char, r.spans) for r in entities.merged_spans(df, "k", "n", "t").collect()) == [(1, "PROBLEM", 0, 10, 2), (1, "PROBLEM", 12, 15, 1), (1, "TEST", 16, 21, 1)]


CHART = "Chief complaint: chest pain\nHPI: 58yo M, cough; fever\nVitals: T 101.3, HR 92, BP 120/80, SpO2 97%\nMedications: aspirin, insulin\nAllergies: penicillin\nPMH: asthma; gout\nLabs: troponin high\nok"


def test_charts(spark):
    df = spark.createDataFrame([(1, CHART), (2, "just a note"), (3, None), (4, "CC: pain\nAllergies: NKDA\n## End"), (5, "")], "id int, text string")
    parsed = charts.parse(df).withColumn("serial", charts.serialise())
    got = {r.id: r for r in parsed.collect()}
    c = got[1].chart
    assert c.chief_complaint == "chest pain" and c.symptoms == ["chest pain 58yo m", "cough", "fever"] and c.medications == ["aspirin", "insulin"] and c.allergies == ["penicillin"]
    assert (c.person.age, c.person.sex, c.person.comorbidities) == (58, "male", ["asthma", "gout"]) and c.vitals.temperature == 38.5 and c.lab_results == "troponin high\nok"
    assert got[1].serial.startswith("## Demographics\n58yo | M | PMH: asthma, gout\n## Chief Complaint\nchest pain") and "T 38.5°C, HR 92, BP 120/80, SpO2 97%" in got[1].serial
    assert got[2].chart.notes == "just a note" and got[4].chart.allergies == [] and got[4].chart.chief_complaint == "pain"
    full = parsed.where("id = 1").select(charts.prompt("serial", charts.entities(F.lit(None).cast(ENT)), F.array(F.struct(F.lit(1).alias("rank"), F.lit("Angina").alias("name"), F.lit(2).alias("evidence"))), F.lit(None), F.lit(" ")).alias("p")).first().p
    assert full.count("### ") == 5 and "1. Angina (evidence chunks: 2)" in full and charts.NO_EVIDENCE in full and full.endswith(charts.NO_QUESTION)
    assert charts.answer(spark.createDataFrame([(1, 2, "Second. x"), (1, 1, "First one. y")], "query_id int, block int, text string")).first().answer == "First one. [CHUNK 1] Second. [CHUNK 2]"


def test_enrichment(spark):
    rows = [("chest pain and cough", [("knee", "ANATOMY", 9, 13, 0.9), ("Knee", "ANATOMY", 20, 24, 0.9), ("hip", "PROBLEM", 2, 5, 0.3)]), ("chest pain and cough", None), ("a, b and c", [])]
    got = [r.t for r in spark.createDataFrame(rows, f"q string, n {ENT}").select(enrichment.asked_terms("q", "n").alias("t")).collect()]
    assert got == [["knee"], ["CHEST_PAIN"], ["a", "b", "c"]]
    sec = "array<struct<heading:string,text:string>>"
    ext = spark.createDataFrame(
        [("q1", "pubmed", "http://h.example/a", "T", "An abstract", [("Journal", "J")], ["A", "B"], None), ("q1", "pubmed", "http://h.example/b", "Only a title", " ", [("Journal", "J")], [], "es"), ("q1", "x", "http://h.example/c", "T", None, [("Causes", "because")], [], "es")],
        f"query_hash string, source string, url string, title string, abstract string, sections {sec}, authors array<string>, language string",
    )
    got = {r.url[-1]: r for r in enrichment.to_acquired(ext, F.lit("2024-01-01T00:00:00Z")).collect()}
    assert set(got) == {"a", "c"} and got["a"].crawl.seed_group == "api_pubmed" and got["a"].page_meta.author == "A, B" and got["a"].page_meta.language == "en" and got["c"].content.body == "Causes\nbecause"
    n = enrichment.retrieval_counts(ext, spark.createDataFrame([("q1", "slow"), ("q2", "slow")], "query_hash string, source string"))
    assert {(r.query_hash, r.total, tuple(r.failed)) for r in n.collect()} == {("q1", 3, ("slow",)), ("q2", 0, ("slow",))}
    names = spark.createDataFrame([("MI ",), ("gout",), (None,)], "name string")
    assert [r.canonical for r in enrichment.canonical_name(names, spark.createDataFrame([("mi", "myocardial infarction")], "alias string, preferred string")).collect()] == ["myocardial infarction", "gout", None]
    good, rest = enrichment.route(spark.createDataFrame([(1, True), (2, False), (3, None)], "q int, sufficient boolean"))
    assert [r.q for r in good.collect()] == [1] and [r.q for r in rest.collect()] == [2, 3]
    assert spark.range(1).select(enrichment.own_label(F.lit("Sign_symptom")).alias("a"), enrichment.own_label(F.lit("?")).alias("b")).first() == ("SYMPTOM", None)


def test_dates(spark):
    rows = [("on 2020-03-04T05:06:07Z",), ("March 5, 2021",), ("seen 7 Oct 2019 again",), ("2020-02-31",), ("soon",), (None,), ("3/9/2018",)]
    assert [r.d for r in spark.createDataFrame(rows, "t string").select(text.normalize_date("t").alias("d")).collect()] == ["2020-03-04T05:06:07", "2021-03-05T00:00:00", "2019-10-07T00:00:00", None, None, None, "2018-03-09T00:00:00"]


def test_windows_of_paragraphs():
    paras = [("abcdefghij"[i] * n) for i, n in enumerate((30, 30, 30, 90, 5, 5))]
    whole = "\n\n".join(paras)
    pieces = [p for _, _, p in chunking.window_pieces(whole, 70, 35)]
    assert pieces == ["\n\n".join(paras[a:b]) for a, b in ((0, 2), (1, 3), (2, 4), (4, 6))]
    assert chunking.window_pieces("", 70, 35) == [(0, 0, "")] and chunking.window_pieces("x" * 200, 70, 35)[0][2] == "x" * 200


def test_semantic_pieces_have_their_places():
    a = ["The heart pumps blood through the body every minute.", "The heart has four chambers and pumps blood all day.", "Blood leaves the heart by the great vessels of the body."]
    b = ["Stock prices fell on Monday after the bank report.", "The bank report said that stock prices fell again.", "Prices of stock may fall after another bank report."]
    doc = "  ".join(a + b)
    pieces = chunking.semantic_pieces(doc, chunking.hashed_vectors, least_chars=20)
    assert " ".join(p for _, _, p in pieces) == " ".join(a + b) and all(" ".join(doc[x:y].split()) == p for x, y, p in pieces)
    assert chunking.sentence_groups([0.9, 0.9, 0.1, 0.9, 0.9, 0.9], 7) == [0, 3] and chunking.sentence_groups([0.9] * 40, 41) == [0, 19, 39]
    assert len(chunking.sentences("word one two three four five six seven. " * 20)) == 20  # no capital follows, but the whole is too long


def test_crawl_and_waiting_times(spark):
    web = {"http://a.example/": ["http://a.example/1", "http://b.example/1", "http://a.example/bad"], "http://a.example/1": ["http://a.example/", "http://a.example/2"], "http://b.example/1": [], "http://a.example/2": ["http://a.example/3"]}

    def fetch(url):
        if url.endswith("bad"):
            raise OSError("gone")
        return 200, "Text/HTML; charset=x", " ".join(web.get(url, []))

    def links(pages):
        return pages.select(F.explode(F.filter(F.split("html", " "), lambda x: x != "")).alias("l"), "*").select(F.col("l").alias("url"), (F.col("depth") + 1).alias("depth"), F.col("url").alias("parent_url"), "seed_id", "seed_group")

    seeds = spark.createDataFrame([("http://a.example/", 0, None, "s", "g")], "url string, depth int, parent_url string, seed_id string, seed_group string")
    kept, counts = crawl.crawl(seeds, fetch, links, ~F.col("url").endswith("3"), 3, 100)
    assert sorted(r.url for r in kept.collect()) == ["http://a.example/", "http://a.example/1", "http://a.example/2", "http://b.example/1"] and {r.mime_type for r in kept.collect()} == {"text/html"}
    assert [(r.fetched, r.failed, r.kept) for r in counts.collect()] == [(5, 1, 4)]
    assert crawl.crawl(seeds, fetch, links, F.lit(True), 3, 2)[0].count() == 2
    f = spark.createDataFrame([("http://a.example/1", 0), ("http://a.example/2", 0), ("http://b.example/1", 0)], "url string, depth int")
    at = {r.url[-11:]: r.not_before for r in crawl.fetch_times(f, 1.5).collect()}
    assert at["a.example/2"] - at["a.example/1"] == dt.timedelta(seconds=1.5) and at["b.example/1"] == at["a.example/1"]


def test_runs(spark, tmp_path, monkeypatch):
    store = runs.RunStore(spark, str(tmp_path / "runs"))
    assert store.ids() == [] and store.get("r1") is None and not store.delete("r1")
    store.save("r1", spark.range(3))
    store.save("r2", spark.range(2))
    assert store.ids() == ["r1", "r2"] and store.get("r1").count() == 3 and store.delete("r1") and store.ids() == ["r2"]
    with pytest.raises(ValueError):
        store.save("../x", spark.range(1))
    rows = spark.createDataFrame([(1, "t"), (2, None)], "id int, title string")
    runs.write_report(rows.agg(F.count("*").alias("n")), rows, "case when title is null then 'no title' end", str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep" / "bad")).first().problem == "no title" and spark.read.json(str(tmp_path / "rep" / "report")).first().n == 2
    tables = {"two": f"{tmp_path}/runs/run=r2", "none": str(tmp_path / "none")}
    assert {r.name: r.rows for r in runs.index_sizes(spark, tables).collect()} == {"two": 2, "none": 0}
    assert runs.reset(spark, tables) == ["two"] and runs.reset(spark, tables) == []
    (tmp_path / "c.toml").write_text('max_depth = 5\nseeds = ["http://a.example/"]\n')
    monkeypatch.setenv("LARKSPUR_MAX_DOCS", "7")
    s = runs.CrawlSettings.load(str(tmp_path / "c.toml"))
    assert (s.max_depth, s.max_docs, s.delay_seconds, s.seeds) == (5, 7, 1.0, ["http://a.example/"])
    page = "# Cases\n## One\n> chest pain\n> now\n- **Top-1**: Angina\n## Two\n```text\nfever\nrash\n```\nExpected: Measles\n## Three\nnothing\n"
    assert [tuple(r) for r in runs.test_cases(spark, page).collect()] == [("chest pain", "Angina"), ("fever rash", "Measles")]


def test_modes_and_answers(spark):
    q = lambda m, i: (m, i)
    hits = spark.createDataFrame([(q("a", 1), 1, True), (q("a", 2), 1, False), (q("b", 1), 2, True)], "query struct<mode:string,query_id:int>, rank int, hit boolean")
    asked = spark.createDataFrame([(q(m, i), 1) for m in "ab" for i in (1, 2)], "query struct<mode:string,query_id:int>, n_relevant int")
    got = {r["mode"]: (r.queries, r.reciprocal_rank) for r in evaluation.by_mode(hits, asked).collect()}
    assert got == {"a": (2, 0.5), "b": (2, 0.25)}
    a, n = spark.createDataFrame([(1, "It is Ménière disease"), (2, None)], "query_id int, answer string"), spark.createDataFrame([(1, ["meniere"]), (2, ["x"])], "query_id int, names array<string>")
    assert {r.query_id: r.names_it for r in evaluation.answer_hits(a, n).collect()} == {1: True, 2: None}
