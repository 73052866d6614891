"""Sources and streaming forms on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.sources import bibliography, files, html, jsonl
from larkspur.streaming import events

LINE = '{"doc_id":"%s","url":"http://a.example/1","source_domain":"a.example","fetched_at":"2024-01-01T00:00:00Z","crawl":{"depth":0,"parent_url":" ","seed_id":"s","seed_group":"g"},"content":{"mime_type":"text/html","title":" ","sections":[{"heading":"h","text":"%s"}],"body":"b"},"page_meta":null,"content_hash":""}'


def test_jsonl_strict_and_lenient(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text(LINE % ("d1", "t") + "\n")
    bad.write_text(LINE % ("d1", "t") + "\nnot json\n" + LINE % ("d2", " ") + '\n{"doc_id":"d3"}\n')
    row = jsonl.read_strict(spark, str(good)).first()
    assert row.doc_id == "d1" and row.content.title is None and row.content_hash is None and row.crawl.parent_url is None
    ok, wrong = jsonl.read_lenient(spark, str(bad))
    assert [r.doc_id for r in ok.collect()] == ["d1"] and wrong.count() == 3
    with pytest.raises(Exception, match="bad.jsonl"):
        jsonl.read_strict(spark, str(bad)).collect()


def test_delta_replaces_its_own_partition(spark, tmp_path):
    df = spark.createDataFrame([("q1", 1), ("q2", 2)], "query_hash string, n int")
    jsonl.write_delta(df, str(tmp_path / "d"))
    jsonl.write_delta(spark.createDataFrame([("q1", 9)], "query_hash string, n int"), str(tmp_path / "d"))
    assert sorted((r.query_hash, r.n) for r in spark.read.json(str(tmp_path / "d")).collect()) == [("q1", 9), ("q2", 2)]


PAGE = """<html lang="en-GB"><head><title>T</title><meta property="og:title" content="OG"><meta name="author" content="Me"><script>var x = "<p>no</p>";</script></head>
<body><p>outside</p><article><h1>Head</h1><p>One <b>bold</b> &amp; two<li>item</li><h2>Empty</h2><h2>Next</h2><p>Three<a href="/x">link</a></p></article><a href="/y">y</a></body></html>"""


def test_html(spark):
    got = html.extract(PAGE)
    assert got["title"] == "OG" and got["language"] == "en" and got["author"] == "Me" and got["out_links"] == ["/x"]
    assert got["sections"] == [{"heading": "Head", "text": "One bold & two item"}, {"heading": "Next", "text": "Threelink"}]
    assert html.extract(None)["sections"] == [] and html.extract("<p>a")["body"] == "a"
    df = html.extract_pages(spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string"))
    assert {r.id: len(r.sections) for r in df.collect()} == {1: 2, 2: 0}


def test_bibliography(spark):
    xml = "<r><document url='http://m.example/a'><content name='title'>A <b>b</b></content><content name='FullSummary'>S</content></document></r>"
    articles = "<s><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T <i>x</i></ArticleTitle><Abstract><AbstractText>P1</AbstractText><AbstractText>P2</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><Initials>I</Initials></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/A</ArticleId></ArticleIdList></PubmedData></PubmedArticle></s>"
    records = '{"resultList":{"result":[{"id":"7","source":"MED","pmid":"7","doi":"10.1/a","title":"T","authorString":"A B, C D.","pubYear":"2020"}]}}'
    df = lambda p: spark.createDataFrame([("q", p), ("q", None), ("r", "<broken")], "query_hash string, payload string")
    rows, by = bibliography.fan_out({"a": bibliography.summaries(df(xml)), "b": bibliography.articles(df(articles)), "c": bibliography.records(df(records))})
    got = {r.source: r for r in rows.collect()}
    assert got["summaries"].title == "A b" and got["articles"].abstract == "P1\nP2" and got["articles"].authors == ["I L"] and got["records"].authors == ["A B", "C D"] and got["records"].year == 2020
    assert [r.source for r in bibliography.once_per_identity(rows.withColumn("doi", F.lower("doi")), "source").orderBy("source").collect()] == ["articles", "summaries"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("niño".encode("latin-1"))
    assert files.read_texts(spark, str(tmp_path)).first().text == "niño"
    allowed = files.robots_allow({"a.example": "User-agent: *\nDisallow: /private"})
    df = spark.createDataFrame([("http://a.example/private/x",), ("http://a.example/y",), ("http://b.example/private",)], "u string")
    assert [r.ok for r in df.select(allowed("u").alias("ok")).collect()] == [False, True, True]
    files.publish(df, str(tmp_path / "t"), "v1", "current_pages")
    assert spark.table("current_pages").count() == 3
    links = spark.createDataFrame([("u1", 1, "p", "s", "g"), ("u1", 2, "p", "s", "g"), ("u2", 1, "p", "s", "g"), ("u3", 9, "p", "s", "g")], "url string, depth int, parent_url string, seed_id string, seed_group string")
    assert [(r.url, r.depth) for r in files.frontier_step(links, spark.createDataFrame([("u2",)], "url string"), F.lit(True), 3).collect()] == [("u1", 1)]


def _write(spark, path, rows):
    spark.createDataFrame(rows, events.EVENTS).coalesce(1).write.mode("append").parquet(path)


def _event(i, minute, user=1, kind="a"):
    return (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), user, kind, 1.0, "{}")


def _run(spark, df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def test_windows_and_late_events(spark, tmp_path):
    src = str(tmp_path / "e")
    # one file a batch; event 4 comes two batches after the one that moves the watermark past its hour
    for rows in ([_event(1, 5), _event(2, 10)], [_event(3, 300)], [_event(7, 310)], [_event(4, 6), _event(5, 600)], [_event(6, 900)]):
        _write(spark, src, rows)
    stream = events.tumbling(events.read_events(spark, src)).writeStream.format("memory").queryName("w1").outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    dropped = sum(o["numRowsDroppedByWatermark"] for p in stream.recentProgress for o in p["stateOperators"])
    out = {(r.window_start.hour, r.n) for r in spark.table("w1").collect()}
    assert dropped == 1 and (0, 2) in out and (0, 3) not in out and (5, 2) in out
    assert _run(spark, events.sliding(events.read_events(spark, src)), "w2").count() > 4
    got = {(r.started.hour, r.n) for r in _run(spark, events.sessions(events.read_events(spark, src)), "w3").collect()}
    assert (0, 2) in got and (5, 2) in got


def test_once_and_merge(spark, tmp_path):
    src = str(tmp_path / "e")
    _write(spark, src, [_event(1, 0), _event(1, 1)])
    _write(spark, src, [_event(1, 2), _event(2, 3)])
    assert sorted(r.event_id for r in _run(spark, events.once(events.read_events(spark, src), ["event_id"]), "w4").collect()) == [1, 2]
    path = str(tmp_path / "t")
    events.into_table(events.read_events(spark, src), path, ["event_id"], str(tmp_path / "c"), ["ts"]).awaitTermination(120)
    last = spark.read.parquet(f"{path}/v1")
    assert sorted((r.event_id, r.ts.minute) for r in last.collect()) == [(1, 2), (2, 3)]
