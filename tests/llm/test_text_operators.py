"""Small tests of the text operators: defined results for odd input, and brute-force versions."""

import json
import random
import time

import numpy as np
import pytest

from larkspur.llm import boilerplate, encoder, history, knn, leakage, sitelines, spam, splitter, toxicity
from larkspur.llm.text import WordHasher, fold, shingles, words

PROSE = "The doctor asked about the pain in the hip before the test was arranged. It is not clear why the symptom came back after the long flight, but the outlook is good. "
_R = random.Random(0)
_NOUN = [a + b for a in ("ba", "cor", "den", "fil", "gur", "hal", "mor", "nes", "pil", "rov", "sen", "tur") for b in ("ding", "lem", "mar", "nose", "per", "rick", "sow", "tone")]
LONG = " ".join(f"The {_R.choice(_NOUN)} of the {_R.choice(_NOUN)} was not found when the {_R.choice(_NOUN)} and a {_R.choice(_NOUN)} came back, so that {_R.choice(_NOUN)} had to {_R.choice(_NOUN)} it at once." for _ in range(3000))
SPAM = "\n".join(f"buy {x}opril cheap online" for x in "abcdefghijklmnopqrstuvwxyz") + "\nbuy now cheap pills"


def ids(df, column):
    return sorted(r[column] for r in df.collect())


# words -----------------------------------------------------------------------------------------------------------------


def test_words_fold_accents_and_compatibility_forms():
    assert words("Café ﬁne １２ x_y") == ["cafe", "fine", "12", "x", "y"]
    assert words(None) == [] and words("") == [] and fold("ÉÀ") == "ea"


def test_shingles_are_distinct_and_order_matters():
    h = WordHasher()
    assert len(shingles(h(["a", "b"]), 3)) == 0
    assert len(shingles(h(["a", "b", "c", "a", "b", "c"]), 3)) == 3
    assert set(shingles(h(["a", "b", "c"]), 3)) != set(shingles(h(["c", "b", "a"]), 3))


# spam pages --------------------------------------------------------------------------------------------------------------


def hits(spark, rows):
    return spark.createDataFrame(rows, "hit_id long, content string, score string, is_spam string, ratio int")


def test_spam_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, "x", "y", 1), (2, "", "x", "y", 1), (3, "  \n ", "x", None, 1), (4, PROSE, "x", "y", 1), (5, SPAM, "x", "y", 1), (5, SPAM, "x", "y", 1), (6, LONG, None, "y", 1), (7, SPAM * 300, "x", "y", 1)]
    assert ids(spam.find_spam(hits(spark, rows)), "hit_id") == [5, 5, 7]
    assert spam.find_spam(hits(spark, [])).count() == 0


def test_spam_prose_without_punctuation_and_lists():
    assert not spam.verdict(PROSE.replace(".", "").replace(",", "").lower() * 3)[1]
    names = " ".join(f"{a}{b}olol" for a in ("bra", "cle", "dro", "fli", "gna", "hu") for b in ("bi", "ka", "mo", "ne", "pu"))
    assert spam.verdict(names)[1] and spam.verdict(PROSE[:74] + "\n" + names)[1]
    assert spam.verdict("Best pill top rated pill! Cheap pill best pill! Buy pill cheap pill! " * 20)[1]


PROSE_OF = {
    "de": "Die Krankheit beginnt meist schleichend und wird deshalb oft erst spät erkannt. Viele Betroffene klagen zunächst über Müdigkeit und Schmerzen in den Beinen. Der Arzt untersucht das Blut und fragt nach früheren Erkrankungen in der Familie. Eine Behandlung ist in den meisten Fällen möglich, sie dauert jedoch mehrere Monate.",
    "fr": "La maladie débute souvent de façon discrète et n'est reconnue que tardivement. Beaucoup de patients se plaignent d'abord de fatigue et de douleurs dans les jambes. Le médecin demande une prise de sang et interroge la famille. Un traitement est possible dans la plupart des cas, mais il dure plusieurs mois.",
    "pt": "A doença começa quase sempre de forma lenta e por isso só é reconhecida mais tarde. Muitas pessoas queixam-se primeiro de cansaço e de dores nas pernas. O médico pede uma análise ao sangue e pergunta pelos antecedentes da família. O tratamento é possível na maioria dos casos, mas demora alguns meses.",
    "fi": "Sairaus alkaa yleensä hitaasti, ja siksi se huomataan usein vasta myöhään. Monet potilaat valittavat aluksi väsymystä ja kipua jaloissa. Lääkäri tutkii veren ja kysyy suvun aiemmista sairauksista. Hoito on useimmissa tapauksissa mahdollinen, mutta se kestää monta kuukautta.",
    "tr": "Hastalık çoğunlukla yavaş başlar ve bu yüzden geç fark edilir. Birçok hasta önce yorgunluktan ve bacak ağrısından yakınır. Doktor kan tahlili ister ve ailedeki eski hastalıkları sorar. Tedavi çoğu durumda mümkündür, ancak birkaç ay sürer.",
    "ru": "Болезнь чаще всего начинается незаметно, поэтому её распознают поздно. Многие больные сначала жалуются на усталость и боль в ногах. Врач назначает анализ крови и спрашивает о болезнях в семье. Лечение в большинстве случаев возможно, но занимает несколько месяцев.",
    "el": "Η ασθένεια αρχίζει συνήθως αργά και γι' αυτό αναγνωρίζεται καθυστερημένα. Πολλοί ασθενείς παραπονιούνται πρώτα για κόπωση και πόνο στα πόδια. Ο γιατρός ζητά εξέταση αίματος και ρωτά για παλιές ασθένειες στην οικογένεια. Η θεραπεία είναι στις περισσότερες περιπτώσεις δυνατή, αλλά διαρκεί μήνες.",
    "ar": "يبدأ المرض في الغالب ببطء ولذلك لا يكتشف إلا متأخرا. يشكو كثير من المرضى أولا من التعب وألم في الساقين. يطلب الطبيب تحليل الدم ويسأل عن أمراض العائلة. العلاج ممكن في معظم الحالات لكنه يستغرق عدة أشهر.",
    "hi": "यह रोग प्रायः धीरे धीरे शुरू होता है और इसलिए देर से पहचाना जाता है। कई रोगी पहले थकान और पैरों में दर्द की शिकायत करते हैं। डॉक्टर खून की जाँच करवाते हैं और परिवार की बीमारियों के बारे में पूछते हैं। अधिकतर मामलों में इलाज संभव है, पर इसमें कई महीने लगते हैं।",
    "zh": "这种病通常起病缓慢，因此往往很晚才被发现。许多患者最初只是感到疲倦，腿部疼痛。医生会先做血液检查，并询问家族中是否有人得过同样的病。大多数情况下可以治疗，但是需要几个月的时间。早期发现对预后很重要，所以出现症状时，应当尽快去医院。有些人没有任何不适，只在体检时才知道自己患病。",
    "ja": "この病気はゆっくり始まることが多く、そのため発見が遅れがちである。多くの患者は、まず疲れやすさや足の痛みを訴える。医師は血液検査を行い、家族の病歴についても尋ねる。ほとんどの場合、治療は可能だが、数か月かかる。症状があるときは、早めに病院を受診したほうがよい。",
    "th": "โรคนี้มักเริ่มอย่างช้าๆ จึงมักตรวจพบช้า ผู้ป่วยจำนวนมากบ่นว่าอ่อนเพลียและปวดขาก่อน แพทย์จะตรวจเลือดและถามประวัติโรคในครอบครัว ส่วนใหญ่รักษาได้ แต่ต้องใช้เวลาหลายเดือน ควรไปพบแพทย์เมื่อมีอาการ และไม่ควรซื้อยากินเอง เพราะอาจทำให้อาการแย่ลง บางคนไม่มีอาการเลย และทราบเมื่อตรวจสุขภาพ เท่านั้น",
    "ko": "이 병은 대개 천천히 시작되기 때문에 늦게 발견되는 일이 많다. 많은 환자가 처음에는 피로와 다리 통증을 호소한다. 의사는 혈액 검사를 하고 가족의 병력을 묻는다. 대부분의 경우 치료가 가능하지만 몇 달이 걸린다.",
}


@pytest.mark.parametrize("lang", PROSE_OF)
def test_spam_prose_of_many_languages_is_no_case(lang):
    assert not spam.verdict(PROSE_OF[lang])[1] and not spam.verdict("\n\n".join([PROSE_OF[lang], PROSE_OF[lang][::2].title()]))[1]


def test_spam_stuffing_in_other_scripts():
    for words_ in ("купить таблетки дёшево", "特价 药片 购买", "खरीदें सस्ती गोलियाँ", "ซื้อยา ราคาถูก"):
        assert spam.verdict((words_ + " ") * 20)[1]
    assert spam.verdict((PROSE_OF["de"].split(".")[0].lower() + " ") * 8)[1]


# duplicates against history --------------------------------------------------------------------------------------------


def likeness(a, b):
    x, y = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (words(a), words(b)))
    return len(x & y) / len(x | y) if x and y else 0.0


def brute(rows):
    accepted, pairs = [], set()
    for b, s, d, t in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1])):
        near = {a for a, u in accepted if a != d and (t == u or likeness(t, u) >= 0.7)} if b > 0 else set()
        pairs |= {(d, a) for a in near}
        if not near:
            accepted.append((d, t))
    return pairs


def history_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(12)]
    rows = []
    for s in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 6, 12])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((0 if s < 25 else 1 + (s - 25) // 20, s, f"d{rng.randrange(60):02}", " ".join(w)))
    return rows + [(1, 900, "e1", "short one"), (1, 901, "e2", "short one"), (2, 902, "e3", ""), (2, 903, "e4", ""), (1, 904, None, "x y z"), (1, 905, "e5", None)]


def prepared(spark, rows):
    return history.rows_of(spark.createDataFrame(rows, "batch_id int, arrival_seq long, doc_id string, body string"), body="body")


def test_history_equals_brute_force(spark):
    rows = history_rows()
    df = prepared(spark, rows)
    past = history.History.create(spark)
    past.start(df.where("at.b = 0"))
    got = {(r[0], r[1]) for r in history.check(past, df.where("at.b > 0")).pairs.collect()}
    assert got == brute(rows)


def test_history_batch_by_batch_equals_one_increment(spark):
    rows = history_rows(5)
    df = prepared(spark, rows)
    past = history.History.create(spark)
    past.start(df.where("at.b = 0"))
    got = set()
    for b in (1, 2, 3, 4):
        got |= {(r[0], r[1]) for r in history.check_and_append(past, df.where(f"at.b = {b}")).pairs.collect()}
    assert got == brute(rows)


def test_history_reads_no_more_for_a_batch_when_it_has_grown(spark):
    rng = random.Random(9)
    body = lambda: " ".join(rng.choice(_NOUN) for _ in range(40))
    batch, read = prepared(spark, [(1, 1, "new", body())]), {}
    for n in (100, 1000):
        past = history.History.create(spark, shard_rows=64)
        past.start(prepared(spark, [(0, i, f"d{i}", body()) for i in range(n)]))
        keys = history._sketch(batch.select("cls", "body")).selectExpr("explode(keys) as key")
        got = past.lookup("blocks", keys)
        assert history.check(past, batch).accepted.count() == 1
        read[n] = got.count()
    # a key reads one shard at most; the larger history has 36 000 rows
    assert all(0 < r <= 1.25 * history.BLOCKS * 64 for r in read.values())


def test_history_empty_tables_and_manifest(spark):
    none = prepared(spark, [])
    past = history.History.create(spark)
    past.start(none)
    assert history.check(past, none).pairs.count() == 0
    pairs = spark.createDataFrame([("a", "b"), ("c", "zz")], "doc string, accepted string")
    manifest = spark.createDataFrame([("b", "OLD", "2020-01-01"), ("b", "NEW", "2021-01-01")], "doc_id string, content_hash string, indexed_at string")
    assert sorted((r.doc, r.content_hash) for r in history.with_manifest(pairs, manifest).collect()) == [("a", "new"), ("c", None)]


# lines repeated in a source ----------------------------------------------------------------------------------------------


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(2)
    lines = [f"Legal notice number {i} of this website, all rights reserved" for i in range(6)] + ["short line", "", "   ", "Call 555-0101 now for the desk of the house", "x" * 3000]
    rows = []
    for i in range(60):
        rows.append((i, f"d{rng.randrange(14)}", rng.choice(["A.example", "www.a.example", "b.example", None, " "]), "\r\n".join(rng.choice(lines) for _ in range(6)) if i % 9 else None))
    df = spark.createDataFrame(rows, "hit_id long, doc_id string, source_domain string, content string").selectExpr("*", "'q' as rep", "1 as line_no", "'z' as _key")
    count, want = {}, []
    cells = []
    for h, doc, src, text in rows:
        s = (src or "").strip().lower().removeprefix("www.")
        if s and text is not None:
            for n, line in enumerate(text.split("\n")):
                k = sitelines.normalise_line(line)
                if len(k) >= 20:
                    count.setdefault((s, k), set()).add(doc)
                    cells.append((h, n, s, k))
    want = sorted((h, n) for h, n, s, k in cells if len(count[s, k]) >= 6)
    cases = sitelines.find_repeated_lines(df)
    assert sorted((r.hit_id, r.line_no) for r in cases.collect()) == want and want
    clean = {r.hit_id: r for r in sitelines.remove_lines(df, cases).collect()}
    gone = {}
    for h, n in want:
        gone.setdefault(h, set()).add(n)
    for h, _, _, text in rows:
        assert clean[h].clean_content == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone.get(h, ())))
        assert clean[h].rep == "q"
    assert sitelines.find_repeated_lines(df.limit(0)).count() == 0


def test_cut_chunks_ignores_newlines(spark):
    notice = "All rights of this house are kept by the owners and their heirs for ever, so that no part may be copied without leave in writing from them. "
    unique = lambda i: " ".join(f"word{i}x{j}" for j in range(30)) + ". "
    df = spark.createDataFrame([(i, f"d{i}", "s.example", unique(i) + notice * 2 + unique(i + 100)) for i in range(8)] + [(99, "d99", None, notice), (98, "d98", "s.example", None)], "hit_id long, doc_id string, source_domain string, content string")
    out = {r.hit_id: r.clean_content for r in sitelines.cut_repeated_chunks(df).collect()}
    assert out[99] == notice and 98 not in out
    assert all(len(out[i]) < len(unique(i) + unique(i + 100)) + 1.2 * len(notice) for i in range(8))
    spans = sitelines.chunk_spans(notice * 30)
    assert "".join((notice * 30)[a:b] for a, b in spans) == notice * 30 and sitelines.chunk_spans("") == []


# main text of pages -----------------------------------------------------------------------------------------------------

PAGE = "\n".join(
    [
        "[News] [Tools] [Symptoms] [Careers]", "Cookies help Goodcare remember you. OK, got it", "Mellow fever: symptoms and causes", "By the Goodcare desk, updated 3 June 2022", "Symptoms",
        "Many patients first feel cold feet after a long flight, although the outlook is good.", "• cold feet after melonine", "• a skin biopsy (bradley method)", "Article continues below this message",
        "Treatment", "With rest and fluids, the pain tends to come back, yet few need an operation.", "See also", "Plain dystrophy quiz: bolgen", "Grey colitis guide: malten",
        "Do not change your medicine on your own; the Goodcare handbook explains how to speak with your team first.", "", "Join 445 readers: subscribe to Goodcare today", "(c) 2019 Goodcare. All rights reserved. Terms of use and privacy notice apply",
    ]
)


def test_boilerplate_page_and_odd_rows(spark):
    rows = [(1, PAGE, "www.goodcare.example", None, None), (2, PAGE, "goodcare.example", None, "piece:1"), (3, None, None, None, None), (4, " \n", None, None, None), (5, SPAM, "x.example", None, None), (1, PAGE, "www.goodcare.example", None, None), (6, LONG, None, None, None)]
    df = spark.createDataFrame(rows, "hit_id long, content string, source_domain string, url string, chunk_id string").selectExpr("*", "7 as line_no", "'a' as article")
    got = sorted((r.hit_id, r.line_no) for r in boilerplate.find_boilerplate(df).collect())
    assert got == sorted(2 * [(1, n) for n in (0, 1, 3, 8, 11, 12, 13, 16, 17)])
    main = {r.hit_id: r.article for r in boilerplate.main_text(df).collect()}
    assert main[2] is None and main[3] is None and "Join 445" not in main[1] and "Treatment" in main[1]
    assert boilerplate.find_boilerplate(df.limit(0)).count() == 0


@pytest.mark.parametrize("reach", [1, 2, 7])
def test_min_cut_is_least_of_all_labellings(reach):
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = 8
        u = rng.normal(size=n) * 2
        left, right = (np.array(x) for x in zip(*[(i, j) for i in range(n) for j in range(i + 1, min(n, i + 1 + reach)) if rng.random() < 0.6] or [(0, 1)]))
        w = rng.random(len(left)) * 2

        def cost(side, u=u, left=left, right=right, w=w):
            return np.abs(u)[side != (u > 0)].sum() + w[side[left] != side[right]].sum()

        best = min(cost(np.array([m >> i & 1 for i in range(n)], dtype=bool)) for m in range(1 << n))
        assert cost(boilerplate.min_cut(u, left, right, w)) == pytest.approx(best)
        side = np.zeros(n, dtype=np.int8)
        boilerplate._flow_sides(u, left, right, w, side)
        assert cost(np.where(side == 0, u > 0, side > 0)) == pytest.approx(best)


def test_min_cut_of_a_very_long_page_is_linear():
    rng = np.random.default_rng(5)
    took = {}
    for n in (10_000, 100_000):
        i = np.arange(n - 2)
        u, left, right = rng.normal(size=n), np.concatenate((i, i)), np.concatenate((i + 1, i + 2))
        begun = time.perf_counter()
        boilerplate.min_cut(u, left, right, rng.random(len(left)) * 2)
        took[n] = time.perf_counter() - begun
    assert took[100_000] < 30 * took[10_000] + 1


def test_line_model_on_lines_it_has_not_seen():
    m = boilerplate.line_model()
    odd = lambda line: float(m.log_odds([m.encode(boilerplate.tokens(line))], [boilerplate.traits(line, len(boilerplate.tokens(line)))])[0])
    assert odd("download the {b} app today") > 0 and odd("news · contact · help · jobs") > 0
    assert odd("patients with diabetes should have a blood test after the first winter.") < 0 and odd("prevention") < 0


# nearest vectors ----------------------------------------------------------------------------------------------------------


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 16)), 20, axis=0) + rng.normal(size=(600, 16)) * 0.3
    x[:40] = x[0]  # a hot group of equal vectors
    rows = [(f"c{i:03}", [float(v) for v in x[i]], "s") for i in range(600)] + [("c599", None, "s"), (None, [1.0] * 16, "s"), ("n1", None, "s"), ("n2", [], "s"), ("n3", [0.0] * 16, "s"), ("n4", [float("nan")] * 16, "s"), ("n5", [1.0, 2.0], "s")]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, h string")
    got = {}
    for r in knn.nearest(df, cells=8, brute=100).collect():
        got.setdefault(r.id, []).append(r.near_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for i in range(40, 600):
        s = u @ u[i]
        s[i] = -2
        fifth = np.sort(s)[-5] - 1e-4
        near = got[f"c{i:03}"]
        assert len(near) == 5 == len(set(near)) and f"c{i:03}" not in near
        hit += sum(s[int(n[1:])] >= fifth for n in near)
        total += 5
    assert hit / total >= 0.9
    assert all(len(got[f"c{i:03}"]) == 5 and all(int(n[1:]) < 40 for n in got[f"c{i:03}"]) for i in range(40))
    assert not {"n1", "n2", "n3", "n4", "n5"} & set(got)


def _share_found(spark, x, **settings):
    """The share of the true five nearest that come out, and whether every vector has five."""
    df = spark.createDataFrame([(f"c{i}", [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id string, embedding array<float>")
    got = {}
    for r in knn.nearest(df, **settings).collect():
        got.setdefault(int(r.id[1:]), set()).add(int(r.near_id[1:]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argpartition(-s, 5, axis=1)[:, :5]
    return np.mean([len(got[i] & set(w)) / 5 for i, w in enumerate(want.tolist())]), all(len(got.get(i, ())) == 5 for i in range(len(x)))


def test_nearest_hot_cell_is_split_without_loss(spark):
    x = np.random.default_rng(2).normal(size=(300, 8)) * 0.05 + np.ones(8)
    found, whole = _share_found(spark, x, cells=20, brute=20)
    assert whole and found > 0.9  # 16-bit values may swap near ties


@pytest.mark.parametrize(("width", "cells"), [(64, 20), (64, 1000), (8, 1500)])
def test_nearest_recall_with_one_two_and_three_hashes(spark, width, cells):
    assert len(knn.axes_for(cells, width)) == {20: 1, 1000: 2, 1500: 3}[cells]
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(200, width)), 20, axis=0) + rng.normal(size=(4000, width)) * 0.4
    found, whole = _share_found(spark, x, cells=cells)
    assert whole and found >= 0.95


def test_nearest_within_large_cells(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(200, 32)), 20, axis=0) + rng.normal(size=(4000, 32)) * 0.3
    got = knn._inner(x.astype(np.float32), x.astype(np.float32), np.arange(4000), np.arange(4000), 5, knn.Plan(20, 3, 0.01, 1.0, 1.0))
    u = x.astype(np.float32)
    near, _ = knn._best(u, u, np.arange(4000), np.arange(4000), 5)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got[0].tolist(), near.tolist())]) > 0.9


def test_nearest_asks_all_when_cells_give_too_few(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(300, 16))
    monkeypatch.setattr(knn, "choose_plan", lambda *a: knn.Plan(64, 1, 0.0, 1.0, 1.0))
    monkeypatch.setattr(knn, "PART", 100)
    assert _share_found(spark, x, cells=64)[1]


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    assert {(r.id, r.near_id) for r in knn.nearest(df).collect()} == {("a", "b"), ("b", "a")}
    assert knn.nearest(df.limit(0)).count() == 0


# splitting ----------------------------------------------------------------------------------------------------------------


def test_split_covers_text_and_keeps_limits():
    rng = random.Random(1)
    text = " ".join(rng.choice(["one", "two,", "three.", "four\n\n", "five"]) + " " * rng.randrange(2) for _ in range(700))
    for size, over in ((50, 10), (64, 0), (20, 30), (1, 0)):
        pieces = splitter.split_text(text, size, over)
        n = splitter.count_tokens(text)
        assert pieces[0][0] == 0 and pieces[-1][1] == n
        assert all(b - a <= size for a, b, _, _ in pieces)
        shared = min(over, size - 1)
        assert all(p[1] - q[0] == shared for p, q in zip(pieces, pieces[1:]))
        assert all(splitter.count_tokens(text[c:e]) == b - a for a, b, c, e in pieces)


def test_split_edit_leaves_far_pieces_alone():
    rng = random.Random(8)
    tokens = [rng.choice("abcdefghij") * rng.randrange(1, 6) + rng.choice(["", "", "", "."]) for _ in range(3000)]
    cuts = lambda ts: {" ".join(ts)[c:e] for _, _, c, e in splitter.split_text(" ".join(ts), 100, 0)}
    edited = tokens[:1000] + ["NEW"] + tokens[1000:]
    assert len(cuts(tokens) & cuts(edited)) > 0.5 * len(cuts(tokens))


def test_split_rows(spark):
    configs = spark.createDataFrame([("s", 10, 2, True, 2), ("none", None, 2, True, 2), ("zero", 0, 2, True, 2)], "config_name string, chunk_size long, overlap_tokens long, preserve_sentences boolean, min_chunk_size long")
    rows = [(1, "w " * 11, "s"), (2, "w " * 10, "s"), (3, None, "s"), (4, "", "s"), (5, "w " * 50, "none"), (6, "w " * 50, "zero"), (7, "w " * 50, None), (8, "w " * 50, "other"), (9, "w " * 12, "s"), (10, "w " * 40_000, "s"), (1, "w " * 11, "s")]
    df = spark.createDataFrame(rows, "hit_id long, content string, chunk_config string").selectExpr("*", "1 as piece", "2 as _text")
    out = splitter.split_oversized(df, configs)
    assert ids(out.where("piece_no = 0"), "hit_id") == [1, 1, 9, 10]
    assert splitter.split_oversized(df.limit(0), configs).count() == 0
    assert splitter.split_oversized(df, configs.limit(0)).count() == 0


# encoding -----------------------------------------------------------------------------------------------------------------

ODD_TEXTS = [None, "", " ", "plain words", "<|endoftext|> is text", "naïve café 🤮🏽", "\u0000�", "a" * 5000, "１２３ ＡＢＣ", LONG]


def test_encode_defined_ids_and_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)) + [(3, "plain words")], "doc_id long, text string").selectExpr("*", "'x' as ids")
    rows = encoder.encode(df).collect()
    got = {r.doc_id: r.ids for r in rows}
    assert len(rows) == len(ODD_TEXTS) + 1 and got[0] == [] == got[1] and got[2] == encoder.encode_texts([" "])[0]
    assert 50256 not in got[4] and dict(encoder.encode(df).dtypes)["ids"] == "array<int>"
    back = {r.doc_id: r.text for r in encoder.decode(encoder.encode(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD_TEXTS))


def test_encode_agrees_with_the_ranks_of_the_same_vocabulary():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ODD_TEXTS[1:-1]:
        assert encoder.encode_texts([t])[0] == other.encode_ordinary(t)


def test_spans_touch_every_character():
    for t in ODD_TEXTS[2:8]:
        sp = encoder.spans(t, encoder.encode_texts([t])[0])
        assert sp[0][0] == 0 and sp[-1][1] == len(t) and all(b[0] <= a[1] for a, b in zip(sp, sp[1:]))


# leaked passages ----------------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    passages = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 30, 40])))) for i in range(20)] + [(20, None), (21, "")]
    passages.append((22, passages[2][1]))
    docs = []
    for d in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if d % 2:
            p = words(passages[rng.randrange(20)][1])
            a = rng.randrange(max(1, len(p) - 10))
            w[len(w) // 2 : len(w) // 2] = p[a : a + rng.randrange(8, 30)]
        docs.append((d, " ".join(w).upper()))
    docs += [(100, None), (101, ""), (102, LONG), (1, docs[1][1])]
    want = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, p in passages:
            q = words(p)
            if any(tuple(q[k : k + 12]) in grams for k in range(len(q) - 11)):
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'p' as passage")
    items = spark.createDataFrame(passages, "item_id long, passage string")
    for most in (leakage.MAX_TEST_WORDS, 60):
        found = leakage.find_leaks(df, items, most=most)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want
        assert all(r.n_words >= 12 for r in found.collect())
    assert leakage.find_leaks(df.limit(0), items).count() == 0 and leakage.find_leaks(df, items.limit(0)).count() == 0
    assert {r.doc_id for r in leakage.clean_documents(df, found).collect()} == {d for d, _ in docs} - {d for d, _ in want}


# offending passages -------------------------------------------------------------------------------------------------------


def test_offending_odd_rows_and_obfuscation(spark):
    rows = [
        (1, None, "s"), (2, "", None), (3, " \n ", "s"), (4, PROSE, "s"), (5, PROSE + "You are a worthless idiot and your story is a lie.", "s"), (6, "You are a w0rthless id.iot and your sttttory is a l i e.", "s"),
        (7, LONG + " I know where you live and I will break every bone you have. " + LONG, "t"), (8, "The patient said voices call him a worthless idiot; treatment was started soon after surgery.", "t"), (5, PROSE, "s"),
    ]
    taught = [f"You are a {a} {n} and your {w} is a lie." for a in ("stupid", "pathetic", "filthy", "useless") for n, w in (("moron", "tale"), ("liar", "story"), ("loser", "word"))]
    taught += [f"I know where {w} and I will break {x}." for w in ("you live", "you sleep", "your kids are", "you work") for x in ("your legs", "every finger", "your neck")]
    fine = [f"The patient said voices call him {x}; treatment was started {w}." for x in ("a liar", "a useless moron", "worthless", "an idiot") for w in ("at once", "last week", "in spring")]
    rows += [(100 + i, PROSE + t, "u") for i, t in enumerate(taught + fine)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as score", "2 as offends")
    labels = spark.createDataFrame([(4, "a", 0), (5, "a", 1), (5, "b", 0)] + [(100 + i, "a", int(i < len(taught))) for i in range(len(taught + fine))], "doc_id long, rater string, toxic int")
    scored = toxicity.score_documents(df, labels)
    out = [(r.doc_id, r.offends) for r in scored.where("doc_id < 100").collect()]
    assert sorted(out) == [(1, False), (2, False), (3, False), (4, False), (5, False), (5, True), (6, True), (7, True), (8, False)]
    assert all(r.score == 0 for r in scored.collect() if r.doc_id < 4)
    assert {(r.source, r.documents) for r in toxicity.rates(scored).where("source is null or source <> 'u'").collect()} == {("s", 6), ("t", 2), (None, 1)}
    assert toxicity.score_documents(df.limit(0), labels.limit(0)).count() == 0


def test_reviews_reach_the_driver_in_bounded_pieces(spark):
    df = spark.createDataFrame([(i, LONG, "s") for i in (1, 1, 1, 2, 3)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "a", 0), (3, "b", 1), (4, "a", 0)], "doc_id long, rater string, toxic int")
    got = toxicity.reviewed(df, labels)
    assert sorted(o for _, o in got) == [False, True] and all(0 < len(p) <= toxicity.MAX_OF_DOCUMENT for p, _ in got)


def test_held_out_sentences():
    """Trained on every other sentence alone, the machine ranks the rest."""
    can = lambda part: [toxicity.canonical(x) for x in part]
    m = toxicity.Landmarks(can(toxicity.OFFENSIVE[::2] + toxicity.HARMLESS[::2])).fit(can(toxicity.OFFENSIVE[::2]), can(toxicity.HARMLESS[::2]))
    bad, good = m(can(toxicity.OFFENSIVE[1::2])), m(can(toxicity.HARMLESS[1::2]))
    assert (bad[:, None] > good[None, :]).mean() > 0.75


def test_a_reviewing_error_does_not_confirm_itself():
    bad = [([f"you are a {a} {n} and nobody likes you"], True) for a in ("stupid", "filthy", "ugly", "lazy") for n in ("pig", "liar", "clown", "moron")]
    good = [([f"the nurse gave {x} two tablets of {y} in the evening"], False) for x in ("him", "her", "the boy", "a guest") for y in ("zinc", "iron", "salt", "tea")]
    wrong = [(["the train to the coast was late again and it rained"], True)]
    m = toxicity.train(bad + good + wrong)
    assert m(["you are a nasty pig and nobody likes you"])[0] > toxicity.LIMIT > m(["the train to the coast was late again and it rained"])[0]


def test_queries_can_be_listed():
    from larkspur.llm import queries

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 8, 9)} | {"p7_ids"} <= set(queries.QUERIES)
    json.dumps(queries.SQL)
