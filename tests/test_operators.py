import pytest
from pyspark.sql import functions as F

from citewright.functions import text as T
from citewright.operators import answering as A
from citewright.operators import chunking as K
from citewright.operators import corpus as C
from citewright.operators import evaluation as E
from citewright.operators import log as L
from citewright.operators import pipeline as P
from citewright.operators import reports as RE
from citewright.operators import retrieval as R

RUN = "query_id string, doc_id string, rank int"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_bm25_and_top_k(spark):
    docs = spark.createDataFrame([(1, "đăng ký khai sinh"), (2, "kết hôn"), (3, None), (4, "khai tử")], "doc_id int, text string")
    q = spark.createDataFrame([("a", "khai sinh"), ("b", "zzz")], "query_id string, text string")
    scores = R.bm25(docs, q)
    assert rows(R.top_k(scores, 1), "query_id", "doc_id") == [("a", 1)]
    full = R.top_k(R.with_zeros(scores, docs, q, 3), 3).orderBy("query_id", "rank")
    assert rows(full, "query_id", "doc_id") == [("a", 1), ("a", 4), ("a", 2), ("b", 1), ("b", 2), ("b", 3)]
    assert rows(R.top_k(R.tfidf(docs, q), 1), "query_id", "doc_id") == [("a", 1)]


def test_fusion(spark):
    s = lambda *x: spark.createDataFrame([("q", i, float(v)) for i, v in enumerate(x)], "query_id string, doc_id int, score double")
    scaled = lambda *x: [r[0] for r in rows(R.minmax(s(*x), len(x)).orderBy("doc_id"), "score")]
    assert scaled(1, 3, 2) == [0, 1, 0.5] and scaled(2, 2) == [0, 0]
    both = R.fuse_minmax(s(1, 0), s(0, 1), 0.75, 2).orderBy("doc_id")
    assert rows(both, "score") == [(0.75,), (0.25,)]
    positions = spark.createDataFrame([(i, i + 1) for i in range(3)], "doc_id int, pos int")
    rrf = R.fuse_rrf(s(0.9, 0.5, 0.1), s(0.9, 0.4, 0.5), (1.0, 1.0), positions)
    assert rows(R.top_k(rrf, 1), "doc_id") == [(0,)]


def test_candidates_and_rerank(spark):
    s = lambda x: spark.createDataFrame([("q", k, v) for k, v in x.items()], "query_id string, doc_id string, score double")
    first, extra = s({"a": 0.9, "b": 0.8, "c": 0.1, "d": 0.2}), s({"a": 0.0, "b": 5.0, "c": 9.0, "d": 0.0})
    c = R.candidates(first, extra, 2, 3).orderBy("place")
    assert rows(c, "doc_id", "score") == [("a", 0.9), ("b", 0.8), ("c", 0.1)]
    pairs = spark.createDataFrame([("q", "a", 1.0, 1, 0.03), ("q", "b", 0.0, 2, 0.6)], "query_id string, doc_id string, score double, place int, ce double")
    assert {k: round(v, 3) for k, v in rows(R.rerank(pairs, 0.4), "doc_id", "score")} == {"a": round(0.4 + 0.6 * 0.03, 3), "b": 0.36}
    assert dict(rows(R.rerank(pairs, 0.4, "minmax"), "doc_id", "score")) == {"a": 0.4, "b": 0.6}
    with pytest.raises(ValueError):
        R.rerank(pairs, 0.1, "other")


def test_metrics(spark):
    run = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abc")] + [("u", "a", 1)], RUN)
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "d", 1)], "query_id string, doc_id string, relevance int")
    m = E.ranking_metrics(run, qrels, (3,)).collect()
    assert [(r.query_id, r.recall_3, r.rr) for r in m] == [("q", 0.5, 0.5)]
    best = spark.createDataFrame([("q", "b", 1), ("q", "d", 2)], RUN)
    assert abs(E.ranking_metrics(best, qrels, (3,)).first().ndcg_3 - 1) < 1e-12


def test_statistics(spark):
    tests = spark.createDataFrame([("a", 0.04), ("b", 0.01), ("c", 0.03)], "name string, p double")
    assert {k: round(v, 9) for k, v in rows(E.holm(tests), "name", "p_holm")} == {"a": 0.06, "b": 0.03, "c": 0.06}
    same = spark.createDataFrame([(i, 0.5) for i in range(20)], "i bigint, diff double")
    assert tuple(E.bootstrap_interval(same, 200).first()) == (0.5, 0.5) and E.sign_flip(same, 500).first().p < 0.01
    zero = spark.createDataFrame([(i, 0.0) for i in range(5)], "i bigint, diff double")
    assert E.sign_flip(zero, 100).first().p == 1
    pairs = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "x int, y int")
    assert round(E.kappa(pairs).first().kappa, 6) == 0.5
    assert E.kappa(spark.createDataFrame([(1, 1)], "x int, y int")).first().kappa is None
    f1 = spark.createDataFrame([(1, ["a", "b"], ["a", "b"]), (2, ["a"], ["b"]), (3, ["a", "a"], ["a"]), (4, [], ["a"])], "k int, a array<string>, b array<string>")
    assert {k: round(v, 4) for k, v in rows(E.token_f1(f1, "k", F.col("a"), F.col("b")), "k", "f1")} == {1: 1.0, 2: 0.0, 3: round(2 / 3, 4), 4: 0.0}
    sus = spark.createDataFrame([("p", *[5, 1] * 5)], "participant string, " + ", ".join(f"q{i} int" for i in range(10)))
    assert E.sus(sus, [f"q{i}" for i in range(10)]).first().sus == 100


def test_threshold(spark):
    top = spark.createDataFrame([("a", 0.9, True), ("b", 0.8, True), ("c", 0.3, False), ("d", None, False)], "query_id string, score double, answerable boolean")
    best = E.best_threshold(E.refusal_rates(top, E.threshold_candidates(top))).first()
    assert (round(best.threshold, 3), best.correct, best.wrong) == (0.55, 1.0, 0.0)


def test_parse(spark):
    text = "\n".join(
        ["Mở đầu", "Chương I", "QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", "1. Một", "a) Điểm a", "tiếp", "2. Hai “", "Điều 9. Trong ngoặc", "”", "Điều 2. Tên", "Nội dung", "Phụ lục I", "1. Dòng"]
    )
    units = C.parse_units(C.explode_lines(spark.createDataFrame([("d", text)], "doc_id string, text string"))).orderBy("pos")
    got = rows(units, "level", "article", "clause", "point", "text")
    assert got[:5] == [("article", "1", None, None, ""), ("clause", "1", "1", None, "Một"), ("point", "1", "1", "a", "Điểm a\ntiếp"), ("clause", "1", "2", None, "Hai “\nĐiều 9. Trong ngoặc\n”"), ("article", "2", None, None, "Nội dung")]
    assert got[5][0] == "appendix" and got[5][4] == "1. Dòng" and {r[0] for r in rows(units.filter("article is not null"), "chapter")} == {"I"}
    assert C.article_counts_differ(units, spark.createDataFrame([("d", 2), ("e", 1)], "doc_id string, n_articles int")).select("doc_id").collect()[0][0] == "e"


def test_amendments(spark):
    data = [("d", 1.0, "1", "Một", None, None, ""), ("d", 2.0, "1", "Một", "1", None, "cũ"), ("d", 3.0, "1", "Một", "1", "a", "điểm"), ("d", 4.0, "2", "Hai", None, None, "giữ cụm từ này lại"), ("d", 5.0, "3", "Ba", None, None, "hết")]
    units = spark.createDataFrame(data, "doc_id string, pos double, article string, article_title string, clause string, point string, text string")
    op = lambda i, kind, article, **k: C.Amendment(i, kind, "d", article, k.pop("on", "2020-01-01"), **k)
    log = [
        op("r", "repeal", "3"), op("p", "remove_phrase", "2", phrase="cụm  từ"), op("n", "rename", "1", title="Mới"), op("x", "replace", "1", clause="1", point="a", lines=["điểm mới"], on="2021-01-01"),
        op("i", "insert", "4", after_article="2", lines=["Điều 4. Thêm", "1. Khoản"], on="2019-01-01"), op("e", "repeal", "77"),
    ]
    out, notes = C.apply_amendments(units, log)
    by = {(r.article, r.clause, r.point): r for r in out.collect()}
    assert by["3", None, None].status == "repealed" and by["2", None, None].text == "giữ này lại" and by["1", "1", "a"].text == "điểm mới"
    assert by["1", "1", "a"].article_title == "Mới" and by["1", None, None].amended_by == ["n"] and by["1", "1", "a"].amended_by == ["x"]
    assert [r.article for r in out.orderBy("pos").collect()].index("4") == 4 and by["4", "1", None].text == "Khoản"
    assert {r.id: r.ok for r in notes.collect()} == {"r": True, "p": True, "n": True, "x": True, "i": True, "e": False}
    assert C.in_force(out).filter("article = '3'").count() == 0


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "a b c. d e. f"), (2, "w " * 25), (3, "")], "doc_id int, text string")
    chunks = C.chunk_texts(docs, 5)
    assert rows(chunks.filter("doc_id = 1").orderBy("part"), "chunk_text") == [("a b c. d e.",), ("f",)]
    assert chunks.agg(F.max("n_tokens")).first()[0] <= 5 and chunks.filter("doc_id = 3").count() == 0
    assert {r[0] for r in rows(C.check_chunks(chunks, 3), "rule")} >= {"too long"}


def test_splits(spark):
    n = spark.createDataFrame([(k,) for k in (1, 3, 5, 10, 61)], "n int")
    assert [r[0] for r in rows(n, C.allocation(F.col("n")))] == [[1, 0, 0], [1, 1, 1], [2, 1, 2], [4, 2, 4], [25, 12, 24]]
    groups = spark.createDataFrame([(i, "a" if i < 30 else "b") for i in range(40)], "group_id int, kind string")
    got = C.group_split(groups).groupBy("kind", "split").count().collect()
    assert {(r.kind, r.split): r["count"] for r in got} == {("a", "train"): 12, ("a", "validation"): 6, ("a", "test"): 12, ("b", "train"): 4, ("b", "validation"): 2, ("b", "test"): 4}
    assert C.double_sample(groups).count() == 8


def test_intents(spark):
    asked = ["Kết hôn cần giấy gì và nộp ở đâu?", "Nhận cha và mẹ cho con ở đâu?", "Khai sinh cần giấy gì? Kết hôn mất bao lâu?", "", "ai, ai, ai, ai; ai", "Khai sinh nộp ở đâu, lệ phí bao nhiêu, mất mấy ngày, ai ký"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, question string")
    got = {r[0]: r[1] for r in q.select("query_id", A.split_intents(F.col("question"))).collect()}
    assert got[0] == ["Kết hôn cần giấy gì", "Kết hôn nộp ở đâu"] and got[1] == [asked[1]]
    assert got[2] == ["Khai sinh cần giấy gì", "Kết hôn mất bao lâu"] and got[3] == [""]
    assert got[4] == ["ai", "ai", "ai, ai, ai"]
    assert got[5] == ["Khai sinh nộp ở đâu", "Khai sinh lệ phí bao nhiêu", "Khai sinh mất mấy ngày, ai ký"]
    own = {(r.query_id, r.part): r.own for r in A.own_words(q).collect()}
    assert own[0, 0] == "Kết hôn cần giấy gì" and own[0, 1] == "nộp ở đâu" and own[5, 1] == "lệ phí bao nhiêu"
    assert A.question_parts(q).filter("query_id = 2").count() == 2


def test_quotes(spark):
    text = "1. Hồ sơ gồm:\na) Giấy chứng sinh\nb) Tờ khai đăng ký\n2. Thời hạn 60 ngày"
    one = spark.createDataFrame([(text,)], "t string")
    get = lambda i: one.select(A.quote(F.col("t"), F.lit(i)).alias("q")).select("q", A.citation(F.lit("16"), F.lit(None).cast("string"), F.col("q")).alias("c")).first()
    assert get(1).q == ["1. Hồ sơ gồm:", "a) Giấy chứng sinh"] and get(1).c == "Điều 16 Khoản 1"
    assert get(0).q == ["1. Hồ sơ gồm:", "a) Giấy chứng sinh", "b) Tờ khai đăng ký"]
    assert get(3).q == ["2. Thời hạn 60 ngày"] and get(3).c == "Điều 16 Khoản 2"
    marked = one.select(A.highlight(F.col("t"), F.array(F.lit("ngay")), F.array(F.lit("2. Thời hạn 60 ngày")))).first()[0]
    assert marked.endswith('<span class="quote-line">2. Thời hạn 60 <mark>ngày</mark></span>')


def test_answers(spark):
    chunks = spark.createDataFrame(
        [("c1", "Luật", "15", "1", "Trong 60 ngày kể từ ngày sinh con phải đăng ký khai sinh"), ("c2", "Luật", "18", None, "Kết hôn nộp tờ khai tại xã")], "doc_id string, title string, article string, clause string, text string"
    )
    asked = {"ok": "khai sinh trong bao lâu", "low": "tờ", "scope": "làm hộ chiếu ở đâu", "overlap": "xyz qqq", "empty": "?!", "evidence": "kết hôn lệ phí bao nhiêu tiền"}
    parts = spark.createDataFrame([(k, 0, v) for k, v in asked.items()], "query_id string, part int, question string")
    vocabulary = spark.createDataFrame([(w,) for w in "trong 60 ngay ke tu sinh con phai dang ky khai ket hon nop to tai xa".split()], "term string")
    docs = chunks.select("doc_id", "text")
    out = {r.query_id: r for r in A.answer(parts, lambda q: R.top_k(R.bm25(docs, q), 5), chunks, vocabulary, A.line_idf(docs), 0.9).collect()}
    assert {k: r.reason for k, r in out.items()} == {"ok": None, "low": "low_score", "scope": "out_of_scope", "overlap": "no_overlap", "empty": "empty", "evidence": "no_evidence"}
    assert out["ok"].answer == 'Theo Luật, Điều 15 Khoản 1: "Trong 60 ngày kể từ ngày sinh con phải đăng ký khai sinh"'


def test_whole_chain(spark):
    rows_ = [
        ("c1", "Luật", "L", "15", "Đăng ký khai sinh", "1", "Trong 60 ngày kể từ ngày sinh con phải đăng ký khai sinh", 1, None),
        ("c2", "Luật", "L", "18", "Đăng ký kết hôn", None, "Kết hôn đăng ký tại xã", 2, ["op"]),
        ("c3", "Luật", "L", "18", "Đăng ký kết hôn", "2", "Lời dẫn\nHồ sơ gồm bản khai", 3, None),
    ]
    chunks = spark.createDataFrame(rows_, "doc_id string, title string, source string, article string, article_title string, clause string, text string, pos int, amended_by array<string>")
    docs = chunks.select("doc_id", "text")
    vocabulary = docs.select(F.explode(T.syllables(F.col("text"))).alias("term")).distinct()
    asked = {"one": "khai sinh trong bao lâu", "two": "Kết hôn nộp ở đâu? Khai sinh trong bao lâu?", "foreign": "Kết hôn nộp ở đâu? Làm hộ chiếu ở đâu?", "none": "???", "aspect": "kết hôn cần giấy tờ gì"}
    q = spark.createDataFrame(list(asked.items()), "query_id string, question string")
    retrieve = lambda x: R.top_k(R.bm25(docs, x), 20)
    parts = A.answer_questions(q, retrieve, chunks, vocabulary, A.line_idf(docs), 0.1, (A.word_counts(docs), A.bigrams(docs))).cache()
    got = {(r.query_id, r.part): r for r in parts.collect()}
    assert set(got) == {("one", 0), ("two", 0), ("two", 1), ("foreign", 0), ("foreign", 1), ("none", 0), ("aspect", 0)}
    assert got["one", 0].doc_id == "c1" and got["two", 0].reason is None and got["two", 1].doc_id == "c1"
    assert got["foreign", 1].reason == "out_of_scope" and got["foreign", 0].reason is None and got["none", 0].reason == "empty"
    assert got["aspect", 0].doc_id == "c3" and got["aspect", 0].quoted == ["Hồ sơ gồm bản khai"]  # the unit of the same article that lists documents
    whole = {r.query_id: r for r in A.whole_answers(parts).collect()}
    assert whole["none"].refused and not whole["foreign"].refused and whole["two"].answer.startswith("1. Theo Luật")
    hits = retrieve(q.filter("query_id = 'aspect'").withColumnRenamed("question", "text")).withColumn("part", F.lit(0))
    listed = A.sources(hits, parts.filter("query_id = 'aspect'"), chunks).orderBy("place").collect()
    assert listed[0].doc_id == "c3" and listed[0].used and not any(r.used for r in listed[1:]) and len({r.doc_id for r in listed}) == len(listed)
    marks = {r.query_id: r.notes for r in A.notes(parts.withColumn("doc_id", F.when(F.col("query_id") == "two", "c2").otherwise(F.col("doc_id"))), chunks).collect()}
    assert marks["two"] == ["amended"] and marks["one"] == []


def test_spelling_and_accents(spark):
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "word string")
    got = {(r.candidate, r.distance) for r in A.spell_candidates(words("khia"), words("khai", "kha", "khi", "khía", "đăng", "khiă")).collect()}
    assert got == {("kha", 1.0), ("khi", 1.0), ("khía", 0.5), ("khiă", 1.0)}
    assert {(r.candidate, r.distance) for r in A.spell_candidates(words("đo"), words("do", "đơ", "đó")).collect()} == {("do", 1.0), ("đơ", 1.0), ("đó", 0.5)}
    texts = spark.createDataFrame([("đăng ký khai sinh, đăng ký kết hôn",)], "text string")
    asked = spark.createDataFrame([("q", 1, "kí", "đăng", None)], "query_id string, i int, word string, before string, after string")
    fixes = A.correct(asked, A.spell_candidates(words("kí"), A.word_counts(texts)), A.bigrams(texts))
    assert rows(fixes, "i", "fix") == [(1, "ký")]
    q = spark.createDataFrame([("a", "Đăng kí khai sinn, kết hônn"), ("b", "dang ki"), ("c", "đăng Kí ở xã"), ("d", "đăng kí khii"), ("e", None)], "query_id string, question string")
    out = {r.query_id: (r.spelled, r.fixes) for r in A.spelled(q, A.word_counts(texts), A.bigrams(texts)).collect()}
    assert out["a"] == ("Đăng ký khai sinh, kết hôn", 3)
    # without accents nothing is looked at, nor a capital within; a correction is the next word's left neighbour
    assert out["b"] == ("dang ki", 0) and out["c"] == ("đăng Kí ở xã", 0) and out["d"] == ("đăng ký khai", 2) and out["e"] == ("", 0)
    table = spark.createDataFrame([("khai sinh", "khai sinh"), ("dang ky", "đăng ký"), ("ket", "kết"), ("hon", "hôn")], "plain string, accented string")
    q = spark.createDataFrame([("a", "Dang ky, KET hon abc"), ("b", "dang, ky"), ("c", None)], "query_id string, question string")
    assert dict(rows(A.restore_questions(q, table), "query_id", "restored")) == {"a": "Đăng ký, KẾT hôn abc", "b": "dang, ky", "c": ""}
    q = spark.createDataFrame([("a", "dang ky khai sinh ntn"), ("b", "đăng ký ko")], "query_id string, question string")
    assert dict(rows(A.restore_questions(q, A.accent_table(texts)), "query_id", "restored")) == {"a": "đăng ký khai sinh như thế nào", "b": "đăng ký không"}


def test_chunks(spark):
    long = " ".join(f"w{i}" for i in range(40))
    units = [
        ("5.2020.QH14", 1, "1", "Short", None, None, "Whole text.", None, None), ("5.2020.QH14", 2, "2", "Long", None, None, "Lead.", ["op1"], "2024-01-02"), ("5.2020.QH14", 3, "2", "Long", "1", None, "One two three four five six", None, None),
        ("5.2020.QH14", 4, "2", "Long", "2", None, "Head:", ["op2", "op1"], "2023-01-01"), ("5.2020.QH14", 5, "2", "Long", "2", "a", "first point of the clause", None, None), ("5.2020.QH14", 6, "2", "Long", "2", "b", "second point of it", None, None),
        ("5.2020.QH14", 7, "3", "None", None, None, f"A sentence. {long}. End.", None, None), ("5.2020.QH14", 8, "4", "Gone", None, None, "Old text", None, None), ("9.2021.XX", 9, "1", "Other", None, None, "Not wanted", None, None),
    ]
    df = spark.createDataFrame(units, "doc_id string, pos int, article string, article_title string, clause string, point string, text string, amended_by array<string>, effective_from string")
    df = df.withColumns({"effective_from": F.to_date("effective_from"), "status": F.when(F.col("article") == "4", "repealed").otherwise("active")})
    sources = spark.createDataFrame([("5.2020.QH14", "u", "2024", "x;;y")], "doc_id string, url string, accessed_at string, affected_by string")
    ops = spark.createDataFrame([("op1", "7.2023.ND-CP")], "op string, amending_doc string")
    rules = spark.createDataFrame([("5.2020.QH14", None, None)], "doc_id string, article string, clause string")
    out = {r.chunk_id: r for r in K.build_chunks(df, sources, ops, 22, rules).collect()}
    assert sorted(k for k in out if "__D1" in k or "__D2" in k) == ["5.2020.QH14__D1", "5.2020.QH14__D2__K1", "5.2020.QH14__D2__K2__P1", "5.2020.QH14__D2__K2__P2"]
    first = out["5.2020.QH14__D1"]
    assert first.chunk_text == "Luật Hộ tịch 5/2020/QH14 | Điều 1. Short\nWhole text." and first.amended_by == [] and first.affected_by == ["x", "y"] and first.url == "u"
    assert out["5.2020.QH14__D2__K1"].display_text == "Lead.\nOne two three four five six"
    parts = [out[f"5.2020.QH14__D2__K2__P{i}"] for i in (1, 2)]
    assert [p.display_text for p in parts] == ["Head:\na) first point of the clause", "b) second point of it"] and "Khoản 2 (phần 2)" in parts[1].chunk_text
    assert parts[0].amended_by == ["7.2023.ND-CP", "op2"] and parts[0].amendment_ops == ["op1", "op2"] and str(parts[0].effective_from) == "2024-01-02"
    third = [out[k] for k in sorted(out) if "__D3" in k]
    assert third[0].display_text == "A sentence." and third[-1].display_text == "End." and all(r.n_tokens <= 22 for r in out.values())
    assert " ".join(r.display_text for r in sorted(third, key=lambda r: r.part)) == f"A sentence. {long}. End."
    assert not any("__D4" in k or "9.2021" in k for k in out)
    some = spark.createDataFrame([("5.2020.QH14", "2", "2")], "doc_id string, article string, clause string")
    assert {r.chunk_id for r in K.build_chunks(df, sources, ops, 200, some).collect()} == {"5.2020.QH14__D2__K2"}


def test_freeze_and_reports(spark):
    q = spark.createDataFrame([(1, "g1", "a", "x", "people"), (2, "g1", "b", "X ", "generated"), (3, "g2", "free", "z", "people"), (3, "g3", "odd", "y", "people")], "query_id int, group_id string, type string, question string, source string")
    chunks = spark.createDataFrame([("c1", "t"), ("c1", "t"), ("c2", " ")], "chunk_id string, chunk_text string")
    rel = spark.createDataFrame([(1, "c1", "1"), (1, "c1", "1"), (3, "c9", "3"), (8, "c1", "2")], "query_id int, chunk_id string, relevance string")
    sources = spark.createDataFrame([("d1", "u", "2024", "ok"), ("d2", "u", None, "ok")], "doc_id string, url string, accessed_at string, status string")
    splits = spark.createDataFrame([("g1", "train"), ("g1", "test"), ("g2", "test")], "group_id string, split string")
    found = {(r.severity, r.rule, r.key) for r in RE.freeze_checks(chunks, q, rel, sources, splits, ("a", "b", "c", "free"), ("free",), ("train", "test")).collect()}
    assert found == {
        ("error", "source without url, date or status", "d2"), ("error", "repeated chunk", "c1"), ("error", "empty chunk", "c2"), ("error", "repeated question", "3"), ("error", "unknown type", "3"), ("error", "type without question", "c"),
        ("warning", "repeated text", "x"), ("error", "label of no question", "8"), ("error", "label of no chunk", "3 c9"), ("error", "relevance other than 1 or 2", "3 c9"), ("error", "label of an unanswerable question", "3"),
        ("error", "question without label", "2"), ("error", "repeated label", "1 c1"), ("error", "group in several splits", "g1"), ("error", "group in no split", "g3"), ("warning", "type missing from a split", "train free"),
        ("warning", "type missing from a split", "train c"), ("warning", "type missing from a split", "test c"), ("warning", "generated question", "2"),
    }
    assert rows(RE.group_headers(q), "group_id", "kind", "n_questions") == [("g1", "a", 2), ("g2", "free", 1), ("g3", "odd", 1)]
    values = spark.range(5000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(700)).cast("double").alias("v"))
    want = {g: sorted(r.v for r in values.filter(F.col("g") == g).collect()) for g in range(3)}
    assert {r.g: r.p for r in E.nearest_rank(values, "g", "v").collect()} == {g: x[round(0.95 * (len(x) - 1))] for g, x in want.items()}
    assert {r.g: r.median for r in E.medians(values, "g", "v").collect()} == {g: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2 for g, x in want.items()}
    assert rows(E.numbered(values.select("v").distinct(), "v"), "i", "v") == list(enumerate(sorted({v for x in want.values() for v in x})))
    assert {r.doc_id: r.pos for r in R.positions(spark.range(7, 5007).withColumnRenamed("id", "doc_id")).collect()} == {i: i - 6 for i in range(7, 5007)}


def test_spec():
    assert P.Spec().with_({"alpha": 0.5, "odd": 1, "threshold": None}).alpha == 0.5
    for wrong in ({"pipeline": "x"}, {"fusion": "x"}):
        with pytest.raises(ValueError):
            P.Spec(**wrong)


def test_log(spark):
    import datetime

    t = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    f = spark.createDataFrame([(1, 1, None, t[0], 0), (1, -1, "no", t[1], 1), (2, 5, None, t[1], 2)], "query_id int, rating int, comment string, time timestamp, seq bigint")
    q = spark.createDataFrame([(i, t[i], f"Câu {i}", i % 2) for i in range(3)], "id int, time timestamp, question string, refused int")
    assert tuple(L.summary(q, f).first()) == (3, 1, 0, 1)
    assert rows(L.history(q, f, 2).orderBy(F.desc("id")), "id", "rating") == [(2, None), (1, -1)]
    assert L.history(q, f, keyword="câu 1").count() == 1 and L.per_day(q).count() == 3


def test_label_pool_and_answer_metrics(spark):
    labels = lambda *x: spark.createDataFrame(list(x), "query_id string, doc_id string, relevance int")
    articles = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "doc_id string, article string")
    pool = E.label_pool(labels(("q", "a", 2)), labels(("q", "c", 1)), articles)
    assert set(rows(pool, "doc_id", "x", "y")) == {("a", 2, 0), ("b", 0, 0), ("c", 0, 1)}
    answers = spark.createDataFrame([("q", False, "a", True), ("r", True, None, True), ("s", True, None, False)], "query_id string, refused boolean, doc_id string, answerable boolean")
    assert tuple(E.answer_metrics(answers, labels(("q", "a", 2))).first()) == (0.5, 1.0, 1.0, 1.0, 0.5)
    rule = spark.createDataFrame([(True, True), (True, False), (False, True)], "predicted boolean, gold boolean")
    assert tuple(E.rule_quality(rule).first()) == (2, 2, 0.5, 0.5)
    rate = lambda c, w: spark.createDataFrame([(c, w)], "correct double, wrong double")
    assert E.keep_evidence_check(rate(0.5, 0.0), rate(0.6, 0.1)).first()[0] and not E.keep_evidence_check(rate(0.5, 0.0), rate(0.6, 0.2)).first()[0]


def test_similar_table_and_switches(spark):
    suggested = spark.createDataFrame([("a", "x", 0.9), ("b", "y", 0.6), ("n", "x", 0.95)], "query_id string, other_id string, score double")
    questions = spark.createDataFrame([("a", True), ("b", True), ("n", False)], "query_id string, answerable boolean")
    qrels = spark.createDataFrame([("a", "d1", 2), ("x", "d1", 1), ("b", "d2", 1), ("y", "d3", 1)], "query_id string, doc_id string, relevance int")
    table = E.similar_table(suggested, questions, qrels, spark.createDataFrame([(0.5,), (0.7,)], "threshold double"))
    assert {r.threshold: (r.coverage, r.precision_at_1, r.shown_unanswerable) for r in table.collect()} == {0.5: (1.0, 0.5, 1.0), 0.7: (0.5, 1.0, 1.0)}
    grid = spark.createDataFrame([(0, '{"blend": 0}', 0.5), (1, '{"blend": 0}', 0.7), (2, '{"blend": 1}', 0.4)], "place int, params string, ndcg double")
    assert set(rows(E.best_switches(grid, {"blend": "$.blend"}, "ndcg"), "blend", "place")) == {("0", 1), ("1", 2)}


def test_aspects(spark):
    chunks = spark.createDataFrame(
        [("c1", "L", "16", "Thủ tục đăng ký khai sinh", "Người đi đăng ký nộp tờ khai", 1), ("c2", "L", "16", "Thủ tục đăng ký khai sinh", "Ngay sau khi nhận đủ giấy tờ", 2), ("c3", "L", "18", "Thủ tục đăng ký kết hôn", "nộp tờ khai", 3)],
        "doc_id string, source string, article string, title string, text string, pos int",
    )
    hits = spark.createDataFrame([("q", "c1", 1), ("q", "c3", 2), ("h", "c2", 1)], "query_id string, doc_id string, rank int")
    asked = spark.createDataFrame([("q", "khai sinh mất bao lâu"), ("h", "khai sinh cần giấy tờ gì")], "query_id string, question string")
    assert dict(rows(A.aspect_chunks(hits, chunks, asked), "query_id", "doc_id")) == {"q": "c2", "h": "c1"}
    assert asked.filter("query_id = 'q'").select(A.suggestions(F.col("question"), 2)).first()[0] == ["Kết hôn", "Xác nhận tình trạng hôn nhân"]
