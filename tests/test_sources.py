import io
import zipfile

import pytest
from pyspark.sql import functions as F

from citewright.sources import io as S
from citewright.streaming import log as stream


def test_csv_and_json_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text\n1,"a ""b""\nc"\n', encoding="utf-8")
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'a "b"\nc')]
    (tmp_path / "a.jsonl").write_text('{"id": 1, "tags": ["x"]}\n\n{"id": 2}\n')
    assert [tuple(r) for r in S.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id int, tags array<string>").collect()] == [(1, ["x"]), (2, None)]
    run = spark.createDataFrame([("q", 1, "d", 0.123456)], "query_id string, rank int, doc_id string, score double")
    S.save_run(run, str(tmp_path / "run"))
    assert tuple(S.read_run(spark, str(tmp_path / "run")).first()) == ("q", 1, "d", 0.1235)


def test_docx_and_xlsx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "<w:p><w:r><w:t>Một</w:t><w:br/><w:t>Hai</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>bảng</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "luat.docx").write_bytes(data.getvalue())
    assert [tuple(r) for r in S.read_docx(spark, str(tmp_path)).orderBy("line_no").collect()] == [("luat", 0, "Một"), ("luat", 1, "Hai"), ("luat", 2, "")]
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}"><sheets><sheet name="qrels"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>id</t></si><si><t>relevance</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>2.0</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in S.read_xlsx(spark, str(tmp_path / "a.xlsx"), "qrels", ["id", "relevance"]).collect()] == [("", "2")]
    with pytest.raises(ValueError):
        S.read_xlsx(spark, str(tmp_path / "a.xlsx"), "qrels", ["other"])


def test_log_store_and_manifest(spark, tmp_path):
    store = S.LogStore(spark, str(tmp_path / "log"))
    store.log(spark.sql("select timestamp '2024-01-01' as time, 'q' as question, 0 as refused"))
    query_id = store.queries().first()["id"]
    rate = lambda r: store.rate(spark.createDataFrame([(query_id, r)], "query_id bigint, rating int").select("query_id", "rating", F.lit(None).cast("string").alias("comment"), F.current_timestamp().alias("time")))
    rate(1), rate(-1)
    from citewright.operators.log import latest_feedback

    assert [r.rating for r in latest_feedback(store.feedback()).collect()] == [-1]
    with pytest.raises(Exception, match="rating must be"):
        rate(3)
    df = spark.range(10).toDF("x")
    assert S.manifest({"t": df}, "x").first()[0] == S.manifest({"t": df.repartition(3)}, "x").first()[0]
    assert S.markdown_table(spark.createDataFrame([(1, "a|b")], "x int, y string")).splitlines()[2] == "| 1 | a\\|b |"
    assert sum(r["count"] for r in S.histogram(df, "x", 4).collect()) == 10


def test_loader():
    fallback = object()
    assert S.load_retriever(None, fallback) is fallback and S.load_retriever("no.such:thing", fallback) is fallback
    import math

    assert S.load_retriever("math:sqrt", fallback) is math.sqrt


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    counts = stream.window_counts(stream.read_events(spark, str(tmp_path / "events")), "1 day")
    q = counts.writeStream.outputMode("append").format("memory").queryName("window_counts").start()
    q.processAllAvailable()
    q.stop()
    seen = spark.table("window_counts")
    want = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").count()
    assert seen.count() > 0 and seen.join(want.withColumnRenamed("count", "n"), ["start", "event_type"]).filter("count != n").count() == 0
