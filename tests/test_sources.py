import json

import pytest
from pyspark.sql import functions as F

from corpusloom import console
from corpusloom.runtime import hot_keys, skew_safe_join
from corpusloom.sources import connector, files, html
from corpusloom.streaming import feedback as streams

PAGE = """<html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body><nav>menu</nav>
<h1>Norma &amp; cia</h1><p>Um  texto<br>em duas linhas</p>
<table><tr><th>Tipo</th><th>Número</th></tr><tr><td>ICA</td><td><a href="/p/1">100-1</a> <a href="doc.PDF?v=1">pdf</a></td></tr><tr><td>Título:</td><td>Plano <b>de</b> voo</td></table></body>"""


def test_html(spark):
    pages = spark.createDataFrame([("http://e/x/", PAGE), ("http://e/n", None), ("http://e/b", "<td><table><tr><p>solto")], "url string, html string")
    text = {r.url: r.t for r in pages.select("url", html.html_to_text(F.col("html")).alias("t")).collect()}
    assert text["http://e/x/"].split("\n")[1:4] == ["Norma & cia", "Um texto", "em duas linhas"] and "menu" not in text["http://e/x/"] and text["http://e/n"] is None
    assert pages.select(html.html_to_text(F.col("html"), 10_000).alias("t")).filter("t IS NOT NULL").count() == 0
    rows = html.table_rows(pages).filter("url = 'http://e/x/'").orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["Tipo", "Número"], ["ICA", "100-1 pdf"], ["Título:", "Plano de voo"]]
    assert rows[1].link == "http://e/x/doc.PDF?v=1" and rows[1].links[0] == "http://e/p/1" and rows[0].link is None
    assert html.labelled_fields(html.table_rows(pages)).first().fields["título"] == "Plano de voo"
    kinds = spark.createDataFrame([("Revogada por X",), ("Revoga a Lei",), ("Altera",), ("Ver também",), (None,)], "t string").select(html.relation_type(F.col("t")).alias("k")).collect()
    assert [r.k for r in kinds] == ["revoked_by", "revokes", "amends", "correlates", "correlates"]


def test_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('query_id,query,notes\n,"um, dois",x\nQ9,"a ""b""",\n,  ,\n,fim,\n')
    got = files.query_list(spark, str(tmp_path / "q.csv"), "query_id string, query string, notes string").collect()
    assert [(r.query_id, r.query) for r in got] == [("Q001", "um, dois"), ("Q9", 'a "b"'), ("Q004", "fim")]
    folder = tmp_path / "h"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"session_id": "s", "messages": [{"role": "user", "content": "oi", "ratings": {"clarity": 3}}]}, indent=1))
    assert files.chat_histories(spark, str(folder)).first().messages[0].ratings == {"clarity": 3} and files.json_folder(spark, str(folder)).first()._filename == "a.json"
    m = files.parsed_metadata(spark.createDataFrame([('{"a": "1"}',), ("{quebr",), (None,)], "metadata string")).collect()
    assert [r.metadata for r in m] == [{"a": "1"}, {}, {}]
    (tmp_path / "n.xml").write_text('<Norma><Artigo id="art1"><Rotulo>Art. 1</Rotulo><Caput><p>Texto um</p></Caput><Paragrafo><Rotulo>§ 1</Rotulo><p>Par</p></Paragrafo></Artigo><Artigo id="art2"><Rotulo>Art. 2</Rotulo><Caput><p>Dois</p></Caput></Artigo></Norma>')
    assert [(r.label, r.text) for r in files.xml_articles(spark, str(tmp_path / "n.xml")).collect()] == [("Art. 1", "Texto um\n§ 1: Par"), ("Art. 2", "Dois")]
    (tmp_path / "pdf").mkdir()
    for name, body in (("a.pdf", b"ok" * 60), ("b.pdf", b"x"), ("c.txt", b"no")):
        (tmp_path / "pdf" / name).write_bytes(body)

    def broken(data):
        raise ValueError("no")

    texts = files.pdf_texts(spark, str(tmp_path / "pdf"), [(broken, 0), (lambda d: d.decode(), 100)]).collect()
    assert sorted((r.path[-5:], r.text and len(r.text)) for r in texts) == [("a.pdf", 120), ("b.pdf", None)]
    spark.range(5).write.parquet(str(tmp_path / "t.parquet"))
    assert files.file_stats(spark, str(tmp_path / "t.parquet")).agg(F.sum("n_rows")).first()[0] == 5
    paths = spark.createDataFrame([("a",), ("b",)], "path string")
    assert files.unlogged(paths, paths.limit(1)).count() == 1 and files.unlogged(paths, paths, force=True).count() == 2


def test_connector(spark, tmp_path, monkeypatch):
    module = tmp_path / "fakeregister.py"
    module.write_text("class Client:\n    def pages(self):\n        return [1, 2, 3]\n    def fetch(self, key):\n        return [{'doc_id': f'd{key}', 'source': 's', 'title': None}] * key\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(module))
    connector.register(spark)
    df = spark.read.format("paged_register").option("client", "fakeregister:Client").option("pagesPerPartition", "2").load()
    assert df.count() == 6 and df.filter("doc_id = 'd3'").count() == 3


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise connector.RetryableError("later", 503)
        return [{"a": 1}]

    assert connector.with_retries(flaky, sleep=waits.append) == [{"a": 1}] and waits == [1.0, 2.0]
    with pytest.raises(connector.RetryableError):
        connector.with_retries(lambda: (_ for _ in ()).throw(connector.RetryableError("no", 404)), sleep=waits.append)
    assert connector.frontier(lambda i: i <= 37, 0, 1000) == 37


def test_console(spark, data):
    names = ["store_documents", "base_regulations"]
    console.open_tables(spark, data, names)
    assert {r.table_name for r in console.execute(spark, "\\counts", names).collect()} == set(names)
    assert console.execute(spark, "\\sources", names).count() > 1 and console.execute(spark, "select 1 AS x;", names).first().x == 1
    assert console.execute(spark, "\\schema base_regulations", names).count() == 8 and "store_documents" in {r.viewName for r in console.execute(spark, "\\tables", names).collect()}
    for bad in ("DROP TABLE x", "\\nada", "insert into x values (1)"):
        with pytest.raises(ValueError):
            console.execute(spark, bad, names)


def test_skew_safe_join(spark):
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('k', id) END AS k", "id")
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k4", 3), ("zz", 4)], "k string, v int")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert {r.k for r in hot_keys(counts, ["k"]).collect()} == {"hot", None}
    out = skew_safe_join(rows, lookup, counts, ["k"])
    assert out.count() == 2002 and out.filter("v = 1").count() == 2000


def test_session_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 10:00:00", "um"), ("a", "2024-01-01 10:01:00", "dois"), ("b", "2024-01-01 10:00:30", "x")], "session_id string, ts string, content string").selectExpr("session_id", "CAST(ts AS timestamp) AS ts", "content").coalesce(1).write.parquet(str(src / "1"))
    spark.createDataFrame([("c", "2024-01-01 13:00:00", "y")], "session_id string, ts string, content string").selectExpr("session_id", "CAST(ts AS timestamp) AS ts", "content").coalesce(1).write.parquet(str(src / "2"))
    stream = spark.readStream.schema("session_id string, ts timestamp, content string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(src)).withWatermark("ts", "1 minute")
    q = streams.sessions_with_ttl(stream, minutes=60, keep=1).writeStream.format("memory").queryName("ttl").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.session_id, r.n_messages, r.last_content, r.expired) for r in spark.table("ttl").collect()}
    assert {("a", 1, "dois", False), ("b", 1, "x", False), ("c", 1, "y", False), ("a", 1, "dois", True), ("b", 1, "x", True)} == got
