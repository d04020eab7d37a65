import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.cache import Cache
from corpusloom.functions import dates, ids, models, projections, quality
from corpusloom.operators import reports, store
from corpusloom.sources import sinks


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "raw, iso",
    [("15/06/2023", "2023-06-15"), ("06/15/2023", "2023-06-15"), ("15/06/70", "2070-06-15"), ("1-2-99", "1999-02-01"), ("2023-06-15", "2023-06-15"), ("1º de dezembro de 2021", "2021-12-01"), ("31/02/2023", None), ("13/13/2020", None), ("x", None), (None, None)],
)
def test_dates(spark, raw, iso):
    assert one(spark, dates.parse_date(F.col("x").cast("string")), x=raw) == iso


def test_expiry_follows_the_first_words_closely(spark):
    near, far = "Foi revogada pela Portaria 1, de 02/03/2020.", "Foi revogada pela Portaria " + "x" * 95 + " 02/03/2020"
    assert one(spark, dates.expiry_date(F.col("x")), x=near) == "2020-03-02"
    assert one(spark, dates.expiry_date(F.col("x")), x=far) is None
    assert one(spark, dates.expiry_date(F.col("x")), x="revogada pela Lei. " + "y" * 120 + " revogada por ato de 02/03/2020") is None
    assert one(spark, dates.expiry_date(F.col("x").cast("string")), x=None) is None


@pytest.mark.parametrize(
    "raw, kind, number",
    [("ICA 96-1/2025", "ICA", "96-1/2025"), ("DECRETO - LEI 200", "Decreto-Lei", "200"), ("NSCA/2023", "NSCA", "2023"), ("NSCA", "NSCA", None), ("Portaria Nº 12/2020 de algo", "Portaria", "12/2020"), ("sem tipo", None, None), ("", None, None), (None, None, None)],
)
def test_titles(spark, raw, kind, number):
    a, b = ids.title_parts(F.col("x").cast("string"))
    assert (one(spark, a, x=raw), one(spark, b, x=raw)) == (kind, number)


def test_small_functions(spark):
    c = F.col("x")
    assert [one(spark, projections.byte_size(c), x=n) for n in (None, 0, 1, 1023, 1024, 1536, 1024**5)] == ["N/A", "N/A", "1.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1.0 PB"]
    assert one(spark, projections.type_code(c), x=" ica ") == 5 and one(spark, projections.type_code(c), x="DECRETO-LEI") == 18 and one(spark, projections.type_code(c.cast("string")), x=None) is None
    assert one(spark, projections.folder(c), x="Decreto.Lei") == "leis" and one(spark, projections.folder(c.cast("string")), x=None) == "outros"
    assert one(spark, projections.slug(c, F.lit("ICA")), x="ICA96-1") == "ICA-96-1" and one(spark, projections.slug(c, F.lit("ICA")), x="ICA A 1") == "ICA-A-1"
    assert one(spark, projections.add_days(c, 30), x="2024-02-01") == "2024-03-02" and one(spark, projections.add_days(c, 30), x="junk") is None
    assert one(spark, projections.free_text_date(c), x="BCA de 20/11/2019, de 3 de Março de 2018") == "20/11/2019" and one(spark, projections.free_text_date(c), x="em 3 de Março de 2018") == "03/03/2018"
    assert one(spark, projections.truncate_words(c, 2), x="a  b") == "a  b" and one(spark, projections.truncate_words(c, 2), x=" a  b\nc") == "a b"
    assert one(spark, projections.word_count(c.cast("string")), x=None) == 0 and one(spark, projections.word_count(c), x="  ") == 0
    assert one(spark, projections.long_enough(c, 3), x=" ab ") is False and one(spark, projections.long_enough(c.cast("string")), x=None) is False
    assert one(spark, projections.page_text(c.cast("string"), F.lit("ocr")), x=None) == "ocr" and one(spark, projections.page_text(c, F.lit("ocr")), x="x" * 51) == "x" * 51
    f, s = projections.intents(F.lit("a ICA mais recente em vigor, novas"))
    assert one(spark, F.concat_ws(",", f, s), x=1) == "type=ICA,sort_by_date_desc,sort_by_date_desc,filter_active"


def test_records_with_nulls_and_broken_metadata(spark):
    schema = "doc_id string, title string, content string, doc_type string, number string, authority string, url string, urn string, effective_date string, expiry_date string, status string, version_year string, is_latest int, canonical_id string, source string, metadata string"
    rows = [("a", "", "t", None, "", None, None, None, "", None, "", None, None, None, "s", '{"title": "T", "type": "lei", "number": "7", "date": "2020-01-01", "status": "revoked"}'), ("b", None, None, None, None, None, None, None, None, None, None, None, 1, None, None, '{"title": "x')]
    a, b = projections.article(spark.createDataFrame(rows, schema)).orderBy("regulation_id").collect()
    assert (a.title, a.effective_date, a.status, a.is_latest, a.metadata.type, a.metadata.number) == ("T", "2020-01-01", "revoked", False, "lei", "7")
    assert (b.title, b.effective_date, b.status, b.is_latest, b.metadata.type, b.metadata.title) == ("", None, "active", True, "", None)
    assert projections.article(spark.createDataFrame([], schema)).count() == 0
    q = spark.createDataFrame([("x" * 300,), ("1 " * 200,), ("a", ), (None,)], "content string")
    got = [r[0] for r in quality.quality_metrics(q).select(quality.reject_reason()).collect()]
    assert got == [None, "Alpha ratio too low (0.0%)", "Content too short (1 chars)", "Empty content"]
    rows = spark.createDataFrame([("x" * 300, "y" * 49), ("x" * 300, "y" * 50)], "content string, clean string")
    assert quality.accepted(rows, cleaned="clean").count() == 1


def test_evaluator_and_prompt_text(spark):
    s = lambda v: F.lit(v).cast("string")
    assert one(spark, projections.evaluator_text(s("T"), s("ICA"), s("1"), s(None), s("corpo")), x=1) == "T | ICA — nº 1\ncorpo"
    assert one(spark, projections.evaluator_text(s(None), s(""), s(None), s(None), s("a  b")), x=1) == "a  b"
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit("oi").alias("content")))
    assert one(spark, projections.prompt(s("q"), s(""), history), x=1) == "USER: oi\n\nQ: q"
    assert one(spark, projections.prompt(s("q"), s("c"), F.lit(None)), x=1) == "DOCS:\nc\n\nQ: q"


def test_golden_sets(spark):
    rows = [("q2", 1, "coverage"), ("q1", 2, "numeric"), ("q3", 3, None), ("q1", 4, "coverage"), (None, 0, "x"), ("q4", 5, "numeric")]
    g = spark.createDataFrame(rows, "query_id string, seq int, category string")
    assert {r.query_id for r in reports.sampled_queries(g, 2).collect()} == {"q1", "q3", "q2"}
    assert {r.query_id for r in reports.first_rows(g.filter("query_id IS NOT NULL")).collect()} == {"q1", "q3", "q4"}
    runs = spark.createDataFrame([(0, 0), (4, 1), (2, 2)], "n_before int, n_after int")
    assert reports.pipeline_summary(runs, []).first().filter_rate == pytest.approx(0.375)
    assert reports.pipeline_summary(runs.limit(0), ["n_after"]).first().asDict() == {"n_queries": 0, "filter_rate": 0.0, "avg_n_after": 0.0}


def test_lookup_with_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(None, 1), ("a", 1), ("b", 2)], "k string, n int")
    lookup = spark.createDataFrame([("hot", "H"), ("a", None), ("z", "Z")], "k string, v string")
    got = store.with_lookup(rows, lookup, "k")
    assert got.columns == ["k", "n", "v"] and got.count() == 3003 and got.filter("v = 'H'").count() == 3000
    assert {(r.k, r.v) for r in got.filter("k IS NULL OR k <> 'hot'").collect()} == {(None, None), ("a", None), ("b", None)}


def test_numbers_go_on_from_the_log(spark):
    log = spark.createDataFrame([(7, "a"), (3, "b")], "event_id bigint, kind string")
    events = spark.createDataFrame([(x,) for x in "dcbae"], "kind string")
    got = store.append_events(log, events.repartition(4), F.col("kind") != "e", ["kind"]).collect()
    assert sorted((r.event_id, r.kind) for r in got) == [(3, "b"), (7, "a"), (8, "a"), (9, "b"), (10, "c"), (11, "d")]
    assert store.append_events(log.limit(0), events.limit(0), F.lit(True), ["kind"]).count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, ["a", "b"], 'x "q"\nz & <'), (2, None, None, None)], "id int, score double, tags array<string>, note string")
    sinks.write_xlsx(df, str(tmp_path / "r.xlsx"))
    assert sinks.read_xlsx(str(tmp_path / "r.xlsx")) == [["id", "score", "tags", "note"], ["1", "0.500000", "a;b", 'x "q"\nz & <'], ["2"]]
    assert zipfile.is_zipfile(tmp_path / "r.xlsx")
    q = sinks.query_list(spark, [["query", "x"], ["um", "1"], ["  ", "2"], ["dois"]])
    assert [(r.query_id, r.query, r.x) for r in q.collect()] == [("Q001", "um", "1"), ("Q003", "dois", None)]
    with pytest.raises(ValueError):
        sinks.query_list(spark, [["x"]])
    sinks.markdown("R", {"T": df.select("id", "score")}, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text().endswith("## T\n\n| id | score |\n|-|-|\n| 1 | 0.5000 |\n| 2 |  |\n")
    sinks.write_sidecar(str(tmp_path / "o"), "f.pdf", b"x", {"a": "é"})
    assert json.loads((tmp_path / "o" / "f_meta.json").read_text()) == {"a": "é"} and sinks.file_count(spark, str(tmp_path / "o")) == 1
    t = f"file://{tmp_path}/t"
    sinks.recreate(spark, t, "id int")
    sinks.append(df.select("id"), t)
    sinks.backup(spark, t, f"{t}.bak")
    sinks.append(df.select("id"), t)
    assert spark.read.parquet(t).count() == 4
    sinks.restore(spark, f"{t}.bak", t)
    assert spark.read.parquet(t).count() == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.sql").write_text("CREATE OR REPLACE TEMP VIEW migrated AS SELECT 1 AS x;")
    assert sinks.migrate(spark, str(tmp_path / "m"), str(tmp_path / "done")) == ["1.sql"] and sinks.migrate(spark, str(tmp_path / "m"), str(tmp_path / "done")) == []
    assert spark.table("migrated").count() == 1


def test_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "c")], "id int, text string")
    load = lambda: lambda texts: np.array([[len(t), 0.0] for t in texts])
    got = {r.id: r.embedding for r in models.encode(df, load).collect()}
    assert got == {1: [1.0, 0.0], 2: None, 3: None, 4: [1.0, 0.0]}
    hits = spark.createDataFrame([(1, 10, "aa"), (1, 11, "b")], "search_id int, id int, eval_text string")
    queries = spark.createDataFrame([(1, 1, "aa"), (1, 2, "bbb")], "search_id int, query_id int, query string")
    score = lambda: lambda pairs: [float(q == t) * 3 + len(q) / 10 for q, t in pairs]
    best = {r.id: r.query_id for r in models.rerank_over_queries(hits, queries, score, lambda x: x).collect()}
    assert best == {"1:10": 1, "1:11": 2}

    def broken():
        def run(prompts):
            raise RuntimeError("gone")

        return run

    assert models.generate(spark.createDataFrame([("p",)], "prompt string"), broken, "nada").first().response == "nada"
    assert models.backend("auto", {"cpu": "c", "remote": "r"}) == "r" and models.backend("cpu", {"cpu": "c"}) == "c"


def test_cache():
    now = [0.0]
    c = Cache(2, 10, lambda: now[0])
    c.put("a", 1), c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1
    now[0] = 11
    assert c.get("a") is None and c.stats() == {"entries": 1, "hits": 2, "misses": 2, "hit_rate": 0.5}
