import random
from datetime import datetime

from pyspark.sql import functions as F

from corpusloom.operators.references import key_runs, orphan_references, orphans_by_period, rows_with_orphans


def test_runs_match_brute_force(spark):
    rng = random.Random(1)
    parents = [f"a_{rng.randint(1, 4000)}" for _ in range(1500)] + ["x", "b007", "b7", "7", None, "c_9/2020"]
    refs = [f"a_{rng.randint(1, 5000)}" for _ in range(2000)] + ["x", "y", "b007", "b07", "7", "07", "c_9/2021", "c_9/2020", "999999999999999999999", None]
    p, r = spark.createDataFrame([(x,) for x in parents], "key string"), spark.createDataFrame([(x, i) for i, x in enumerate(refs)], "key string, i int")
    found = {x.i for x in rows_with_orphans(r, p).collect()}
    assert found == {i for i, x in enumerate(refs) if x is not None and x not in set(parents)}


def test_contiguous_parents_are_one_run_per_block(spark):
    p = spark.range(0, 2048).select(F.concat(F.lit("d"), "id").alias("key"))
    assert [(len(r.runs)) for r in key_runs(p).collect()] == [1, 1]


def test_hot_key_and_no_parents(spark):
    r = spark.range(0, 5000).select(F.when(F.col("id") % 3 == 0, "hot1").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    none = spark.createDataFrame([], "key string")
    assert rows_with_orphans(r, none).count() == 5000
    assert rows_with_orphans(r, spark.createDataFrame([("hot1",)], "key string")).filter("key = 'hot1'").count() == 0
    assert rows_with_orphans(none, r).count() == 0


def test_references_by_table_and_month(spark):
    at = datetime(2024, 5, 3)
    rel = spark.createDataFrame(
        [(1, " A/1 ", "B/2", None, at), (1, " A/1 ", "B/2", None, at), (2, "gone", None, "reg:0042", at), (3, "a/1", "gone", "00041", at), (4, "a/1", "", " ", at), (5, None, "GONE", "42", at), (6, "a/1", None, "77", at)],
        "relation_id bigint, source_doc_id string, target_doc_id string, target_ref string, recorded_at timestamp",
    )
    log = spark.createDataFrame([(1, "a/1", "2024-06-01T00"), (2, "no", "2024-07-01T00"), (3, None, None)], "log_id bigint, doc_id string, embedded_at string")
    rep = spark.createDataFrame([(9, "zz", at), (10, "b/2", None)], "report_id bigint, doc_id string, checked_at timestamp")
    docs = spark.createDataFrame([("a/1", "s:41"), ("a/1", "s:41")], "doc_id string, source_ref string")
    base = spark.createDataFrame([("b/2", "base:42")], "doc_id string, source_ref string")
    out = orphan_references(rel, log, rep, docs, base)
    assert {(r.table_name, r.record_id, r.field_name, r.period) for r in out.collect()} == {
        ("document_relations", 2, "source_doc_id", "2024-05"), ("document_relations", 6, "target", "2024-05"), ("embedding_log", 2, "doc_id", "2024-07"), ("quality_reports", 9, "doc_id", "2024-05")}
    assert orphans_by_period(out).count() == 4
