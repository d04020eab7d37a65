from pyspark.sql import functions as F

from corpusloom.functions.ids import content_hash
from corpusloom.operators import audit, store
from corpusloom.runtime import scratch_path, shared_dir

DOC = "doc_id string, source string, content string, content_hash string, scraped_at string, updated_at string, is_latest int, status string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumn("content_hash", content_hash(F.col("content")))


def test_upsert(spark):
    old = docs(spark, [("a", "s", "um", None, "t0", "t0", 0, "superseded"), ("b", "s", "dois", None, "t0", "t0", 1, "active"), (None, "s", "x", None, "t0", "t0", 1, "active")])
    new = docs(spark, [("a", "z", "UM  ", None, "t1", "t1", 1, "active"), ("b", "z", "outro", None, "t1", "t1", 1, "active"), ("c", "z", "tres", None, "t1", "t1", 1, "active"), ("c", "z", "tres", None, "t1", "t1", 1, "active"), (None, "z", "y", None, "t1", "t1", 1, "active")])
    assert {tuple(r) for r in store.upsert_actions(old, new).collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "inserted")}
    out = {r.doc_id: r for r in store.upsert(old, new).collect()}
    assert len(out) == 4 and out[None].content == "x"
    assert (out["a"].status, out["a"].updated_at, out["b"].source, out["b"].scraped_at, out["b"].updated_at, out["b"].content) == ("superseded", "t0", "s", "t0", "t1", "outro")
    again = store.upsert(store.upsert(old, new), new)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in store.upsert(old, new).collect()}
    assert store.upsert(old.limit(0), new).count() == 3 and store.upsert(old, new.limit(0)).count() == 3


def test_relations(spark):
    rel = "source_doc_id string, target_ref string, relation_type string, target_doc_id string"
    old = spark.createDataFrame([("a", "200", "amends", None), ("a", "100", "amends", "x")], rel)
    new = spark.createDataFrame([("a", "100", "amends", None), ("a", "200", "amends", "y"), ("b", None, "revokes", None), ("b", None, "revokes", None)], rel)
    assert {tuple(r) for r in store.merge_relations(old, new).collect()} == {("a", "100", "amends", "x"), ("a", "200", "amends", "y"), ("b", None, "revokes", None)}
    d = spark.createDataFrame([("p", "s:200"), ("o", "s:200"), ("q", None)], "doc_id string, source_ref string")
    assert {(r.target_ref, r.target_doc_id) for r in store.resolve_relations(old, d).collect()} == {("200", "o"), ("100", "x")}


def test_cascade(spark):
    d = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", None)], "doc_id string, source string")
    log = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    rel = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "source_doc_id string, target_doc_id string")
    x, y, z = store.cascade_delete(d, log, rel, "s")
    assert {r.doc_id for r in x.collect()} == {"b", "c"} and {r.doc_id for r in y.collect()} == {"b"} and {tuple(r) for r in z.collect()} == {("b", None), ("b", "c")}


def test_versions(spark):
    d = spark.createDataFrame(
        [("a/1", "a", "2001", 1, "active"), ("a/2", "a", "2002", 0, "revoked"), ("a/0", "a", None, 1, "active"), ("b2", "b", "2000", 0, "active"), ("b1", "b", "2000", 0, "active"), ("z", None, "1", 1, "active")],
        "doc_id string, canonical_id string, version_year string, is_latest int, status string")
    assert {(r.canonical_id, r.doc_id) for r in store.latest_versions(d).collect()} == {("a", "a/2"), ("b", "b1")}
    out = {r.doc_id: (r.is_latest, r.status) for r in store.supersede(d).collect()}
    assert out == {"a/1": (0, "superseded"), "a/2": (1, "revoked"), "a/0": (0, "superseded"), "b1": (1, "active"), "b2": (0, "superseded"), "z": (1, "active")}
    assert audit.best_document(d.select("canonical_id").distinct(), d).count() == 3


def test_incremental_and_sets(spark):
    d = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "h"), (None, "h")], "doc_id string, content_hash string")
    log = spark.createDataFrame([(1, "a", "h", "hybrid", "t"), (2, "b", "old", "hybrid", "t"), (3, "c", "h", "dense", "t"), (4, "a", "old", "hybrid", "s")], "log_id bigint, doc_id string, content_hash string, embedding_mode string, embedded_at string")
    assert {r.doc_id for r in store.incremental_work(d, log, "hybrid").collect()} == {"b", "c", "d", None}
    old, new = spark.createDataFrame([(1, None)], "a int, b string"), spark.createDataFrame([(1, None), (1, "x"), (1, "x")], "a int, b string")
    assert [tuple(r) for r in store.insert_new(old, new, ["a", "b"]).collect()] == [(1, "x")]
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), (None, 1, "n")], "k string, o int, v string")
    assert [r.v for r in store.first_seen(rows, F.col("k"), ["o", "v"]).collect()] == ["a"]


def test_replace_table_is_atomic(spark):
    path = scratch_path(spark, "t")
    store.replace_table(spark.range(3).toDF("id"), path)
    store.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and shared_dir(spark) in path


def test_missing_chunks(spark):
    d = spark.createDataFrame([("a", "A", "active", 1), ("b", "B", "active", 1), ("c", "C", "active", 0), ("e", "E", "active", 1)], "doc_id string, canonical_id string, status string, is_latest int")
    c = spark.createDataFrame([("A", 1), ("B", 0), ("B", 0)], "canonical_id string, is_latest int")
    assert {tuple(r) for r in audit.missing_chunks(d, c).collect()} == {("b", "B", 2), ("e", "E", 0)}
    assert audit.ordered_columns(spark.range(1).selectExpr("1 AS z", "2 AS input__a", "3 AS query"), ["query"]).columns == ["query", "input__a", "z"]
