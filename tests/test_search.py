import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ann, search
from corpusloom.operators.search import Condition, SearchPlan


def vectors(spark, n=300, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3]  # a tie
    df = spark.createDataFrame([(i, v.tolist(), "active" if i % 3 else "revoked", i % 4) for i, v in enumerate(x)] + [(9999, None, "active", 1)], "id bigint, embedding array<float>, status string, label int")
    return x.astype(np.float64), df


def brute(x, q, k, keep=lambda i: True):
    s = np.round(x @ x[q], 6)
    return sorted((i for i in range(len(x)) if keep(i)), key=lambda i: (-s[i], i))[:k]


def test_dense_against_brute_force(spark):
    x, df = vectors(spark)
    q = df.filter("id IN (3, 50, 9999)").withColumnRenamed("id", "query_id")
    got = search.dense_top_k(df.repartition(5), q, 6).collect()
    for i in (3, 50):
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == brute(x, i, 6)
    assert {r.query_id for r in got} == {3, 50}
    assert search.dense_top_k(df, q.limit(0), 6).count() == 0 and search.dense_top_k(df.limit(0), q, 6).count() == 0
    part = SearchPlan(k=4, mode="dense", conditions=[Condition("status", "eq", "active"), Condition("label", "in", [1, 2]), Condition("unknown", "eq", 1)]).run(df, q.filter("query_id = 50"))
    assert [r.id for r in part.orderBy("rank").collect()] == brute(x, 50, 4, lambda i: i % 3 and i % 4 in (1, 2))
    assert search.dense_top_k(df, q, 300, threshold=0.5).agg(F.min("score")).first()[0] >= 0.5


def test_blocks_of_queries(spark, monkeypatch):
    x, df = vectors(spark)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    q = df.filter("id < 20").withColumnRenamed("id", "query_id")
    got = search.dense_top_k(df, q, 3)
    assert {(r.query_id, r.id) for r in got.collect()} == {(i, j) for i in range(20) for j in brute(x, i, 3)}


def test_recall_of_the_approximate_index(spark):
    x, df = vectors(spark, 2000, 5)
    sample = ann.sample_of(df)
    centroids = ann.fit_cells(sample, 16)
    path = ann.build_index(df, centroids)
    assert spark.read.parquet(path).count() == 2000
    q = df.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.id) for r in ann.approximate_top_k(spark, path, centroids, q, 10, 8).collect()}
    want = {(i, j) for i in range(0, 2000, 100) for j in brute(x, i, 10)}
    assert len(got & want) >= 0.9 * len(want)
    assert ann.cells_for(2000) == 45 and ann.cells_for(10**12) == 4096 and ann.cells_for(0) == 1
    assert ann.approximate_top_k(spark, path, centroids, q.limit(0), 10, 8).count() == 0


def test_probes_follow_the_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    clustered = np.repeat(centres, 40, axis=0) + rng.normal(size=(800, 16)) * 0.1
    loose = rng.normal(size=(800, 16))
    for x, most in ((clustered, 4), (loose, 28)):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        x = x[rng.permutation(800)]
        c = ann.fit_cells(x, ann.cells_for(800))
        assert ann.probes_for(x, c, 10) <= most
    assert ann.probes_for(np.zeros((0, 4)), np.zeros((0, 4)), 10) == 1


def test_recall_of_the_registered_query(spark, data):
    from corpusloom.plans import retrieval, streaming

    got, want = ({(r.query_id, r.id) for r in q(spark, data).collect()} for q in (streaming.approx_topk, retrieval.dense_topk))
    assert want and len(got & want) >= 0.9 * len(want)


def test_sparse_blocks_and_repeated_indices(spark, monkeypatch):
    rows = [(i, [1, 2, i % 5 + 3], [1.0, 0.5 * i, 2.0]) for i in range(40)] + [(98, [1, 1], [1.0, 2.0]), (99, None, None), (97, [], [])]
    df = spark.createDataFrame(rows, "id bigint, indices array<bigint>, values array<double>")
    q = df.filter("id < 12 OR id >= 97").withColumnRenamed("id", "query_id")
    whole = {tuple(r) for r in search.sparse_vector_top_k(df, q, 4).collect()}
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert {tuple(r) for r in search.sparse_vector_top_k(df.repartition(4), q, 4).collect()} == whole

    def product(a, b):
        return sum(w * v for t, w in zip(*a) for u, v in zip(*b) if t == u)

    known = {i: (t, w) for i, t, w in rows if t}
    for i in (0, 5, 98):
        best = sorted(((round(product(known[i], x), 6), -j) for j, x in known.items()), reverse=True)[:4]
        assert {(r[1], r[2]) for r in whole if r[0] == i} == {(-j, s) for s, j in best}


def test_sparse_against_brute_force(spark):
    docs = [(1, "a b b c"), (2, "B, c. d"), (3, "x"), (4, None), (5, ""), (6, "a b b c"), (7, "b " * 500)]
    queries = [(1, "b c"), (2, "nada"), (3, None)]
    got = search.sparse_top_k(spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string"), 3).collect()
    q = search.term_weights(["b", "c"])
    score = {i: round(sum(w * q.get(t, 0) for t, w in search.term_weights(re.findall(r"\w+", t_.lower())).items()), 6) for i, t_ in docs if t_}
    assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((i, s) for i, s in score.items() if s > 0), key=lambda p: (-p[1], p[0]))[:3]


def test_fusion(spark):
    mk = lambda rows: spark.createDataFrame(rows, "query_id bigint, id bigint, score double, rank int")
    a, b = mk([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 13, 0.1, 3)]), mk([(1, 11, 5.0, 1), (1, 12, 4.0, 2)])
    got = [(r.id, r.score) for r in search.fuse([a, b], 4).orderBy("rank").collect()]
    assert got == [(11, 0.833333), (10, 0.5), (12, 0.333333), (13, 0.25)]
    assert {(r.id, r.score) for r in search.fuse([b, a], 4).collect()} == set(got)


def test_plan_needs_vectors(spark):
    with pytest.raises(ValueError):
        SearchPlan(mode="sparse").run(spark.range(1), spark.range(1))


@pytest.mark.parametrize("conditions, strict, ids", [
    ([Condition("effective_date", "eq", "2020-01-02")], True, [2]), ([Condition("effective_date", "range", {"gte": "2020-01-01", "lt": "2020-01-02"})], True, [1]), ([Condition("label", "neq", 1)], True, [2, 3]),
    ([Condition("label", "neq", 1)], False, [1, 2, 3]), ([Condition("label", "in", [1])], False, [1, 2, 3]), ([Condition("label", "gte", 1), Condition("effective_date", "gt", "2020-01-01")], True, [2])])
def test_filters(spark, conditions, strict, ids):
    df = spark.createDataFrame([(1, "2020-01-01", 1), (2, "2020-01-02", 2), (3, "quebrado", None)], "id int, effective_date string, label int")
    p = search.predicate(conditions, strict)
    assert [r.id for r in (df if p is None else df.filter(p)).orderBy("id").collect()] == ids


def test_after_a_search(spark):
    hits = spark.createDataFrame([(1, "r1", "x", 0.5, None), (2, "r2", "y", 0.9, "b"), (3, "r1", "x", 0.7, "a"), (4, "r1", "x", 0.7, "z")], "seq bigint, regulation_id string, text string, score double, title string")
    got = search.dedup_hits(hits, search.dedup_key(F.col("regulation_id"), F.col("text"))).orderBy("seq").collect()
    assert [(r.seq, r.score, r.title) for r in got] == [(1, 0.7, "a"), (2, 0.9, "b")]
    assert [r.seq for r in search.sort_hits(hits, [("title", "desc")]).collect()] == [4, 2, 3, 1]
    assert [r.relevance for r in search.rerank(hits.limit(1), F.lit(0.0), 50.0).collect()] == [50.0] and search.rerank(hits, F.lit(-5.0), 30.0).count() == 0
    scored = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.0), (3, 2, 0.7)], "id int, query_id int, score double")
    assert {tuple(r) for r in search.best_query(scored).collect()} == {(1, 1, 0.5), (3, 2, 0.7)}
    docs = spark.createDataFrame([("a", "u", "T"), ("b", "", "N")], "doc_id string, url string, title string")
    rows = spark.createDataFrame([("a", None, ""), ("b", None, ""), ("c", "k", "t")], "doc_id string, url string, title string")
    assert {tuple(r) for r in search.enrich(rows, docs, ["url", "title"]).collect()} == {("a", "u", "T"), ("b", None, None), ("c", "k", "t")}
    c = spark.createDataFrame([("ica", "1", "Um", None, "corpo")], "doc_type string, number string, title string, authority string, text string")
    from corpusloom.functions.projections import contexts

    c = c.selectExpr("1 AS query_id", "*").withColumn("rank", F.lit(1))
    assert contexts(c).first().context == "[ica 1]\nTítulo: Um\ncorpo"
