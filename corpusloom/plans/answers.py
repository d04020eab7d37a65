"""Queries of model answers, rendered sources and further filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import answers, dates
from corpusloom.operators import evaluation, search
from corpusloom.plans import retrieval
from corpusloom.runtime import table


def judge_verdicts(spark, folder):
    e = table(spark, folder, "eval_items").select("item_id", F.concat(F.lit('Nota: {"score": '), F.when(F.col("item_id") % 11 == 0, '"4"').otherwise((F.col("item_id") % 8).cast("string")), F.lit(', "why": "x"}')).alias("t"))
    return e.select("item_id", evaluation.verdict(F.col("t")).alias("score"))


def rewritten_queries(spark, folder):
    """Answers with a list of queries; every third is no JSON and falls back to the question."""
    i = F.col("item_id")
    listed = F.concat(F.lit('Claro: {"queries": [{"text": " alvo '), i, F.lit(' ", "facet_type": "tema", "filters": [{"field": "status", "value": "active"}, {"field": "nada", "value": 1}]}, {"text": "ALVO '), i, F.lit('"}, {"text": "x"}, {"texto": 1}]}'))
    e = table(spark, folder, "eval_items").select(i.cast("string").alias("query_id"), F.col("query_text").alias("question"), F.when(i % 3 > 0, listed).otherwise("não sei [").alias("answer"))
    q = answers.rewritten_queries(e)
    return q.select("query_id", "query_idx", "text", "facet", F.size("filters").alias("n_filters"), F.size("sorts").alias("n_sorts"))


def rendered_sources(spark, folder):
    hits = retrieval.dense_topk(spark, folder).select("query_id", "rank", F.concat(F.lit("r"), "id").alias("regulation_id"), F.concat(F.lit(" corpo "), "id", F.lit(" ")).alias("text"))
    return answers.rendered_sources(hits, 100)


def amended_acts(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.concat("source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Altera o art. 1 da Lei nº 1."), F.col("doc_id"))).otherwise(" Revoga a Lei 2")).alias("t"))
    return d.select("doc_id", dates.amended_act(F.col("t")).alias("act"))


def _filtered(spark, folder, *conditions):
    c = retrieval._chunks(spark, folder)
    return search.SearchPlan(k=retrieval.K, mode="dense", conditions=list(conditions)).run(c, retrieval._queries(c)).select(*retrieval._HIT)


def dense_topk_current(spark, folder):
    c = retrieval._chunks(spark, folder)
    return search.dense_top_k(search.current(c), retrieval._queries(c), retrieval.K).select(*retrieval._HIT)


def dense_topk_dates(spark, folder):
    return _filtered(spark, folder, search.Condition("effective_date", "range", {"gte": "2000-03-01", "lt": "2001-01-01"}), search.Condition("status", "neq", "revoked"))


QUERIES = {f.__name__: f for f in (judge_verdicts, rewritten_queries, rendered_sources, amended_acts, dense_topk_current, dense_topk_dates)}

SQL = {
    "judge_verdicts": "SELECT item_id, CASE WHEN item_id % 11 > 0 AND item_id % 8 <= 5 THEN item_id % 8 END AS score FROM eval_items",
    "rewritten_queries": """SELECT CAST(item_id AS VARCHAR) AS query_id, 0 AS query_idx, CASE WHEN item_id % 3 > 0 THEN 'alvo ' || item_id ELSE query_text END AS text, CASE WHEN item_id % 3 > 0 THEN 'tema' ELSE 'original' END AS facet,
        CASE WHEN item_id % 3 > 0 THEN 1 ELSE 0 END AS n_filters, 0 AS n_sorts FROM eval_items""",
    "rendered_sources": f"""{retrieval._dense()}, b AS (SELECT query_id, rank, '[Source ' || rank || '] r' || id || chr(10) || 'corpo ' || id AS b FROM hits),
        u AS (SELECT *, rank = 1 OR sum(length(b)) OVER (PARTITION BY query_id ORDER BY rank) <= 100 AS open FROM b)
        SELECT query_id, string_agg(CASE WHEN open THEN b END, chr(10) || chr(10) ORDER BY rank) || CASE WHEN count(*) FILTER (NOT open) > 0 THEN chr(10) || chr(10) || chr(10) || '[... ' || count(*) FILTER (NOT open) || ' more sources truncated ...]' ELSE '' END AS sources
        FROM u GROUP BY query_id""",
    "amended_acts": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND source IS NOT NULL THEN 'lei-1' || doc_id END AS act FROM documents",
    "dense_topk_current": f"""{retrieval._dense("status = 'active' AND is_latest = 1")} SELECT * FROM hits""",
    "dense_topk_dates": f"""{retrieval._dense("status <> 'revoked' AND effective_date >= '2000-03-01' AND effective_date < '2001-01-01'")} SELECT * FROM hits""",
}
