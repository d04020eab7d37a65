"""Queries of search, evaluation, traces, feedback and event windows, with their SQL.

Chunks are the rows of ``embeddings`` with attributes derived from their id (``_chunks``); every chunk whose id is divisible
by 100 is a query against all chunks. Events stand for feedback: their type gives the kind, their user the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import audit, evaluation, feedback, search
from corpusloom.runtime import table
from corpusloom.streaming import feedback as streams

K = 10


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    i = F.col("vec_id")
    day = F.date_add(F.lit("2000-01-01").cast("date"), (i % 9000).cast("int"))
    strong = F.filter(F.transform("embedding", lambda v, k: F.struct(k.cast("bigint").alias("k"), v.cast("double").alias("v"))), lambda x: x["v"] > 0.15)
    return e.select(
        i.alias("id"), "embedding", "label",
        F.when(i % 11 == 0, "revoked").otherwise("active").alias("status"),
        F.when(i % 7 == 0, 0).otherwise(1).alias("is_latest"),
        F.date_format(day, "yyyy-MM-dd").alias("effective_date"),
        F.when(i % 5 == 0, F.date_format(F.date_add(day, 3650), "yyyy-MM-dd")).alias("expiry_date"),
        F.transform(strong, lambda x: x["k"]).alias("indices"), F.transform(strong, lambda x: x["v"]).alias("values"),
    )


def _queries(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding", "indices", "values")


_HIT = ("query_id", "id", "score", "rank")


def dense_topk(spark, folder):
    c = _chunks(spark, folder)
    return search.SearchPlan(k=K, mode="dense").run(c, _queries(c)).select(*_HIT)


def dense_topk_filtered(spark, folder):
    c = _chunks(spark, folder)
    plan = search.SearchPlan(k=K, mode="dense", conditions=[search.Condition("status", "eq", "active"), search.Condition("is_latest", "eq", 1), search.Condition("label", "in", [1, 2, 3])])
    return plan.run(c, _queries(c)).select(*_HIT)


def dense_topk_threshold(spark, folder):
    c = _chunks(spark, folder)
    return search.SearchPlan(k=K, mode="dense", threshold=0.3).run(c, _queries(c)).select(*_HIT)


def temporal_search(spark, folder):
    c = _chunks(spark, folder)
    return search.SearchPlan(k=K, mode="dense", day="2004-06-30").run(c, _queries(c)).select(*_HIT)


def sparse_vector_topk(spark, folder):
    c = _chunks(spark, folder)
    return search.SearchPlan(k=K, mode="sparse").run(c, _queries(c)).select(*_HIT)


def hybrid_rrf(spark, folder):
    c = _chunks(spark, folder)
    return search.SearchPlan(k=5, mode="hybrid").run(c, _queries(c)).select(*_HIT)


def sparse_topk(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("passage").alias("text"))
    return search.sparse_top_k(docs, queries, 5).select(*_HIT)


def cosine_pairs(spark, folder):
    """Similarity of each chunk with the first one of its label (SCH-21), by an equality join."""
    c = _chunks(spark, folder).select("id", "label", "embedding")
    first = c.groupBy("label").agg(F.min_by("embedding", "id").alias("e0"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(F.col("embedding"), F.col("e0")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("e0"), F.col("e0")))
    return c.join(first, "label").select("id", F.round(cosine, 6).alias("cosine"))


def _hits(spark, folder):
    """Hits of all queries in the order of query and rank, with the document fields that follow-ups use."""
    hits = dense_topk(spark, folder)
    return hits.select(
        *_HIT, (F.col("query_id") * 1000 + F.col("rank")).alias("seq"), F.concat(F.lit("chunk-"), F.col("id") % 97).alias("regulation_id"),
        F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("title"),
    )


def multi_query_dedup(spark, folder):
    return search.dedup_hits(_hits(spark, folder), F.col("regulation_id")).select("seq", "regulation_id", "id", "score")


def sort_widened(spark, folder):
    deduped = search.dedup_hits(_hits(spark, folder), F.col("regulation_id"))
    return search.widened(deduped, 5, [("title", "desc")], 10).select("regulation_id", "title", "id")


def enrich_left(spark, folder):
    hits = table(spark, folder, "embedding_log").select("log_id", "doc_id", F.lit("").alias("title"), F.lit(None).cast("string").alias("url")).distinct()
    return search.enrich(hits, table(spark, folder, "store_documents"), ["url", "title"]).select("log_id", "doc_id", "url", "title")


def rerank_sigmoid_threshold(spark, folder):
    return search.rerank(_hits(spark, folder), F.col("score") * 4 - 2, 30.0, digits=4).select("query_id", "id", "relevance")


def multi_query_best(spark, folder):
    return search.best_query(dense_topk(spark, folder))


def context_topk(spark, folder):
    ranked = search.rerank(_hits(spark, folder), F.col("score") * 4 - 2, 0.0, digits=6).withColumn("text", F.concat("regulation_id", "title")).filter("query_id <> id")
    return search.context(ranked).select("id", "relevance", "text")


def _expected(spark, folder):
    """The first five other chunks of the query's label are expected: three relevant, two moderate."""
    from pyspark.sql import Window

    c = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label")
    firsts = c.withColumn("seq", F.row_number().over(Window.partitionBy("label").orderBy("id"))).filter("seq <= 5")
    q = c.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "label")
    return q.join(firsts, "label").select("query_id", "seq", "id", F.when(F.col("seq") <= 3, "relevant").otherwise("moderate").alias("relevance"))


def _metrics(spark, folder):
    return evaluation.query_metrics(evaluation.graded_hits(dense_topk(spark, folder), _expected(spark, folder), K), K)


def ir_metrics_per_query(spark, folder):
    m = _metrics(spark, folder)
    return m.select("query_id", "hit", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg")))


def ir_metrics_summary(spark, folder):
    s = evaluation.summary(_metrics(spark, folder))
    return s.select("n_queries", *(F.round(c, 6).alias(c) for c in ("hit_rate", "precision", "recall", "mrr", "ndcg")))


def response_heuristics(spark, folder):
    d = table(spark, folder, "store_documents").select(F.col("title").alias("response"), F.array(F.concat_ws(" ", F.upper("doc_type"), "number")).alias("sources"))
    r = evaluation.response_metrics(d)
    return r.select("n_responses", *(F.round(c, 6).alias(c) for c in ("empty_rate", "citation_rate", "hedging_rate", "grounding_rate")))


def upper_median(spark, folder):
    d = table(spark, folder, "documents").withColumn("n", F.length("text"))
    return evaluation.upper_median_by(d, ["source"], "n")


def trace_explode(spark, folder):
    hits = dense_topk(spark, folder).filter("rank <= 5")
    docs = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("r"), "id").alias("regulation_id"), "score"))), lambda x: F.struct(x["regulation_id"].alias("regulation_id"), x["score"].alias("score")))
    traces = hits.groupBy("query_id").agg(docs.alias("d"))  # five rows a query
    whole = traces.select(
        "query_id",
        F.array(F.struct(F.lit("main").alias("text"), F.col("d").alias("documents")), F.struct(F.lit("empty").alias("text"), F.slice("d", 1, 0).alias("documents"))).alias("sub_queries"),
        F.transform(F.slice("d", 1, 3), lambda x: F.struct(x["regulation_id"].alias("regulation_id"), F.round(100 * x["score"], 4).alias("relevance"))).alias("evaluations"),
        F.transform(F.slice("d", 1, 2), lambda x: x["regulation_id"]).alias("generator"),
    )
    return audit.explode_trace(whole)


# ---- feedback and events


def _feedback(spark: SparkSession, folder: str) -> DataFrame:
    return feedback_events(table(spark, folder, "events"))


def feedback_events(e: DataFrame) -> DataFrame:
    t = F.col("event_type")
    categories = F.array(*(F.lit(c) for c in feedback.CATEGORIES))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 10).cast("string").alias("message_id"),
        F.when(t.isin("click", "error"), "thumbs").when(t == "view", "star").when(t == "purchase", "comment").otherwise("clear").alias("kind"),
        F.when(t == "click", "up").when(t == "error", "down").alias("thumbs"),
        F.when(t == "view", F.element_at(categories, k % 5 + 1)).alias("star_category"),
        F.when(t == "view", F.nullif((F.floor("value") % 7).cast("int"), F.lit(6))).alias("star_value"),
        F.when(t == "purchase", F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("comment"), F.col("ts").alias("created_at"), "value",
    )


def feedback_current(spark, folder):
    return feedback.current_feedback(_feedback(spark, folder).filter(feedback.valid_event())).drop("last_event_at")


def feedback_valid(spark, folder):
    return _feedback(spark, folder).groupBy("kind", feedback.valid_event().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def avg_stars_by_category(spark, folder):
    e = _feedback(spark, folder).filter("kind = 'star' AND star_value BETWEEN 1 AND 5")
    return e.groupBy("star_category").agg(F.round(F.avg("star_value"), 2).alias("avg_stars"), F.count(F.lit(1)).alias("n"))


def thumbs_down_window(spark, folder):
    at = F.lit("2024-01-20").cast("timestamp")
    recent = _feedback(spark, folder).filter((F.col("kind") == "thumbs") & (F.col("thumbs") == "down") & (F.col("created_at") >= at - F.expr("INTERVAL 7 DAYS")) & (F.col("created_at") < at))
    return recent.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def feedback_preview(spark, folder):
    e = _feedback(spark, folder).filter("kind = 'comment'")
    return e.orderBy(F.desc("created_at"), F.desc("event_id")).limit(200).select("event_id", F.substring("comment", 1, 300).alias("preview"))


def backfill_dedup(spark, folder):
    e = _feedback(spark, folder).filter("kind = 'star'").select("session_id", "message_id", "kind", "star_category", "star_value")
    return e.distinct()


def _turns(spark, folder):
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), F.when(F.col("event_type").isin("view", "click"), "user").otherwise("assistant").alias("role"), F.concat("event_type", F.lit(" \n "), F.col("event_id").cast("string")).alias("content"))


def context_window_last_n(spark, folder):
    return feedback.last_turns(_turns(spark, folder), 10).select("session_id", "turn")


def prev_user_message(spark, folder):
    return feedback.previous_question(_turns(spark, folder)).select("session_id", "turn", "question")


def chat_title(spark, folder):
    return feedback.chat_title(_turns(spark, folder))


def event_windows(spark, folder):
    w = streams.windowed_counts(table(spark, folder, "events"), width="1 day")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", F.round("total", 2).alias("total"))


def session_window_events(spark, folder):
    s = streams.session_windows(table(spark, folder, "events"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return s.select("user_id", stamp("session_start").alias("session_start"), "n_events")


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, dense_topk_filtered, dense_topk_threshold, temporal_search, sparse_vector_topk, hybrid_rrf, sparse_topk, cosine_pairs, multi_query_dedup, sort_widened,
        enrich_left, rerank_sigmoid_threshold, multi_query_best, context_topk, ir_metrics_per_query, ir_metrics_summary, response_heuristics, upper_median, trace_explode,
        feedback_current, feedback_valid, avg_stars_by_category, thumbs_down_window, feedback_preview, backfill_dedup, context_window_last_n, prev_user_message, chat_title,
        event_windows, session_window_events,
    )
}

_C = """WITH c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label, CASE WHEN vec_id % 11 = 0 THEN 'revoked' ELSE 'active' END AS status, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 1 END AS is_latest,
    strftime(DATE '2000-01-01' + CAST(vec_id % 9000 AS INT), '%Y-%m-%d') AS effective_date,
    CASE WHEN vec_id % 5 = 0 THEN strftime(DATE '2000-01-01' + CAST(vec_id % 9000 AS INT) + 3650, '%Y-%m-%d') END AS expiry_date FROM embeddings),
    q AS (SELECT id AS query_id, e AS qe FROM c WHERE id % 100 = 0)"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"


def _dense(where: str = "true", k: int = K, after: str = "true", name: str = "hits") -> str:
    return f"""{_C}, {name}_s AS (SELECT query_id, id, round(list_dot_product(qe, e), 6) AS score FROM q, c WHERE {where}),
    {name} AS (SELECT query_id, id, score, {_RANK} AS rank FROM {name}_s WHERE {after} QUALIFY rank <= {k})"""


_SPARSE = """sp AS (SELECT id, unnest(range(len(e))) AS t, unnest(e) AS w FROM c), st AS (SELECT * FROM sp WHERE w > 0.15),
    ss AS (SELECT qs.id AS query_id, ds.id, round(sum(qs.w * ds.w), 6) AS score FROM st qs JOIN st ds USING (t) WHERE qs.id % 100 = 0 GROUP BY ALL)"""
_HITS = f"""{_dense()}, h AS (SELECT *, query_id * 1000 + rank AS seq, 'chunk-' || (id % 97) AS regulation_id, CASE WHEN id % 3 = 0 THEN '' ELSE 't' || id END AS title FROM hits)"""
_DEDUP = f"""{_HITS}, d AS (SELECT *, min(seq) OVER (PARTITION BY regulation_id) AS first_seq, row_number() OVER (PARTITION BY regulation_id ORDER BY score DESC, seq) AS r FROM h)"""
_GRADED = f"""{_dense()}, x AS (SELECT q.query_id, f.id, f.seq, CASE WHEN f.seq <= 3 THEN 2.0 ELSE 1.0 END AS gain FROM q JOIN c qc ON qc.id = q.query_id
        JOIN (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS seq FROM c) f ON f.label = qc.label WHERE f.seq <= 5),
    ideal AS (SELECT query_id, count(*) AS n, sum(gain / log2(seq + 1)) AS idcg FROM x GROUP BY query_id),
    got AS (SELECT x.query_id, count(*) AS m, sum(gain / log2(rank + 1)) AS dcg, min(CASE WHEN gain = 2 THEN rank END) AS r FROM x JOIN hits USING (query_id, id) GROUP BY x.query_id),
    per AS (SELECT query_id, CAST(coalesce(m, 0) > 0 AS INT) AS hit, coalesce(m, 0) / {float(K)} AS precision, coalesce(m, 0) / n AS recall, coalesce(1.0 / r, 0.0) AS reciprocal_rank, coalesce(dcg / idcg, 0.0) AS ndcg
        FROM ideal LEFT JOIN got USING (query_id))"""
_FB = """WITH f AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, CAST(event_id % 10 AS VARCHAR) AS message_id,
    CASE WHEN event_type IN ('click', 'error') THEN 'thumbs' WHEN event_type = 'view' THEN 'star' WHEN event_type = 'purchase' THEN 'comment' ELSE 'clear' END AS kind,
    CASE event_type WHEN 'click' THEN 'up' WHEN 'error' THEN 'down' END AS thumbs,
    CASE WHEN event_type = 'view' THEN ['relevance', 'clarity', 'completeness', 'accuracy', 'overall'][CAST(json_extract(props, '$.k') AS INT) % 5 + 1] END AS star_category,
    CASE WHEN event_type = 'view' THEN nullif(CAST(floor(value) AS INT) % 7, 6) END AS star_value,
    CASE WHEN event_type = 'purchase' THEN 'c' || event_id END AS comment, ts AS created_at FROM events)"""
_TURNS = """WITH t AS (SELECT user_id AS session_id, event_id AS turn, CASE WHEN event_type IN ('view', 'click') THEN 'user' ELSE 'assistant' END AS role, event_type || ' ' || chr(10) || ' ' || event_id AS content FROM events)"""
_STAR = lambda c: f"arg_max(CASE WHEN star_category = '{c}' THEN coalesce(star_value, -1) END, CASE WHEN star_category = '{c}' THEN event_id END)"

_TERMS = r"SELECT {0} AS id, t.term, count(*) AS n, max(t.len) AS len FROM (SELECT {0}, unnest(w) AS term, len(w) AS len FROM (SELECT {0}, regexp_extract_all(lower({1}), '[\pL\pN_]+') AS w FROM {2})) t GROUP BY ALL"
_WEIGHT = "{0}.n * 2.2 / ({0}.n + 1.2 * (0.25 + 0.75 * {0}.len / 256))"
_ANY = lambda phrases: "(" + " OR ".join(f"contains(lower(title), '{p}')" for p in phrases) + ")"

SQL = {
    "dense_topk": f"{_dense()} SELECT * FROM hits",
    "sparse_topk": f"""WITH d AS ({_TERMS.format('doc_id', 'text', 'documents')}), q AS ({_TERMS.format('item_id', 'passage', 'eval_items')}),
        s AS (SELECT q.id AS query_id, d.id, round(sum({_WEIGHT.format('d')} * {_WEIGHT.format('q')}), 6) AS score FROM q JOIN d USING (term) GROUP BY ALL)
        SELECT query_id, id, score, {_RANK} AS rank FROM s QUALIFY rank <= 5""",
    "response_heuristics": f"""WITH r AS (SELECT title, upper(doc_type) || ' ' || number AS source, regexp_extract_all(title, '{evaluation.CITATION}', 1) AS strict, regexp_extract_all(title, '{evaluation.LOOSE_CITATION}', 1) AS loose FROM store_documents),
        c AS (SELECT title, concat_ws(' ', source) AS s, CASE WHEN len(strict) > 0 THEN strict ELSE loose END AS c FROM r),
        g AS (SELECT title, coalesce(len(c), 0) AS n, coalesce(len([x for x in c if x = s OR starts_with(s, x || '-art') OR starts_with(x, s || '-art')]), 0) AS k FROM c)
        SELECT count(*) AS n_responses, round(avg(CAST(coalesce(trim(coalesce(title, '')) = '' OR {_ANY(evaluation.EMPTY_PHRASES)}, false) AS INT)), 6) AS empty_rate, round(avg(CAST(n > 0 AS INT)), 6) AS citation_rate,
            round(avg(CAST(coalesce({_ANY(evaluation.HEDGE_PHRASES)}, false) AS INT)), 6) AS hedging_rate, round(sum(k) / sum(n), 6) AS grounding_rate FROM g""",
    "dense_topk_filtered": f"""{_dense("status = 'active' AND is_latest = 1 AND label IN (1, 2, 3)")} SELECT * FROM hits""",
    "dense_topk_threshold": f"{_dense(after='score >= 0.3')} SELECT * FROM hits",
    "temporal_search": f"""{_dense("status = 'active' AND effective_date <= '2004-06-30' AND (expiry_date >= '2004-06-30' OR expiry_date IS NULL)")} SELECT * FROM hits""",
    "sparse_vector_topk": f"{_C}, {_SPARSE} SELECT query_id, id, score, {_RANK} AS rank FROM ss QUALIFY rank <= {K}",
    "hybrid_rrf": f"""{_dense(k=15, name="a")}, {_SPARSE}, b AS (SELECT query_id, id, {_RANK} AS rank FROM ss QUALIFY rank <= 15),
        u AS (SELECT query_id, id, 1.0 / (2 + rank - 1) AS part, rank AS f FROM a UNION ALL SELECT query_id, id, 1.0 / (2 + rank - 1), NULL FROM b),
        s AS (SELECT query_id, id, round(CAST(sum(part) AS DOUBLE), 6) AS score, min(f) AS f FROM u GROUP BY query_id, id)
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f NULLS LAST, id) AS rank FROM s QUALIFY rank <= 5""",
    "cosine_pairs": f"""{_C}, f AS (SELECT label, arg_min(e, id) AS e0 FROM c GROUP BY label) SELECT id, round(list_cosine_similarity(e, e0), 6) AS cosine FROM c JOIN f USING (label)""",
    "multi_query_dedup": f"{_DEDUP} SELECT first_seq AS seq, regulation_id, id, score FROM d WHERE r = 1",
    "sort_widened": f"{_DEDUP} SELECT regulation_id, title, id FROM d WHERE r = 1 ORDER BY title DESC, first_seq LIMIT 50",
    "enrich_left": """WITH m AS (SELECT * FROM (SELECT doc_id, url, title, row_number() OVER (PARTITION BY doc_id ORDER BY url NULLS FIRST, title NULLS FIRST) AS r FROM store_documents WHERE length(url) > 0) WHERE r = 1)
        SELECT DISTINCT log_id, l.doc_id, m.url, m.title FROM embedding_log l LEFT JOIN m ON l.doc_id = m.doc_id""",
    "rerank_sigmoid_threshold": f"{_dense()} SELECT query_id, id, round(100 / (1 + exp(2 - score * 4)), 4) AS relevance FROM hits WHERE 100 / (1 + exp(2 - score * 4)) >= 30",
    "multi_query_best": f"{_dense()} SELECT id, query_id, score FROM hits WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, query_id) = 1",
    "context_topk": f"{_HITS} SELECT id, round(100 / (1 + exp(2 - score * 4)), 6) AS relevance, regulation_id || title AS text FROM h WHERE query_id <> id ORDER BY relevance DESC, id LIMIT 7",
    "ir_metrics_per_query": f"{_GRADED} SELECT query_id, hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM per",
    "ir_metrics_summary": f"""{_GRADED} SELECT count(*) AS n_queries, round(avg(hit), 6) AS hit_rate, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM per""",
    "upper_median": "SELECT source, list_sort(list(length(text)))[len(list(length(text))) // 2 + 1] AS upper_median FROM documents WHERE text IS NOT NULL GROUP BY source",
    "trace_explode": f"""{_dense(k=5)} SELECT query_id, 0 AS sub_index, 'main' AS sub_query, rank - 1 AS rank, 'r' || id AS regulation_id, score, CASE WHEN rank <= 3 THEN round(100 * score, 4) END AS relevance, rank <= 2 AS in_context FROM hits
        UNION ALL SELECT query_id, 1, 'empty', NULL, NULL, NULL, NULL, false FROM q""",
    "feedback_current": f"""{_FB} SELECT session_id, message_id, arg_max(thumbs, event_id) FILTER (kind = 'thumbs') AS last_thumbs,
        {', '.join(f"nullif({_STAR(c)}, -1) AS rating_{c}" for c in ('relevance', 'clarity', 'completeness', 'accuracy', 'overall'))},
        arg_max(comment, event_id) FILTER (kind = 'comment') AS last_comment, max(event_id) AS last_event_id FROM f GROUP BY session_id, message_id""",
    "feedback_valid": f"""{_FB} SELECT kind, CASE kind WHEN 'thumbs' THEN thumbs IN ('up', 'down') WHEN 'star' THEN star_category IN ('relevance', 'clarity', 'completeness', 'accuracy', 'overall') AND coalesce(star_value BETWEEN 0 AND 5, true)
        ELSE kind IN ('comment', 'clear') END AS valid, count(*) AS n FROM f GROUP BY ALL""",
    "avg_stars_by_category": f"{_FB} SELECT star_category, round(avg(star_value), 2) AS avg_stars, count(*) AS n FROM f WHERE kind = 'star' AND star_value BETWEEN 1 AND 5 GROUP BY star_category",
    "thumbs_down_window": f"{_FB} SELECT session_id, count(*) AS n FROM f WHERE thumbs = 'down' AND created_at >= TIMESTAMP '2024-01-13' AND created_at < TIMESTAMP '2024-01-20' GROUP BY session_id",
    "feedback_preview": f"{_FB} SELECT event_id, substr(comment, 1, 300) AS preview FROM f WHERE kind = 'comment' ORDER BY created_at DESC, event_id DESC LIMIT 200",
    "backfill_dedup": f"{_FB} SELECT DISTINCT session_id, message_id, kind, star_category, star_value FROM f WHERE kind = 'star'",
    "context_window_last_n": f"{_TURNS} SELECT session_id, turn FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 10",
    "prev_user_message": f"""{_TURNS} SELECT session_id, turn, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM t""",
    "chat_title": f"""{_TURNS} SELECT session_id, replace(arg_min(content, turn), chr(10), ' ') AS title FROM t WHERE role = 'user' GROUP BY session_id""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "session_window_events": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 60 MINUTES THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, count(*) AS n_events FROM s GROUP BY user_id, k""",
}
