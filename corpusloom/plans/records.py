"""Queries of records, prompts, reports and sinks, with their SQL.

Hits are the rows of the dense search with the fields of a stored document each (``_hits``); the golden set is ``eval_items``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import ids, projections, quality
from corpusloom.operators import feedback, reports, search, store
from corpusloom.plans import retrieval
from corpusloom.runtime import scratch_path, table
from corpusloom.sources import sinks


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "store_documents")


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("id")
    fields = {
        "doc_type": F.when(i % 4 == 1, "ICA").when(i % 4 == 2, "MCA").when(i % 4 == 3, "Lei"),
        "number": i.cast("string"),
        "title": F.when(i % 3 > 0, F.concat(F.lit("Título "), i)).otherwise(""),
        "authority": F.when(i % 5 > 0, "DECEA"),
        "text": F.concat(F.lit("corpo do texto "), i),
    }
    return retrieval.dense_topk(spark, folder).withColumns(fields).withColumn("regulation_id", F.concat(F.lit("r"), F.col("id")))


def article_projection(spark, folder):
    a = projections.article(_docs(spark, folder).withColumn("content", F.length("content")))
    return a.select("regulation_id", "title", "text", "effective_date", "expiry_date", "status", "version_year", "is_latest", "canonical_id", F.col("metadata.type").alias("type"), F.col("metadata.url").alias("url"), F.col("metadata.number").alias("number"), F.col("metadata.authority").alias("authority"))


def publication_dates(spark, folder):
    d = table(spark, folder, "events").select("event_id", F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "2020-01-01").when(F.col("event_id") % 3 == 1, "").alias("date"), F.when(F.col("event_id") % 2 == 0, "2021-01-01").alias("publication_date"), F.lit("2022-01-01").alias("date_published"))).alias("metadata"))
    return d.select("event_id", projections.publication_date().alias("published"))


def temporal_override(spark, folder):
    d = _docs(spark, folder).select("doc_id", "status", "expiry_date", "scraped_at").distinct()
    status, expiry = projections.temporal_override(F.col("status"), F.lit("active"), F.col("expiry_date"), F.substring("scraped_at", 1, 10))
    return d.select("doc_id", status.alias("status"), expiry.alias("expiry_date")).distinct()


def payload_flatten(spark, folder):
    h = _hits(spark, folder).select("query_id", "id", "score", F.struct("regulation_id", "title", F.lit(-1.0).alias("score")).alias("payload"))
    return projections.flattened(h)


def trace_documents(spark, folder):
    return projections.trace_documents(_hits(spark, folder))


def type_labels(spark, folder):
    kind = ids.doc_type_name(F.col("doc_type"))
    return _docs(spark, folder).groupBy(kind.alias("doc_type")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", projections.type_label(F.col("doc_type")))


def byte_sizes(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars")).alias("n"))
    return d.select("doc_id", projections.byte_size(F.col("n")).alias("size"))


def generator_context(spark, folder):
    return projections.contexts(_hits(spark, folder), 12)


def generator_prompt(spark, folder):
    history = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("antes "), F.col("query_id")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("sim").alias("content")))
    c = generator_context(spark, folder).withColumn("context", F.when(F.col("query_id") % 200 == 0, "").otherwise(F.col("context")))
    return c.select("query_id", projections.prompt(F.concat(F.lit("pergunta "), F.col("query_id")), F.col("context"), F.when(F.col("query_id") % 300 > 0, history)).alias("prompt"))


def evaluator_text(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "title", "doc_kind", "source", "text")
    t = projections.evaluator_text(F.col("title"), F.col("doc_kind"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")), F.col("source"), F.col("text"), 40)
    return d.select("doc_id", t.alias("eval_text"))


def search_queries(spark, folder):
    e = table(spark, folder, "eval_items").select("item_id", "query_text")
    turn = lambda i, role: F.struct(F.lit(role).alias("role"), F.concat(F.lit(f"m{i} "), F.col("item_id")).alias("content"))
    every = F.array(*(turn(i, "user" if i % 3 else "assistant") for i in range(7)))
    return e.select("item_id", projections.search_text(F.col("query_text"), F.slice(every, 1, (F.col("item_id") % 7 + 1).cast("int"))).alias("search_text"))


def text_dates(spark, folder):
    d = _docs(spark, folder).select("doc_id", "content").distinct()
    return d.select("doc_id", projections.free_text_date(F.col("content")).alias("text_date")).filter("text_date IS NOT NULL").distinct()


def days_added(spark, folder):
    d = _docs(spark, folder).select("doc_id", "effective_date").filter("effective_date IS NOT NULL").distinct()
    return d.select("doc_id", "effective_date", projections.add_days(F.col("effective_date"), 45).alias("later"))


def slugs(spark, folder):
    d = _docs(spark, folder).select("doc_id", "doc_type", F.concat("doc_type", "number").alias("n")).filter("n IS NOT NULL").distinct()
    return d.select("doc_id", projections.slug(F.col("n"), F.col("doc_type")).alias("slug")).distinct()


def type_codes(spark, folder):
    d = _docs(spark, folder).select("doc_type").distinct()
    return d.select("doc_type", projections.type_code(F.col("doc_type")).alias("code"))


def type_folders(spark, folder):
    return _docs(spark, folder).groupBy(projections.folder(F.col("doc_type")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def query_intents(spark, folder):
    q = table(spark, folder, "eval_items").select("item_id", F.concat_ws(" ", "query_text", F.when(F.col("item_id") % 2 == 0, "na ICA mais recente da ANAC"), F.when(F.col("item_id") % 3 == 0, "em vigor XYZ")).alias("q"))
    filters, sorts = projections.intents(F.col("q"))
    return q.select("item_id", F.array_join(filters, ",").alias("filters"), F.array_join(sorts, ",").alias("sorts"))


def content_guard(spark, folder):
    return _docs(spark, folder).filter(projections.long_enough(F.col("content"), 900)).select("doc_id", "version_year").distinct()


def source_subset(spark, folder):
    return table(spark, folder, "documents").filter(F.col("source").isin("portal_meridiano", "gateway_north")).select("doc_id", "source")


def keyword_index(spark, folder):
    return projections.keyword_filter(_docs(spark, folder), ["ica", "MCA"], ["rampa", "Auditoria"]).select("doc_id", "title").distinct()


def word_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", projections.word_count(F.col("text")).alias("n_words"))


def ocr_pages(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"), "text")
    native = F.when(F.col("page") == 1, F.col("text")).otherwise(F.substring("text", 10, 20))
    p = d.select("doc_id", "page", projections.page_text(native, F.concat(F.lit("lida "), F.col("page"))).alias("text"))
    return projections.joined_pages(p.withColumn("text", F.length("text").cast("string")))


def quality_rejects(spark, folder):
    q = quality.quality_metrics(_docs(spark, folder))
    return q.groupBy(quality.reject_reason().alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))


def quality_warnings(spark, folder):
    q = quality.quality_metrics(_docs(spark, folder)).withColumn("warning", F.explode(quality.warnings()))
    return q.groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


# ---- reports


def _runs(spark, folder):
    return table(spark, folder, "eval_items").select("query_id", (F.col("item_id") % 7).alias("n_before"), F.floor((F.col("item_id") % 7) / 2).alias("n_after"), (F.col("item_id") % 13).alias("search_ms"), (F.col("item_id") % 17).alias("rank_ms"))


def pipeline_summary(spark, folder):
    s = reports.pipeline_summary(_runs(spark, folder), ["search_ms", "rank_ms"])
    return s.select("n_queries", *(F.round(c, 6).alias(c) for c in ("filter_rate", "avg_search_ms", "avg_rank_ms")))


def null_skipping_means(spark, folder):
    r = _runs(spark, folder).withColumn("verdict", F.when(F.col("n_before") > 4, F.col("n_after") / 5))
    return r.groupBy("n_before").agg(F.round(reports.mean_or_null("verdict"), 6).alias("mean_verdict"))


def _golden(spark, folder):
    return table(spark, folder, "eval_items").select("query_id", F.col("item_id").alias("seq"), "category", "relevance", "passage")


def sampled_queries(spark, folder):
    return reports.sampled_queries(_golden(spark, folder), 20)


def first_golden_rows(spark, folder):
    return reports.first_rows(_golden(spark, folder).drop("passage"))


def report_order(spark, folder):
    m = _runs(spark, folder).select("query_id", F.nullif("n_before", F.lit(0)).alias("first_rank"))
    return m.orderBy(*reports.report_order(m)).limit(50).select("query_id", "first_rank")


def rerank_bypass(spark, folder):
    h = _hits(spark, folder).select("query_id", "id", "score")
    every = reports.bypassed(h).withColumn("mode", F.lit("disabled")).unionByName(reports.bypassed(h, failed=True).withColumn("mode", F.lit("failed")))
    return every.select("query_id", "id", "mode", F.round("relevance", 4).alias("relevance"))


def discarded_hits(spark, folder):
    h = _hits(spark, folder)
    kept = search.rerank(h, F.col("score") * 4 - 2, 60.0).select("query_id", "regulation_id")
    return reports.discarded(h, kept).select("query_id", "regulation_id")


def fetch_counts(spark, folder):
    return reports.fetch_counts(_hits(spark, folder), F.coalesce("doc_type", F.lit("")))


def grouped_sources(spark, folder):
    g = reports.grouped_values(_docs(spark, folder), ["doc_type"], "source")
    return g.select("doc_type", F.array_join("source", ",").alias("sources"))


def cleaning_totals(spark, folder):
    d = _docs(spark, folder).withColumns({"after": F.regexp_replace("content", " +", " "), "dashes": F.regexp_count("content", F.lit("-"))})
    t = reports.cleaning_totals(d, "content", "after", ["dashes"])
    return t.withColumn("reduction_pct", F.round("reduction_pct", 6))


def concentrated_targets(spark, folder):
    return reports.concentrated(table(spark, folder, "document_relations"), "target_doc_id", 10)


def hybrid_points(spark, folder):
    c = retrieval._chunks(spark, folder)
    dense, sparse = c.select(F.col("id").alias("chunk_id"), "label"), c.filter("id % 3 = 0").select(F.col("id").alias("chunk_id"), "indices", "values")
    p = reports.hybrid_points(dense, sparse)
    return p.select("chunk_id", "label", F.coalesce(F.size("indices"), F.lit(-1)).alias("n_terms"))


def collection_info(spark, folder):
    return reports.collection_info(retrieval._chunks(spark, folder))


def golden_flags(spark, folder):
    r = table(spark, folder, "document_relations").select(F.col("relation_id").cast("string").alias("query_id"), F.col("target_doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    return reports.golden_flags(r, _docs(spark, folder), table(spark, folder, "embedding_log")).filter("flags <> ''")


# ---- sinks


def deleted_keys(spark, folder):
    gone = table(spark, folder, "quality_reports").filter("level = 'garbage' OR level = 'low'")
    return store.delete_keys(table(spark, folder, "embedding_log"), gone).select("log_id", "doc_id")


def appended_table(spark, folder):
    path, e = scratch_path(spark, "appended"), table(spark, folder, "embedding_log")
    sinks.append(e.filter("log_id % 2 = 0"), path)
    sinks.append(e.filter("log_id % 2 <> 0"), path)
    return spark.read.schema(e.schema).parquet(path).select("log_id", "doc_id", "model_name")


def rewritten_log(spark, folder):
    e = table(spark, folder, "embedding_log")
    new = e.filter("log_id % 5 = 0").withColumn("model_name", F.lit("new"))
    return store.rewritten(e.filter("doc_id IS NOT NULL"), new, e.filter("log_id % 5 = 0").select("doc_id")).select("log_id", "doc_id", "model_name")


def upserted_points(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("label"))
    new = e.filter("id LIKE '%7'").withColumn("label", F.lit("new")).unionByName(e.filter("id = '3'").select(F.lit("x3").alias("id"), "label"))
    return store.upsert_points(e, new)


def appended_events(spark, folder):
    f = retrieval._feedback(spark, folder).drop("value")
    log, more = f.filter("event_id < 500"), f.filter("event_id >= 500").drop("event_id")
    return store.append_events(log, more, feedback.valid_event(), ["created_at", "session_id"]).select("event_id", "session_id", "message_id", "kind")


def appended_turns(spark, folder):
    f = retrieval._feedback(spark, folder)
    history = f.select("session_id", F.col("event_id").alias("turn"), F.lit("user").alias("role"), "kind").withColumnRenamed("kind", "content")
    turns = f.select("session_id").distinct().unionByName(spark.createDataFrame([("new",)], "session_id string")).select("session_id", F.lit("pergunta").alias("question"), F.lit("resposta").alias("answer"))
    return sinks.append_turns(history, turns).filter("content IN ('pergunta', 'resposta')")


def round_trip_json(spark, folder):
    path, e = scratch_path(spark, "results"), table(spark, folder, "eval_items").select("item_id", "query_id", "passage", "notes")
    sinks.write_json(e, path)
    return spark.read.schema(e.schema).json(path)


def round_trip_csv(spark, folder):
    path = scratch_path(spark, "results")
    sinks.write_csv(table(spark, folder, "eval_items").select("item_id", "query_id", "category", F.array("category", "relevance").alias("tags"), (F.col("item_id") / 7).alias("x")), path)
    return spark.read.option("header", True).schema("item_id bigint, query_id string, category string, tags string, x string").csv(path)


QUERIES = {
    f.__name__: f
    for f in (
        article_projection, publication_dates, temporal_override, payload_flatten, trace_documents, type_labels, byte_sizes, generator_context, generator_prompt, evaluator_text,
        search_queries, text_dates, days_added, slugs, type_codes, type_folders, query_intents, content_guard, source_subset, keyword_index, word_counts, ocr_pages, quality_rejects,
        quality_warnings, pipeline_summary, null_skipping_means, sampled_queries, first_golden_rows, report_order, rerank_bypass, discarded_hits, fetch_counts, grouped_sources,
        cleaning_totals, concentrated_targets, hybrid_points, collection_info, golden_flags, deleted_keys, appended_table, rewritten_log, upserted_points, appended_events,
        appended_turns, round_trip_json, round_trip_csv,
    )
}

_H = f"""{retrieval._dense()}, h AS (SELECT query_id, id, score, rank, CASE id % 4 WHEN 1 THEN 'ICA' WHEN 2 THEN 'MCA' WHEN 3 THEN 'Lei' END AS doc_type, CAST(id AS VARCHAR) AS number,
    CASE WHEN id % 3 > 0 THEN 'Título ' || id ELSE '' END AS title, CASE WHEN id % 5 > 0 THEN 'DECEA' END AS authority, 'corpo do texto ' || id AS text, 'r' || id AS regulation_id FROM hits)"""
_BLOCK = """concat_ws(chr(10), '[' || CASE WHEN doc_type IS NULL THEN 'Doc ' || rank ELSE doc_type || ' ' || number END || ']', 'Título: ' || nullif(title, ''), 'Órgão: ' || authority, substr(text, 1, 12))"""
_META = "CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{}') END"
_MONTHS = "janeiro|fevereiro|março|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
_CODES = ", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate(ids.TYPE_CODES.items()))
_FOLDER = " ".join(f"WHEN contains(lower(doc_type), '{k}') THEN '{v}'" for k, v in projections.FOLDERS.items())
_KIND = "CASE upper(regexp_replace(trim(doc_type), '\\s+', ' ', 'g')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ids.DOC_TYPES.items()) + " WHEN '' THEN NULL ELSE upper(regexp_replace(trim(doc_type), '\\s+', ' ', 'g')) END"
_LABEL = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in projections.TYPE_LABELS.items()) + " ELSE doc_type END"
_RUNS = "WITH r AS (SELECT query_id, item_id % 7 AS n_before, floor((item_id % 7) / 2) AS n_after, item_id % 13 AS search_ms, item_id % 17 AS rank_ms FROM eval_items)"
_WORDS = "regexp_extract_all({}, '[^\\s\x0b\x1c-\x1f\x85\xa0]+')"
_Q = """WITH t AS (SELECT coalesce(content, '') AS x FROM store_documents), m AS (SELECT length(x) AS chars, len(regexp_extract_all(x, '\\pL')) AS alpha,
    len(regexp_extract_all(x, '\\pC')) - len(regexp_extract_all(x, '[\\n\\r\\t]')) AS control, CASE WHEN x = '' THEN [] ELSE string_split(x, chr(10)) END AS lines,
    len(regexp_extract_all(x, '(?i)MINISTÉRIO\\s+DA\\s+DEFESA')) AS headers, len(regexp_extract_all(x, '(?:^|\\n)\\s*[0-9]{1,3}\\s*/\\s*[0-9]{1,3}\\s*(?:\\n|$)')) AS pages FROM t)"""

SQL = {
    "article_projection": f"""SELECT doc_id AS regulation_id, coalesce(nullif(title, ''), {_META.format('title')}, '') AS title, length(content) AS text,
        coalesce(nullif(effective_date, ''), nullif({_META.format('date')}, ''), nullif({_META.format('date_published')}, '')) AS effective_date, expiry_date,
        coalesce(nullif(status, ''), nullif({_META.format('status')}, ''), 'active') AS status, version_year, coalesce(is_latest, 0) <> 0 AS is_latest, canonical_id,
        coalesce(nullif(doc_type, ''), nullif({_META.format('type')}, ''), nullif({_META.format('doc_type')}, ''), '') AS type, coalesce(nullif(url, ''), nullif({_META.format('source_url')}, '')) AS url,
        coalesce(nullif(number, ''), nullif({_META.format('number')}, '')) AS number, coalesce(nullif(authority, ''), nullif({_META.format('authority')}, '')) AS authority FROM store_documents""",
    "publication_dates": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2020-01-01' WHEN event_id % 2 = 0 THEN '2021-01-01' ELSE '2022-01-01' END AS published FROM events",
    "temporal_override": "SELECT DISTINCT doc_id, coalesce(nullif(status, ''), 'active') AS status, coalesce(nullif(expiry_date, ''), nullif(substr(scraped_at, 1, 10), '')) AS expiry_date FROM store_documents",
    "payload_flatten": f"{_H} SELECT query_id, id, score, regulation_id, title FROM h",
    "trace_documents": f"{_H} SELECT query_id, regulation_id, title, coalesce(doc_type, '') AS doc_type, number, coalesce(authority, '') AS authority, score FROM h",
    "type_labels": f"WITH k AS (SELECT {_KIND} AS doc_type FROM store_documents) SELECT doc_type, count(*) AS n, {_LABEL} AS label FROM k GROUP BY doc_type",
    "byte_sizes": """WITH d AS (SELECT doc_id, n_chars * n_chars AS n FROM documents) SELECT doc_id, CASE WHEN n IS NULL OR n = 0 THEN 'N/A' WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024)
        WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size FROM d""",
    "generator_context": f"{_H} SELECT query_id, string_agg({_BLOCK}, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id",
    "generator_prompt": f"""{_H}, k AS (SELECT query_id, string_agg({_BLOCK}, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id)
        SELECT query_id, concat_ws(chr(10) || chr(10), CASE WHEN query_id % 300 > 0 THEN 'USER: antes ' || query_id || chr(10) || chr(10) || 'ASSISTANT: sim' END, CASE WHEN query_id % 200 > 0 THEN 'DOCS:' || chr(10) || context END, 'Q: pergunta ' || query_id) AS prompt FROM k""",
    "evaluator_text": f"""WITH p AS (SELECT doc_id, concat_ws(' — ', nullif(doc_kind, ''), CASE WHEN doc_id % 2 = 0 THEN 'nº ' || doc_id END, nullif(source, '')) AS i, title, coalesce(text, '') AS body FROM documents),
        t AS (SELECT doc_id, concat_ws(' | ', nullif(title, ''), nullif(i, '')) AS prefix, body FROM p), x AS (SELECT doc_id, CASE WHEN prefix <> '' THEN prefix || chr(10) || body ELSE body END AS y FROM t)
        SELECT doc_id, CASE WHEN len({_WORDS.format('y')}) <= 40 THEN y ELSE array_to_string({_WORDS.format('y')}[1:40], ' ') END AS eval_text FROM x""",
    "search_queries": """WITH n AS (SELECT item_id, query_text, [i for i in range(item_id % 7 + 1) if i % 3 > 0] AS u FROM eval_items)
        SELECT item_id, concat_ws(' ', nullif(array_to_string(['m' || i || ' ' || item_id for i in u[greatest(1, len(u) - 2):]], ' '), ''), query_text) AS search_text FROM n""",
    "text_dates": f"""WITH d AS (SELECT DISTINCT doc_id, content FROM store_documents), m AS (SELECT doc_id, nullif(regexp_extract(content, '\\b(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})\\b', 1), '') AS a,
        regexp_extract(content, '(?i)\\b(\\d{{1,2}})\\s+de\\s+({_MONTHS})\\s+de\\s+(\\d{{4}})\\b', ['d', 'm', 'y']) AS s FROM d)
        SELECT DISTINCT doc_id, coalesce(a, lpad(s.d, 2, '0') || '/' || lpad(CAST(list_position(['janeiro', 'fevereiro', 'março', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro'], replace(lower(s.m), 'marco', 'março')) AS VARCHAR), 2, '0') || '/' || s.y) AS text_date
        FROM m WHERE a IS NOT NULL OR s.m <> ''""",
    "days_added": """SELECT DISTINCT doc_id, effective_date, strftime(CASE WHEN regexp_full_match(effective_date, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(effective_date AS DATE) END + 45, '%Y-%m-%d') AS later FROM store_documents WHERE effective_date IS NOT NULL""",
    "slugs": """SELECT DISTINCT doc_id, replace(CASE WHEN regexp_matches(number, '^[0-9]') THEN doc_type || '-' || number ELSE doc_type || number END, ' ', '-') AS slug FROM store_documents WHERE doc_type || number IS NOT NULL""",
    "type_codes": f"""WITH t(i, name, code) AS (VALUES {_CODES}), d AS (SELECT DISTINCT doc_type, upper(trim(doc_type)) AS k FROM store_documents)
        SELECT doc_type, coalesce((SELECT code FROM t WHERE name = k), (SELECT arg_min(code, i) FROM t WHERE starts_with(name, k) OR starts_with(k, name))) AS code FROM d""",
    "type_folders": f"SELECT CASE {_FOLDER} ELSE 'outros' END AS folder, count(*) AS n FROM store_documents GROUP BY 1",
    "query_intents": """WITH q AS (SELECT item_id, concat_ws(' ', query_text, CASE WHEN item_id % 2 = 0 THEN 'na ICA mais recente da ANAC' END, CASE WHEN item_id % 3 = 0 THEN 'em vigor XYZ' END) AS q FROM eval_items)
        SELECT item_id, array_to_string([CASE WHEN w IN ('ICA', 'MCA', 'DCA', 'RCA', 'PCA', 'NSCA', 'RICA', 'FCA') THEN 'type=' || w ELSE 'authority=' || w END for w in regexp_extract_all(q, '\\b[A-Z]{3,}\\b')
            if w IN ('ICA', 'MCA', 'DCA', 'RCA', 'PCA', 'NSCA', 'RICA', 'FCA', 'DECEA', 'ANAC', 'COMAER', 'FAB', 'DCTA', 'DIRSA')], ',') AS filters,
        concat_ws(',', CASE WHEN regexp_matches(q, '(?i)\\bmais\\s+recente') THEN 'sort_by_date_desc' END, CASE WHEN regexp_matches(q, '(?i)\\b(?:nov[ao]s?|atual|atualizad[ao]s?)\\b') THEN 'sort_by_date_desc' END,
            CASE WHEN regexp_matches(q, '(?i)\\b(?:antig[ao]s?|primeir[ao]s?)\\b') THEN 'sort_by_date_asc' END, CASE WHEN regexp_matches(q, '(?i)\\b(?:em\\s+vigor|vigentes?)\\b') THEN 'filter_active' END) AS sorts FROM q""",
    "content_guard": "SELECT DISTINCT doc_id, version_year FROM store_documents WHERE length(regexp_replace(content, '^[\\s\x0b\x1c-\x1f\x85\xa0]+|[\\s\x0b\x1c-\x1f\x85\xa0]+$', '', 'g')) >= 900",
    "source_subset": "SELECT doc_id, source FROM documents WHERE source IN ('portal_meridiano', 'gateway_north')",
    "keyword_index": "SELECT DISTINCT doc_id, title FROM store_documents WHERE upper(doc_type) IN ('ICA', 'MCA') AND (contains(lower(title), 'rampa') OR contains(lower(title), 'auditoria'))",
    "word_counts": f"SELECT doc_id, coalesce(len({_WORDS.format('text')}), 0) AS n_words FROM documents",
    "ocr_pages": """WITH p AS (SELECT doc_id, unnest([1, 2, 3]) AS page, text FROM documents), t AS (SELECT doc_id, page, CASE WHEN page = 1 THEN text ELSE substr(text, 10, 20) END AS n FROM p),
        x AS (SELECT doc_id, page, length(CASE WHEN length(trim(regexp_replace(n, '[\\s\x0b\x1c-\x1f\x85\xa0]+', ' ', 'g'))) > 50 THEN n ELSE 'lida ' || page END) AS c FROM t)
        SELECT doc_id, string_agg('--- PÁGINA ' || page || ' ---' || chr(10) || c, chr(10) || chr(10) ORDER BY page) AS text FROM x GROUP BY doc_id""",
    "quality_rejects": f"""{_Q}, g AS (SELECT chars, CASE WHEN chars = 0 THEN 0.0 ELSE alpha / chars END AS a, CASE WHEN chars = 0 THEN 0.0 ELSE control / chars END AS c FROM m)
        SELECT CASE WHEN chars = 0 THEN 'Empty content' WHEN chars < 200 THEN 'Content too short (' || chars || ' chars)' WHEN c > 0.10 THEN 'Excessive control characters (' || printf('%.1f', c * 100) || '%)'
            WHEN a < 0.15 THEN 'Alpha ratio too low (' || printf('%.1f', a * 100) || '%)' WHEN a < 0.40 THEN 'Low text quality (' || printf('%.1f', a * 100) || '%)' END AS reject_reason, count(*) AS n FROM g GROUP BY 1""",
    "quality_warnings": f"""{_Q}, g AS (SELECT headers, pages, CASE WHEN len(lines) = 0 THEN 0.0 ELSE len([x for x in lines if trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11) || chr(160)) <> '' AND NOT regexp_matches(x, '\\pL')]) / len(lines) END AS noise,
            len([x for x in lines if length(x) - length(replace(x, '.', '')) > 20]) AS toc FROM m),
        w AS (SELECT unnest([CASE WHEN headers > 3 THEN headers || ' repeated institutional headers' END, CASE WHEN pages > 5 THEN pages || ' embedded page numbers' END,
            CASE WHEN noise > 0.3 THEN printf('%.0f', noise * 100) || '% of lines have no alphabetic content' END, CASE WHEN toc > 10 THEN toc || ' table-of-contents lines' END]) AS warning FROM g)
        SELECT warning, count(*) AS n FROM w WHERE warning IS NOT NULL GROUP BY 1""",
    "pipeline_summary": f"""{_RUNS} SELECT count(*) AS n_queries, round(avg(CASE WHEN n_before > 0 THEN 1 - n_after / n_before END), 6) AS filter_rate, round(avg(search_ms), 6) AS avg_search_ms, round(avg(rank_ms), 6) AS avg_rank_ms FROM r""",
    "null_skipping_means": f"{_RUNS} SELECT n_before, round(avg(CASE WHEN n_before > 4 THEN n_after / 5 END), 6) AS mean_verdict FROM r GROUP BY n_before",
    "sampled_queries": """WITH f AS (SELECT query_id, min(item_id) AS seq, arg_min(category, item_id) AS category FROM eval_items WHERE query_id IS NOT NULL GROUP BY query_id)
        (SELECT * FROM f WHERE category IS DISTINCT FROM 'coverage' ORDER BY seq LIMIT 20) UNION ALL SELECT * FROM f WHERE category = 'coverage'""",
    "first_golden_rows": """SELECT query_id, item_id AS seq, category, relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS r FROM eval_items) WHERE r = 1 AND category IS DISTINCT FROM 'coverage'""",
    "report_order": f"{_RUNS} SELECT query_id, nullif(n_before, 0) AS first_rank FROM r ORDER BY coalesce(nullif(n_before, 0), 99), query_id LIMIT 50",
    "rerank_bypass": f"{_H} SELECT query_id, id, 'disabled' AS mode, round(score * 100, 4) AS relevance FROM h UNION ALL SELECT query_id, id, 'failed', 50.0 FROM h",
    "discarded_hits": f"{_H} SELECT query_id, regulation_id FROM h WHERE 100 / (1 + exp(2 - score * 4)) < 60",
    "fetch_counts": f"{_H} SELECT query_id, count(*) AS n_found, count(DISTINCT coalesce(doc_type, '')) AS n_distinct FROM h GROUP BY query_id",
    "grouped_sources": "SELECT doc_type, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM store_documents GROUP BY doc_type",
    "cleaning_totals": """WITH d AS (SELECT length(content) AS b, length(regexp_replace(content, ' +', ' ', 'g')) AS a, length(content) - length(replace(content, '-', '')) AS k FROM store_documents)
        SELECT count(*) AS n_docs, CAST(sum(b) AS BIGINT) AS chars_before, CAST(sum(a) AS BIGINT) AS chars_after, CAST(sum(k) AS BIGINT) AS dashes, round((sum(b) - sum(a)) * 100.0 / sum(b), 6) AS reduction_pct FROM d""",
    "concentrated_targets": "SELECT target_doc_id, count(*) AS n FROM document_relations WHERE target_doc_id IS NOT NULL GROUP BY 1 HAVING count(*) > 10",
    "hybrid_points": "SELECT vec_id AS chunk_id, label, CASE WHEN vec_id % 3 = 0 THEN len([x for x in embedding::DOUBLE[] if x > 0.15]) ELSE -1 END AS n_terms FROM embeddings",
    "collection_info": "SELECT count(*) AS n_points, 'ready' AS status FROM embeddings",
    "golden_flags": """WITH r AS (SELECT DISTINCT CAST(relation_id AS VARCHAR) AS query_id, target_doc_id AS doc_id FROM document_relations WHERE target_doc_id IS NOT NULL),
        f AS (SELECT doc_id, max(coalesce(is_latest, 0)) AS latest FROM store_documents GROUP BY doc_id), x AS (SELECT DISTINCT doc_id, true AS there FROM embedding_log),
        j AS (SELECT query_id, r.doc_id, CASE WHEN latest IS NULL THEN 'missing_in_store' WHEN latest <> 1 THEN 'not_latest' WHEN there IS NULL THEN 'latest_not_indexed' END AS flags FROM r LEFT JOIN f USING (doc_id) LEFT JOIN x USING (doc_id))
        SELECT * FROM j WHERE flags IS NOT NULL""",
    "deleted_keys": "SELECT log_id, doc_id FROM embedding_log e WHERE NOT EXISTS (SELECT 1 FROM quality_reports q WHERE q.level IN ('garbage', 'low') AND q.doc_id = e.doc_id)",
    "appended_table": "SELECT log_id, doc_id, model_name FROM embedding_log",
    "rewritten_log": """SELECT log_id, doc_id, model_name FROM embedding_log e WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM embedding_log x WHERE x.log_id % 5 = 0 AND x.doc_id = e.doc_id)
        UNION ALL SELECT log_id, doc_id, 'new' FROM embedding_log WHERE log_id % 5 = 0""",
    "upserted_points": """SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 10 = 7 THEN 'new' ELSE CAST(label AS VARCHAR) END AS label FROM embeddings UNION ALL SELECT 'x3', CAST(label AS VARCHAR) FROM embeddings WHERE vec_id = 3""",
    "appended_events": f"""{retrieval._FB}, ok AS (SELECT * FROM f WHERE kind IN ('thumbs', 'star', 'comment', 'clear')) SELECT event_id, session_id, message_id, kind FROM f WHERE event_id < 500
        UNION ALL SELECT 499 + row_number() OVER (ORDER BY created_at, session_id), session_id, message_id, kind FROM ok WHERE event_id >= 500""",
    "appended_turns": """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS session_id, max(event_id) AS t FROM events GROUP BY 1 UNION ALL SELECT 'new', -1)
        SELECT session_id, t + 1 AS turn, 'user' AS role, 'pergunta' AS content FROM l UNION ALL SELECT session_id, t + 2, 'assistant', 'resposta' FROM l""",
    "round_trip_json": "SELECT item_id, query_id, passage, notes FROM eval_items",
    "round_trip_csv": "SELECT item_id, query_id, category, category || ';' || relevance AS tags, printf('%.4f', item_id / 7) AS x FROM eval_items",
}
