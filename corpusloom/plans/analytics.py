"""Queries of the SQL and analytics surface over the store's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import store
from corpusloom.runtime import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "store_documents")


def _n(alias: str = "n"):
    return F.count(F.lit(1)).alias(alias)


def scan_point_lookup(spark, folder):
    return table(spark, folder, "base_regulations").filter(F.col("doc_id") == "regra_1-1/1998").select("doc_id", "title", "status")


def scan_source(spark, folder):
    return _docs(spark, folder).filter(F.col("source") == "diario_alto").select("doc_id", "title", "version_year").distinct()


def scan_doc_ids(spark, folder):
    return _docs(spark, folder).select("doc_id").distinct()


def metadata_fields(spark, folder):
    d = _docs(spark, folder).select("doc_id", "metadata").distinct()
    valid = F.try_parse_json("metadata")
    return d.select("doc_id", F.try_variant_get(valid, "$.ementa", "string").alias("summary"), F.try_variant_get(valid, "$.pages", "bigint").alias("pages"))


def store_stats_by_source(spark, folder):
    return _docs(spark, folder).groupBy("source").agg(_n())


def store_counts(spark, folder):
    return _docs(spark, folder).agg(_n("n_rows"), F.count_if(F.col("source") == "diario_alto").alias("n_source"), F.max("updated_at").alias("last_updated"))


def by_type(spark, folder):
    return _docs(spark, folder).filter("doc_type IS NOT NULL").groupBy("doc_type").agg(_n()).orderBy(F.desc("n"), "doc_type")


def by_status_coalesce(spark, folder):
    return _docs(spark, folder).groupBy(F.coalesce("status", F.lit("unknown")).alias("status_label")).agg(_n())


def sources_length_stats(spark, folder):
    n = F.length("content")
    return _docs(spark, folder).groupBy("source").agg(_n(), F.round(F.avg(n), 2).alias("avg_chars"), F.min(n).cast("bigint").alias("min_chars"), F.max(n).cast("bigint").alias("max_chars")).orderBy("source")


def types_breakdown(spark, folder):
    return _docs(spark, folder).groupBy("source", "doc_type").agg(_n()).orderBy("source", F.desc("n"))


def table_counts_union(spark, folder):
    names = ("store_documents", "document_relations", "embedding_log", "quality_reports", "base_regulations")
    parts = [table(spark, folder, t).agg(_n()).select(F.lit(t).alias("table_name"), "n") for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def top_values_registry(spark, folder):
    d = _docs(spark, folder)
    top = lambda c, k, f: d.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(_n()).orderBy(F.desc("n"), "value").limit(k).select(F.lit(f).alias("field"), "value", "n")
    return top("doc_type", 14, "type").unionAll(top("authority", 10, "authority"))


def embedding_totals(spark, folder):
    log = table(spark, folder, "embedding_log")
    return log.agg(F.coalesce(F.sum("num_chunks"), F.lit(0)).cast("bigint").alias("n_chunks"), F.max("embedded_at").alias("last_embedded"))


def embedding_models(spark, folder):
    return table(spark, folder, "embedding_log").select("model_name").distinct()


def embedded_hashes(spark, folder):
    return table(spark, folder, "embedding_log").select("doc_id", "content_hash").distinct()


def relation_stats(spark, folder):
    r = table(spark, folder, "document_relations").dropDuplicates(["relation_id"])
    known = F.coalesce(F.col("target_doc_id") != "", F.lit(False))
    return r.groupBy("relation_type").agg(_n(), F.count_if(known).alias("resolved"), F.count_if(~known).alias("unresolved"))


def incremental_work(spark, folder):
    return store.incremental_work(_docs(spark, folder), table(spark, folder, "embedding_log"), "hybrid").select("doc_id").distinct()


def exists_semi(spark, folder):
    r = table(spark, folder, "document_relations")
    return _docs(spark, folder).join(r.select(F.col("target_doc_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id").distinct()


def anti_missing(spark, folder):
    reports = table(spark, folder, "quality_reports")
    return _docs(spark, folder).join(reports.select("doc_id"), "doc_id", "left_anti").select("doc_id").distinct()


def relation_endpoints(spark, folder):
    ids = _docs(spark, folder).filter(F.col("status") == "revoked")
    return store.edges_of(table(spark, folder, "document_relations"), ids)


def quality_level_counts(spark, folder):
    return table(spark, folder, "quality_reports").groupBy("level").agg(_n(), F.sum("total_chars").cast("bigint").alias("chars")).orderBy(F.desc("n"), "level")


def exact_duplicates(spark, folder):
    return table(spark, folder, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("text_hash")).agg(_n(), F.min("doc_id").alias("first_id")).filter("n > 1")


def first_seen_by_url(spark, folder):
    d = _docs(spark, folder).select("doc_id", "urn", "url", "title", "updated_at")
    key = F.coalesce(F.nullif("urn", F.lit("")), F.nullif("url", F.lit("")), "title")
    return store.first_seen(d, key, ["updated_at", "doc_id"]).select("doc_id", "url")


def sets_of_documents(spark, folder):
    ids = _docs(spark, folder).select("doc_id").distinct()
    logged = table(spark, folder, "embedding_log").select("doc_id").distinct()
    both = ids.intersect(logged).select("doc_id", F.lit("both").alias("side"))
    return both.unionAll(ids.exceptAll(logged).select("doc_id", F.lit("store").alias("side"))).unionAll(logged.exceptAll(ids).select("doc_id", F.lit("log").alias("side")))


def union_by_name(spark, folder):
    a = table(spark, folder, "base_regulations").select("doc_id", "title", "status")
    b = _docs(spark, folder).select("title", "doc_id", "authority")
    return a.unionByName(b, allowMissingColumns=True).groupBy("status", F.col("authority").isNull().alias("no_authority")).agg(_n())


def revenue_by_nation(spark, folder):
    """A star join of the relational tables; Spark picks broadcasts by size."""
    t = lambda n: table(spark, folder, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), _n("n_lines"))


def pricing_summary(spark, folder):
    li = table(spark, folder, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), _n("count_order"))


def orders_rollup(spark, folder):
    return table(spark, folder, "orders").rollup("o_orderstatus", "o_orderpriority").agg(_n(), F.round(F.sum("o_totalprice"), 2).alias("total"))


def top_orders_by_customer(spark, folder):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, folder, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        scan_point_lookup, scan_source, scan_doc_ids, metadata_fields, store_stats_by_source, store_counts, by_type, by_status_coalesce, sources_length_stats,
        types_breakdown, table_counts_union, top_values_registry, embedding_totals, embedding_models, embedded_hashes, relation_stats, incremental_work, exists_semi,
        anti_missing, relation_endpoints, quality_level_counts, exact_duplicates, first_seen_by_url, sets_of_documents, union_by_name, revenue_by_nation,
        pricing_summary, orders_rollup, top_orders_by_customer,
    )
}

SQL = {
    "scan_point_lookup": "SELECT doc_id, title, status FROM base_regulations WHERE doc_id = 'regra_1-1/1998'",
    "scan_source": "SELECT DISTINCT doc_id, title, version_year FROM store_documents WHERE source = 'diario_alto'",
    "scan_doc_ids": "SELECT DISTINCT doc_id FROM store_documents",
    "metadata_fields": """SELECT DISTINCT doc_id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.ementa') END AS summary,
        CASE WHEN json_valid(metadata) THEN TRY_CAST(json_extract_string(metadata, '$.pages') AS BIGINT) END AS pages FROM (SELECT DISTINCT doc_id, metadata FROM store_documents)""",
    "store_stats_by_source": "SELECT source, count(*) AS n FROM store_documents GROUP BY source",
    "store_counts": "SELECT count(*) AS n_rows, count(*) FILTER (source = 'diario_alto') AS n_source, max(updated_at) AS last_updated FROM store_documents",
    "by_type": "SELECT doc_type, count(*) AS n FROM store_documents WHERE doc_type IS NOT NULL GROUP BY doc_type",
    "by_status_coalesce": "SELECT coalesce(status, 'unknown') AS status_label, count(*) AS n FROM store_documents GROUP BY 1",
    "sources_length_stats": "SELECT source, count(*) AS n, round(avg(length(content)), 2) AS avg_chars, min(length(content)) AS min_chars, max(length(content)) AS max_chars FROM store_documents GROUP BY source",
    "types_breakdown": "SELECT source, doc_type, count(*) AS n FROM store_documents GROUP BY source, doc_type",
    "table_counts_union": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("store_documents", "document_relations", "embedding_log", "quality_reports", "base_regulations")),
    "top_values_registry": """(SELECT 'type' AS field, doc_type AS value, count(*) AS n FROM store_documents WHERE doc_type IS NOT NULL GROUP BY doc_type ORDER BY n DESC, value LIMIT 14)
        UNION ALL (SELECT 'authority', authority AS value, count(*) AS n FROM store_documents WHERE authority IS NOT NULL GROUP BY authority ORDER BY n DESC, value LIMIT 10)""",
    "embedding_totals": "SELECT CAST(coalesce(sum(num_chunks), 0) AS BIGINT) AS n_chunks, max(embedded_at) AS last_embedded FROM embedding_log",
    "embedding_models": "SELECT DISTINCT model_name FROM embedding_log",
    "embedded_hashes": "SELECT DISTINCT doc_id, content_hash FROM embedding_log",
    "relation_stats": """SELECT relation_type, count(*) AS n, count(*) FILTER (target_doc_id <> '') AS resolved, count(*) FILTER (target_doc_id IS NULL OR target_doc_id = '') AS unresolved
        FROM (SELECT relation_id, any_value(relation_type) AS relation_type, max(target_doc_id) AS target_doc_id FROM document_relations GROUP BY relation_id) GROUP BY relation_type""",
    "incremental_work": """WITH last AS (SELECT * FROM embedding_log WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY embedded_at DESC, log_id DESC, content_hash DESC) = 1)
        SELECT DISTINCT d.doc_id FROM store_documents d LEFT JOIN last l ON d.doc_id = l.doc_id
        WHERE l.doc_id IS NULL OR l.content_hash IS DISTINCT FROM d.content_hash OR l.embedding_mode IS DISTINCT FROM 'hybrid'""",
    "exists_semi": "SELECT DISTINCT doc_id FROM store_documents d WHERE EXISTS (SELECT 1 FROM document_relations r WHERE r.target_doc_id = d.doc_id)",
    "anti_missing": "SELECT DISTINCT doc_id FROM store_documents d WHERE NOT EXISTS (SELECT 1 FROM quality_reports r WHERE r.doc_id = d.doc_id)",
    "relation_endpoints": """SELECT DISTINCT d.doc_id, r.relation_id FROM document_relations r JOIN store_documents d ON d.doc_id = r.source_doc_id OR d.doc_id = r.target_doc_id WHERE d.status = 'revoked'""",
    "quality_level_counts": "SELECT level, count(*) AS n, CAST(sum(total_chars) AS BIGINT) AS chars FROM quality_reports GROUP BY level",
    "exact_duplicates": "SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "first_seen_by_url": """SELECT doc_id, url FROM (SELECT doc_id, url, row_number() OVER (PARTITION BY coalesce(nullif(urn, ''), nullif(url, ''), title) ORDER BY updated_at NULLS FIRST, doc_id, urn NULLS FIRST, url NULLS FIRST, title NULLS FIRST) AS r
        FROM store_documents WHERE coalesce(nullif(urn, ''), nullif(url, ''), title) IS NOT NULL) WHERE r = 1""",
    "sets_of_documents": """SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM store_documents INTERSECT SELECT doc_id FROM embedding_log)
        UNION ALL SELECT doc_id, 'store' FROM (SELECT doc_id FROM store_documents EXCEPT SELECT doc_id FROM embedding_log)
        UNION ALL SELECT doc_id, 'log' FROM (SELECT doc_id FROM embedding_log EXCEPT SELECT doc_id FROM store_documents)""",
    "union_by_name": """SELECT status, authority IS NULL AS no_authority, count(*) AS n FROM (SELECT doc_id, title, status FROM base_regulations UNION ALL BY NAME SELECT title, doc_id, authority FROM store_documents) GROUP BY 1, 2""",
    "revenue_by_nation": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "orders_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "top_orders_by_customer": "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3",
}
