"""Queries of file sources: files are written from the tables, read by a source and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.operators import feedback
from corpusloom.plans import retrieval
from corpusloom.runtime import scratch_path, table
from corpusloom.sources import files, html


def vectors_of_source(spark, folder):
    path = scratch_path(spark, "vectors")
    v = table(spark, folder, "embeddings").select("vec_id", "label", F.concat(F.lit("s"), F.col("label") % 3).alias("source"))
    v.write.partitionBy("source").parquet(path)
    return files.vectors(spark, path, "s1").select("vec_id", "label")


def vectors_of_all(spark, folder):
    path = scratch_path(spark, "vectors")
    v = table(spark, folder, "embeddings")
    v.filter("vec_id % 2 = 0").select("vec_id", F.lit("s0").alias("source")).write.partitionBy("source").parquet(path)
    v.filter("vec_id % 2 = 1").select("vec_id", "label", F.lit("s1").alias("source")).write.mode("append").partitionBy("source").parquet(path)
    return files.vectors(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labels"))


def parquet_stats(spark, folder):
    return files.file_stats(spark, f"{folder}/documents.parquet").agg(F.sum("n_rows").alias("n_rows"))


def csv_query_list(spark, folder):
    path = scratch_path(spark, "queries")
    q = table(spark, folder, "eval_items").select(F.when(F.col("item_id") % 2 == 0, F.col("query_id")).alias("query_id"), F.when(F.col("item_id") % 5 > 0, F.col("query_text")).otherwise(" ").alias("query"), F.col("item_id").cast("string").alias("note"))
    q.coalesce(1).sortWithinPartitions(F.col("note").cast("int")).write.option("header", True).option("escape", '"').csv(path)
    return files.query_list(spark, path, "query_id string, query string, note string")


def json_documents(spark, folder):
    path = scratch_path(spark, "json")
    table(spark, folder, "source_registry").select("source", "tz_name", F.struct("full_name", "medium").alias("about")).repartition(3).write.option("ignoreNullFields", False).json(path)
    read = spark.read.schema("source string, tz_name string, about struct<full_name:string,medium:string>").json(path)
    return read.select("source", "tz_name", "about.full_name", "about.medium")


def metadata_map(spark, folder):
    d = files.parsed_metadata(table(spark, folder, "store_documents").select("doc_id", "metadata").distinct())
    return d.select("doc_id", F.col("metadata")["ementa"].alias("summary")).distinct()


def nested_histories(spark, folder):
    """Chat histories of nested messages, written as JSON, and their messages as rows."""
    path = scratch_path(spark, "chats")
    t = retrieval._turns(spark, folder).filter("turn < 2000")
    lists = t.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    lists.select(F.col("session_id").cast("string").alias("session_id"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")).write.json(path)
    read = spark.read.schema(files.HISTORY).json(path)
    return feedback.unnest_history(read).select("session_id", "turn", "role", "content")


def skipped_files(spark, folder):
    d = table(spark, folder, "store_documents").select(F.col("doc_id").alias("path")).distinct()
    return files.unlogged(d, table(spark, folder, "quality_reports").select(F.col("doc_id").alias("path")))


def _pages(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"))
    cell = lambda *c: F.concat(F.lit("<td>"), *c, F.lit("</td>"))
    row = lambda *c: F.concat(F.lit("<tr>"), *c, F.lit("</tr>"))
    links = F.concat(F.lit('<a href="/d/'), F.col("doc_id"), F.lit('.html">ver</a> <a href="f/'), F.col("doc_id"), F.lit('.PDF?x=1">pdf</a>'))
    body = F.concat(row(cell(F.lit("Fonte:")), cell(F.col("source"))), row(cell(F.lit("Número")), cell(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" "))), row(cell(F.lit("Texto")), cell(links)))
    return d.select("doc_id", F.concat(F.lit("http://x.org/l/"), F.col("doc_id")).alias("url"), F.concat(F.lit("<html><style>a{}</style><table>"), body, F.lit("</table><p>Fim &amp; termo</p></html>")).alias("html"))


def html_rows(spark, folder):
    return html.table_rows(_pages(spark, folder)).select("url", "row_no", F.trim(F.col("cells")[1]).alias("value"), "link")


def html_details(spark, folder):
    f = html.labelled_fields(html.table_rows(_pages(spark, folder)))
    return f.select("url", F.col("fields")["fonte"].alias("source"), F.trim(F.col("fields")["número"]).alias("number"))


def html_texts(spark, folder):
    p = _pages(spark, folder)
    return p.select("doc_id", F.contains(html.html_to_text(F.col("html")), F.lit("Fim & termo")).alias("has_end"), html.html_to_text(F.col("html"), 10_000).isNull().alias("too_short"))


def link_kinds(spark, folder):
    e = table(spark, folder, "eval_items").select("item_id", F.element_at(F.array(*map(F.lit, ("Revogada por X", "Revoga a Lei", "ALTERA o item", "Ver também"))), (F.col("item_id") % 4 + 1).cast("int")).alias("t"))
    return e.groupBy(html.relation_type(F.col("t")).alias("relation_type")).agg(F.count(F.lit(1)).alias("n"))


def golden_ids(spark, folder):
    d = table(spark, folder, "store_documents").select("doc_type", "number").distinct()
    raw = F.concat(F.upper("doc_type"), F.lit("-"), F.col("number"), F.lit("-art7"))
    return d.filter("number IS NOT NULL AND doc_type IS NOT NULL").select(raw.alias("raw"), ids.golden_id(raw).alias("golden")).distinct()


def safe_names(spark, folder):
    d = table(spark, folder, "store_documents").select("title").filter("title IS NOT NULL").distinct()
    return d.select("title", ids.file_safe(F.col("title")).alias("name"))


def chunk_owners(spark, folder):
    d = table(spark, folder, "embedding_log").select("log_id", F.concat("doc_id", F.lit("-art3-1")).alias("regulation_id")).filter("regulation_id IS NOT NULL")
    return d.select("log_id", ids.base_document(F.col("regulation_id")).alias("doc_id")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        vectors_of_source, vectors_of_all, parquet_stats, csv_query_list, json_documents, metadata_map, nested_histories, skipped_files, html_rows, html_details, html_texts,
        link_kinds, golden_ids, safe_names, chunk_owners,
    )
}

SQL = {
    "vectors_of_source": "SELECT vec_id, label FROM embeddings WHERE label % 3 = 1",
    "vectors_of_all": "SELECT 's' || (vec_id % 2) AS source, count(*) AS n, count(CASE WHEN vec_id % 2 = 1 THEN label END) AS n_labels FROM embeddings GROUP BY 1",
    "parquet_stats": "SELECT count(*) AS n_rows FROM documents",
    "csv_query_list": """WITH q AS (SELECT CASE WHEN item_id % 2 = 0 THEN query_id END AS query_id, CASE WHEN item_id % 5 > 0 THEN query_text ELSE ' ' END AS query, CAST(item_id AS VARCHAR) AS note, row_number() OVER (ORDER BY item_id) AS i FROM eval_items)
        SELECT coalesce(query_id, 'Q' || lpad(CAST(i AS VARCHAR), 3, '0')) AS query_id, query, note FROM q WHERE trim(query) <> ''""",
    "json_documents": "SELECT source, tz_name, full_name, medium FROM source_registry",
    "metadata_map": "SELECT DISTINCT doc_id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.ementa') END AS summary FROM store_documents",
    "nested_histories": f"{retrieval._TURNS} SELECT CAST(session_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS turn, role, content FROM t WHERE turn < 2000",
    "skipped_files": "SELECT DISTINCT doc_id AS path FROM store_documents s WHERE NOT EXISTS (SELECT 1 FROM quality_reports q WHERE q.doc_id = s.doc_id)",
    "html_rows": """WITH p AS (SELECT 'http://x.org/l/' || doc_id AS url, doc_id, source FROM documents) SELECT url, 0 AS row_no, source AS value, NULL AS link FROM p UNION ALL SELECT url, 1, CAST(doc_id AS VARCHAR), NULL FROM p
        UNION ALL SELECT url, 2, 'ver pdf', 'http://x.org/l/f/' || doc_id || '.PDF?x=1' FROM p""",
    "html_details": "SELECT 'http://x.org/l/' || doc_id AS url, source, CAST(doc_id AS VARCHAR) AS number FROM documents",
    "html_texts": "SELECT doc_id, true AS has_end, true AS too_short FROM documents",
    "link_kinds": "SELECT ['revoked_by', 'revokes', 'amends', 'correlates'][item_id % 4 + 1] AS relation_type, count(*) AS n FROM eval_items GROUP BY 1",
    "golden_ids": "SELECT DISTINCT upper(doc_type) || '-' || number || '-art7' AS raw, regexp_replace(lower(doc_type), '[^a-z0-9]', '', 'g') || '_' || regexp_replace(number, '/[0-9]{4}$', '') || '-art7' AS golden FROM store_documents WHERE number IS NOT NULL AND doc_type IS NOT NULL",
    "safe_names": "SELECT DISTINCT title, substr(regexp_replace(title, '[^a-zA-Z0-9._-]', '_', 'g'), 1, 100) AS name FROM store_documents WHERE title IS NOT NULL",
    "chunk_owners": "SELECT DISTINCT log_id, doc_id FROM embedding_log WHERE doc_id IS NOT NULL",
}
