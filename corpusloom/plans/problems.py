"""Queries of the general data-pipeline operators (history, references, instants) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import history, instants, references
from corpusloom.runtime import scratch_path, table


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return history.history_rows(history.state_history(table(spark, folder, "document_snapshots"), scratch_path(spark, "history")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).select("canonical_id", "valid_from", "valid_to")


def p1_history(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder)


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    names = ("document_relations", "embedding_log", "quality_reports", "store_documents", "base_regulations")
    return references.orphan_references(*(table(spark, folder, n) for n in names))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("table_name", "record_id", "field_name").distinct()


def p4_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphans_by_period(_orphans(spark, folder))


def _instants(spark: SparkSession, folder: str) -> DataFrame:
    docs, registry = table(spark, folder, "store_documents"), table(spark, folder, "source_registry")
    return instants.normalise(docs, registry, ["effective_date", "expiry_date"], ["scraped_at"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return instants.changed_values(_instants(spark, folder))


def p5_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return _instants(spark, folder).distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_history, p4_found, p4_by_month, p5_found, p5_normalised)}

_HISTORY = r"""
    WITH rows AS (
        SELECT lower(trim(canonical_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS k, snapshot_date AS d, version_year, ingested_at,
               effective_date, status, snapshot_id
        FROM document_snapshots WHERE is_latest = 1 AND snapshot_date IS NOT NULL
    ), best AS (
        SELECT * FROM rows WHERE k <> ''
        QUALIFY row_number() OVER (PARTITION BY k, d ORDER BY version_year DESC NULLS LAST, ingested_at DESC NULLS LAST, snapshot_id DESC) = 1
    ), marked AS (
        SELECT *, row_number() OVER w AS i, lag(version_year) OVER w AS v0, lag(effective_date) OVER w AS e0, lag(status) OVER w AS s0
        FROM best WINDOW w AS (PARTITION BY k ORDER BY d)
    ), starts AS (
        SELECT * FROM marked WHERE i = 1 OR version_year IS DISTINCT FROM v0 OR effective_date IS DISTINCT FROM e0 OR status IS DISTINCT FROM s0
    ), periods AS (
        SELECT k AS canonical_id, strftime(d, '%Y-%m-%d') AS valid_from,
               coalesce(strftime(lead(d) OVER (PARTITION BY k ORDER BY d), '%Y-%m-%d'), '9999-12-31') AS valid_to, version_year, effective_date, status
        FROM starts
    )"""
_ORPHANS = r"""
    WITH both_tables AS (SELECT doc_id, source_ref FROM store_documents UNION ALL SELECT doc_id, source_ref FROM base_regulations),
    ids AS (SELECT DISTINCT lower(trim(doc_id)) AS k FROM both_tables WHERE doc_id IS NOT NULL),
    numbers AS (SELECT DISTINCT regexp_replace(trim(regexp_replace(trim(source_ref), '^.*:', '')), '^0+(.)', '\1') AS k FROM both_tables WHERE source_ref IS NOT NULL),
    refs AS (
        SELECT 'document_relations' AS table_name, relation_id AS record_id, 'source_doc_id' AS field_name, source_doc_id AS id, NULL AS ref, strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS period FROM document_relations
        UNION ALL SELECT 'document_relations', relation_id, 'target', target_doc_id, target_ref, strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') FROM document_relations
        UNION ALL SELECT 'embedding_log', log_id, 'doc_id', doc_id, NULL, substr(embedded_at, 1, 7) FROM embedding_log
        UNION ALL SELECT 'quality_reports', report_id, 'doc_id', doc_id, NULL, strftime(checked_at AT TIME ZONE 'UTC', '%Y-%m') FROM quality_reports
    ), keys AS (
        SELECT *, nullif(lower(trim(id)), '') AS ik, nullif(regexp_replace(trim(regexp_replace(trim(ref), '^.*:', '')), '^0+(.)', '\1'), '') AS rk FROM refs
    ), orphans AS (
        SELECT DISTINCT table_name, record_id, field_name, period FROM keys
        WHERE (ik IS NOT NULL OR rk IS NOT NULL)
          AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.k = ik) AND NOT EXISTS (SELECT 1 FROM numbers WHERE numbers.k = rk)
    )"""
SQL = {
    "p1_found": f"{_HISTORY} SELECT canonical_id, valid_from, valid_to FROM periods",
    "p1_history": f"{_HISTORY} SELECT * FROM periods",
    "p4_found": f"{_ORPHANS} SELECT DISTINCT table_name, record_id, field_name FROM orphans",
    "p4_by_month": f"{_ORPHANS} SELECT table_name, field_name, period, count(*) AS n_orphans FROM orphans GROUP BY ALL",
}
