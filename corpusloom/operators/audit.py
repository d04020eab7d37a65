"""Audits of the index and exploded search traces (PRJ-05, JON-10, JON-11, AGG-31, MSC-12, MSC-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Latest active documents without a latest chunk, with the chunks of any version of their canonical id (JON-10)."""
    wanted = documents.filter("status = 'active' AND is_latest = 1 AND canonical_id IS NOT NULL").select("doc_id", "canonical_id").distinct()
    counts = chunks.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("is_latest") == 1).alias("n_latest"))
    joined = wanted.join(counts, "canonical_id", "left")
    return joined.filter(F.coalesce("n_latest", F.lit(0)) == 0).select("doc_id", "canonical_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def best_document(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """For each canonical id its best document: latest first, then newest, then least id (JON-11)."""
    best = documents.filter("canonical_id IS NOT NULL").groupBy("canonical_id").agg(
        F.min_by("doc_id", F.struct((-F.coalesce("is_latest", F.lit(0))).alias("a"), (-F.coalesce(F.try_to_number("version_year", F.lit("9999")), F.lit(0))).alias("b"), "doc_id")).alias("doc_id")
    )
    return ids.join(best, "canonical_id", "left")


def explode_trace(traces: DataFrame) -> DataFrame:
    """One row per query, sub-query and document of a trace; a query or sub-query without any keeps a row with nulls (PRJ-05).

    ``traces``: ``query_id, sub_queries array<struct<text, documents array<struct<regulation_id, score>>>>, evaluations
    array<struct<regulation_id, relevance>>, generator array<string>``. Facts of later stages are looked up in the row itself;
    the last entry of a document counts.
    """
    subs = traces.select("query_id", "evaluations", "generator", F.posexplode_outer("sub_queries").alias("sub_index", "s"))
    docs = subs.select("query_id", "evaluations", "generator", "sub_index", F.col("s.text").alias("sub_query"), F.posexplode_outer("s.documents").alias("rank", "d"))
    own = F.filter("evaluations", lambda e: e["regulation_id"] == F.col("d.regulation_id"))
    return docs.select(
        "query_id", "sub_index", "sub_query", "rank", "d.regulation_id", F.col("d.score").alias("score"),
        F.try_element_at(own, F.lit(-1))["relevance"].alias("relevance"),
        F.coalesce(F.array_contains("generator", F.col("d.regulation_id")), F.lit(False)).alias("in_context"),
    )


def ordered_columns(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first, ``input__*`` right after ``query``, then the others (PRJ-06)."""
    extra = [c for c in df.columns if c.startswith("input__")]
    first = [x for c in preferred if c in df.columns for x in ([c, *extra] if c == "query" else [c])]
    return df.select(*dict.fromkeys([*first, *df.columns]))


def compact_json(column: str):
    """JSON of a list, empty text for an empty one (MSC-12)."""
    return F.when(F.coalesce(F.size(column), F.lit(0)) <= 0, F.lit("")).otherwise(F.to_json(column))
