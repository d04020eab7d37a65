"""Figures of evaluations, searches and audits (AGG-18, AGG-22, AGG-28..31, JON-08, JON-16, MSC-02, MSC-03, MSC-14..16, SCH-14, SRT-06..09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.store import with_lookup


def mean_or_null(c: str) -> Column:
    """The mean of what isn't null, null if there is nothing (AGG-22)."""
    return F.avg(c)


def filter_rate(before: str = "n_before", after: str = "n_after") -> Column:
    """The mean share that a filter removes, over queries that had anything before it; 0 if none had (AGG-18)."""
    return F.coalesce(F.avg(F.when(F.col(before) > 0, 1 - F.col(after) / F.col(before))), F.lit(0.0))


def pipeline_summary(runs: DataFrame, stages: list[str]) -> DataFrame:
    """One row over runs (``n_before, n_after`` and milliseconds of stages): the filter rate and the mean time of each stage (MSC-14)."""
    return runs.agg(F.count(F.lit(1)).alias("n_queries"), filter_rate().alias("filter_rate"), *(F.coalesce(F.avg(s), F.lit(0.0)).alias(f"avg_{s}") for s in stages))


def sampled_queries(golden: DataFrame, n: int) -> DataFrame:
    """``(query_id, seq, category)``: the first ``n`` retrieval queries in the order of ``seq``, and all coverage queries (SRT-07).

    A query's category is that of its first row. The first ``n`` are found as a top-n, without a window over all queries.
    """
    firsts = golden.filter(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min("seq").alias("seq"), F.min_by("category", "seq").alias("category"))
    coverage = F.coalesce(F.col("category") == "coverage", F.lit(False))
    return firsts.filter(~coverage).orderBy("seq", "query_id").limit(n).unionByName(firsts.filter(coverage))


def first_rows(golden: DataFrame) -> DataFrame:
    """Each query's first row, coverage queries left out (MSC-15)."""
    others = [c for c in golden.columns if c not in ("query_id", "seq")]
    best = golden.groupBy("query_id").agg(F.min(F.struct("seq", *others)).alias("b")).select("query_id", "b.*")
    return best.filter(F.coalesce(F.col("category") != "coverage", F.lit(True)))


def report_order(metrics: DataFrame, rank: str = "first_rank") -> list[Column]:
    """The order of a report: by rank, queries without one as if it were 99 (SRT-09)."""
    return [F.coalesce(F.col(rank), F.lit(99)).asc(), F.col("query_id").asc()]


def bypassed(hits: DataFrame, failed: bool = False) -> DataFrame:
    """Relevance without a reranker: the score in percent, or 50 for all if it failed (SCH-14)."""
    return hits.withColumn("relevance", F.lit(50.0) if failed else F.col("score") * 100)


def discarded(searched: DataFrame, evaluated: DataFrame, keys: tuple[str, ...] = ("query_id", "regulation_id")) -> DataFrame:
    """What was found but not kept (JON-16)."""
    return searched.join(evaluated.select(*keys).distinct(), list(keys), "left_anti")


def fetch_counts(hits: DataFrame, key: Column) -> DataFrame:
    """``(query_id, n_found, n_distinct)``: hits of each sub-query before and after removing repeats (AGG-30)."""
    return hits.withColumn("_k", key).groupBy("query_id", "_k").agg(F.count(F.lit(1)).alias("_n")).groupBy("query_id").agg(F.sum("_n").alias("n_found"), F.count("_k").alias("n_distinct"))


def grouped_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distinct values of each group as a sorted list (AGG-28); for groups that are small by their nature."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(value))


def cleaning_totals(cleaned: DataFrame, before: str, after: str, counters: list[str]) -> DataFrame:
    """Sums of cleaning counters and the percentage of characters removed (AGG-29)."""
    size = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0))
    out = cleaned.agg(F.count(F.lit(1)).alias("n_docs"), size(before).alias("chars_before"), size(after).alias("chars_after"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters))
    return out.withColumn("reduction_pct", F.coalesce((F.col("chars_before") - F.col("chars_after")) * 100.0 / F.nullif("chars_before", F.lit(0)), F.lit(0.0)))


def concentrated(golden: DataFrame, key: str, over: int = 10) -> DataFrame:
    """Documents that more than ``over`` rows expect (AGG-31)."""
    return golden.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > over)


def hybrid_points(dense: DataFrame, sparse: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Dense chunks with their sparse vectors; chunks without one keep nulls (JON-08)."""
    one = sparse.groupBy(key).agg(F.max(F.struct("indices", "values")).alias("_s"))
    return dense.join(one, key, "left").withColumns({"indices": F.col("_s.indices"), "values": F.col("_s.values")}).drop("_s")


def vector_kinds(chunks: DataFrame) -> list[str]:
    """Which kinds of vectors a table of chunks has, from its schema (MSC-02)."""
    return [kind for kind, c in (("dense", "embedding"), ("sparse", "indices")) if c in chunks.columns]


def collection_info(chunks: DataFrame) -> DataFrame:
    """Points and status of a table of chunks (MSC-03)."""
    return chunks.agg(F.count(F.lit(1)).alias("n_points")).withColumn("status", F.when(F.col("n_points") > 0, "ready").otherwise("empty"))


def golden_flags(golden: DataFrame, documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """``(query_id, doc_id, flags)`` of expected documents: not in the store, not the latest version, latest version not indexed (MSC-16)."""
    facts = documents.groupBy("doc_id").agg(F.max(F.coalesce("is_latest", F.lit(0))).alias("_latest"), F.lit(True).alias("_stored"))
    there = indexed.select("doc_id").distinct().withColumn("_indexed", F.lit(True))
    joined = with_lookup(with_lookup(golden, facts, "doc_id"), there, "doc_id")
    flags = F.array(
        F.when(F.col("_stored").isNull(), "missing_in_store"),
        F.when(F.col("_stored") & (F.col("_latest") != 1), "not_latest"),
        F.when(F.col("_stored") & (F.col("_latest") == 1) & F.col("_indexed").isNull(), "latest_not_indexed"),
    )
    return joined.select("query_id", "doc_id", F.array_join(F.array_compact(flags), ",").alias("flags"))
