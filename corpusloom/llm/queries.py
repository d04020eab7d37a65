"""Queries of the llm operators over the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import boilerplate, leakage, packing, scans, splitting, toxicity
from corpusloom.runtime import table

MAX_WORDS, OVERLAP, CAPACITY = 400, 40, 1024


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_documents(table(spark, folder, "store_documents"), MAX_WORDS, OVERLAP, with_text=False)
    return splitting.oversized(pieces)


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_documents(table(spark, folder, "store_documents"), MAX_WORDS, OVERLAP)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scan_noise(table(spark, folder, "store_documents")).distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repaired(table(spark, folder, "store_documents"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, folder, "store_documents")).select("source", "line_text")


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "store_documents").select("doc_id", "source", "content")
    return boilerplate.without_lines(docs, boilerplate.repeated_lines(docs)).select("doc_id", "source", "clean_content")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), CAPACITY)
    return packed.filter("n_parts > 1").select("doc_id").distinct()


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(packing.pack(table(spark, folder, "documents"), CAPACITY), CAPACITY)


def p7_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), CAPACITY)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), slack=None)
    return found.select("doc_id", "item_id")


def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels, terms = (table(spark, folder, n) for n in ("documents", "abuse_labels", "abuse_terms"))
    return toxicity.score_documents(documents, toxicity.fit(documents, labels, terms))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).filter("toxic").select("doc_id").distinct()


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder)


def p9_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.source_rates(_scored(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_pieces, p3_found, p3_repaired, p6_found, p6_clean, p7_found, p7_containers, p7_assignment, p8_found, p8_matches, p9_found, p9_scores, p9_source_rates)
}

WORD_COUNT = r"len(regexp_extract_all({}, '[^ \t\n\r\f]+'))"
TOKEN_COUNT = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'))"

SQL = {
    "p2_found": f"SELECT DISTINCT doc_id FROM store_documents WHERE {WORD_COUNT.format('content')} > {MAX_WORDS}",
    "p6_found": r"""
        WITH lines AS (
            SELECT DISTINCT source, doc_id, regexp_replace(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), '[0-9]+', '#', 'g') AS line_text
            FROM (SELECT source, doc_id, unnest(string_split(content, chr(10))) AS line FROM store_documents WHERE source IS NOT NULL AND doc_id IS NOT NULL)
        ), sizes AS (
            SELECT source, count(DISTINCT doc_id) AS n FROM store_documents WHERE content IS NOT NULL GROUP BY source
        ), counts AS (
            SELECT source, line_text, count(*) AS n_docs FROM lines
            WHERE len(regexp_extract_all(line_text, '\pL')) >= 15 GROUP BY source, line_text
        )
        SELECT source, line_text FROM counts JOIN sizes USING (source) WHERE n_docs >= 5 AND n_docs >= 0.1 * n""",
    "p7_found": f"SELECT DISTINCT doc_id FROM documents WHERE {TOKEN_COUNT.format('text')} > {CAPACITY}",
}
