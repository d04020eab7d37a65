"""References to records that do not exist, by as-of match against runs of parent keys.

Every key becomes a *name space* and an integer: the last group of digits is the integer, the text around it (and the
group's width, where it has leading zeros) is the name space, so that two keys are equal exactly if both parts are.
The sorted integers of the parents of a name space are compressed into contiguous runs, cut at multiples of ``SPAN`` so
that the runs of a (name space, block) are a bounded list. A reference looks up the run that starts last at or before its
integer; it is an orphan if there is none or if it lies beyond the end of that run.

Defined results for odd input: null and blank references are no references; parents with null or blank keys don't count;
repeated rows give one row of the result; empty parents make every reference an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import hot_keys, materialize, strip

#: Integers per block; a block has at most SPAN / 2 runs.
SPAN = 1024


def id_key(c: Column) -> Column:
    """An id as it is compared: trimmed and lower-cased; null if blank."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def number_key(c: Column) -> Column:
    """A register number as it is compared: trimmed, without any prefix up to a colon, without leading zeros."""
    text = F.regexp_replace(strip(c), r"^.*:", "")
    return F.nullif(F.regexp_replace(strip(text), r"^0+(?=.)", ""), F.lit(""))


def _coded(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``ns``, ``num`` and ``block`` of the key."""
    head, digits, tail = (F.regexp_extract(key, r"^(?s)(.*?)(\d{1,15})(\D*)$", i) for i in (1, 2, 3))
    split = digits != ""
    width = F.when(digits.startswith("0") & (F.length(digits) > 1), F.length(digits)).otherwise(0)
    ns = F.when(split, F.concat_ws("\x1f", head, tail, width.cast("string"))).otherwise(F.col(key))
    num = F.when(split, digits.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return df.withColumns({"ns": ns, "num": num}).withColumn("block", F.floor(F.col("num") / SPAN))


def key_runs(parents: DataFrame, key: str = "key") -> DataFrame:
    """``(ns, block, runs)``: the contiguous runs of the distinct parent keys, each list sorted by its start."""
    keys = _coded(parents.select(key).filter(F.col(key).isNotNull()), key).select("ns", "block", "num").distinct()
    # at most SPAN integers in a (ns, block), whatever the number of parents
    w = Window.partitionBy("ns", "block").orderBy("num")
    islands = keys.withColumn("island", F.col("num") - F.row_number().over(w))
    runs = islands.groupBy("ns", "block", "island").agg(F.min("num").alias("first"), F.max("num").alias("last"))
    return runs.groupBy("ns", "block").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def orphan_keys(references: DataFrame, parents: DataFrame, key: str = "key") -> DataFrame:
    """Distinct reference keys, with the number ``n`` of their rows and whether each is an ``orphan``."""
    distinct = references.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    coded = _coded(distinct, key).join(key_runs(parents, key), ["ns", "block"], "left")
    before = F.filter("runs", lambda r: r["first"] <= F.col("num"))
    preceding = F.try_element_at(before, F.lit(-1))
    beyond = F.coalesce(F.col("num") > preceding["last"], F.lit(True))
    return coded.select(key, "n", beyond.alias("orphan"))


def rows_with_orphans(references: DataFrame, parents: DataFrame, key: str = "key") -> DataFrame:
    """The rows of ``references`` whose key no parent has; rows without a key are left out.

    The match runs over distinct keys, so a key that a third of the rows refer to costs one lookup. The rows of hot
    keys (fewer than 1,000 by definition) then meet their verdict by broadcast, the others in a shuffled semi join.
    """
    verdicts = materialize(orphan_keys(references, parents, key), "orphans")
    given = references.filter(F.col(key).isNotNull())
    hot = hot_keys(verdicts, [key])
    lost = verdicts.filter("orphan").select(key)
    few = given.join(F.broadcast(lost.join(F.broadcast(hot), key, "left_semi")), key, "left_semi")
    rest = given.join(F.broadcast(hot), key, "left_anti").join(lost, key, "left_semi")
    return few.unionByName(rest)


def orphan_references(
    relations: DataFrame, log: DataFrame, reports: DataFrame, documents: DataFrame, base: DataFrame
) -> DataFrame:
    """``(table_name, record_id, field_name, period)`` of references that lead nowhere, ``period`` being the month."""
    both = documents.select("doc_id", "source_ref").unionByName(base.select("doc_id", "source_ref"))
    ids = both.select(id_key(F.col("doc_id")).alias("key"))
    numbers = both.select(number_key(F.col("source_ref")).alias("key"))

    def refs(df: DataFrame, table: str, record: str, field: str, key: Column, alternative: Column, at: Column) -> DataFrame:
        return df.select(
            F.lit(table).alias("table_name"),
            F.col(record).cast("bigint").alias("record_id"),
            F.lit(field).alias("field_name"),
            F.substring(at.cast("string"), 1, 7).alias("period"),
            key.alias("key"),
            alternative.alias("number"),
        )

    none = F.lit(None).cast("string")
    target = refs(relations, "document_relations", "relation_id", "target", id_key(F.col("target_doc_id")), number_key(F.col("target_ref")), F.col("recorded_at"))
    by_id = (
        refs(relations, "document_relations", "relation_id", "source_doc_id", id_key(F.col("source_doc_id")), none, F.col("recorded_at"))
        .unionByName(target)
        .unionByName(refs(log, "embedding_log", "log_id", "doc_id", id_key(F.col("doc_id")), none, F.col("embedded_at")))
        .unionByName(refs(reports, "quality_reports", "report_id", "doc_id", id_key(F.col("doc_id")), none, F.col("checked_at")))
    )
    unresolved = materialize(rows_with_orphans(by_id, ids), "unresolved")
    # a target may still be found by its number; so may one that has a number only
    numbered = unresolved.filter(F.col("number").isNotNull()).unionByName(target.filter(F.col("key").isNull() & F.col("number").isNotNull()))
    names = ["table_name", "record_id", "field_name", "period"]
    lost = rows_with_orphans(numbered.select(*names, F.col("number").alias("key")), numbers)
    return unresolved.filter(F.col("number").isNull()).select(*names).unionByName(lost.select(*names)).distinct()


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, field and month."""
    return orphans.groupBy("table_name", "field_name", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
