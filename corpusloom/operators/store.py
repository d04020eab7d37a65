"""The document store as pure transitions ``(old table, incoming rows) -> new table`` (SNK-01..08, SNK-12, WIN-01, JON-04..16).

A caller writes the result beside the old table and switches (see ``replace_table``); nothing overwrites what it reads.
Rows with a null key don't match anything: in the old table they stay, incoming ones are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.ids import content_hash, uuid_of
from corpusloom.runtime import all_of, hot_keys, materialize, scratch_path


def latest_incoming(incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; ties by all other columns."""
    others = [c for c in incoming.columns if c not in (key, order)]
    best = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(order), *others)).alias("_b"))
    return best.select(*(F.col(key) if c == key else F.col(f"_b.{c}").alias(c) for c in incoming.columns))


def upsert_actions(old: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, action)`` with ``inserted``, ``updated`` or ``unchanged`` by the hash of the content (SNK-01)."""
    new = incoming.select(key, content_hash(F.col("content")).alias("_new")).filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("_new").alias("_new"))
    had = old.select(key, F.col("content_hash").alias("_old"), F.lit(True).alias("_there")).dropDuplicates([key])
    action = F.when(F.col("_there").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return new.join(had, key, "left").select(key, action.alias("action"))


def upsert(old: DataFrame, incoming: DataFrame, key: str = "doc_id", at: str = "updated_at") -> DataFrame:
    """The table after an upsert: unchanged contents keep their row; changed ones keep ``source`` and ``scraped_at``."""
    new = latest_incoming(incoming.withColumn("content_hash", content_hash(F.col("content"))), key, at)
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    change = F.col(f"n.{key}").isNotNull() & (F.col(f"o.{key}").isNull() | ~F.col("o.content_hash").eqNullSafe(F.col("n.content_hash")))
    fresh = F.col(f"o.{key}").isNull() & F.col(f"n.{key}").isNotNull()
    kept = {"source", "scraped_at", "is_latest", key}

    def value(c: str):
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c in kept:
            return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(change, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*(value(c).alias(c) for c in old.columns))


def replace_by_key(old: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace those of their key (SNK-02)."""
    return old.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def merge_relations(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges, unique by source, reference and type; a known target stays unless a new one is given (SNK-03)."""
    keys = ["source_doc_id", "target_ref", "relation_type"]
    both = old.select(*keys, F.struct(F.lit(0).alias("new"), "target_doc_id").alias("t")).unionByName(incoming.select(*keys, F.struct(F.lit(1).alias("new"), "target_doc_id").alias("t")))
    return both.groupBy(*keys).agg(F.max(F.when(F.col("t.target_doc_id").isNotNull(), F.col("t")))["target_doc_id"].alias("target_doc_id"))


def cascade_delete(documents: DataFrame, log: DataFrame, relations: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without a source's documents: their log rows and outgoing edges go, edges to them lose their target (SNK-04)."""
    gone = documents.filter(F.col("source") == source).select("doc_id").distinct()
    edges = relations.join(gone.withColumnRenamed("doc_id", "source_doc_id"), "source_doc_id", "left_anti")
    hit = gone.select(F.col("doc_id").alias("target_doc_id"), F.lit(True).alias("_gone"))
    cut = with_lookup(edges, hit, "target_doc_id")
    target = F.when(F.col("_gone").isNull(), F.col("target_doc_id"))
    return (
        documents.filter(~F.col("source").eqNullSafe(F.lit(source))),
        log.join(gone, "doc_id", "left_anti"),
        cut.withColumn("target_doc_id", target).select(*relations.columns),
    )


def with_lookup(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``lookup`` (unique on ``key``), nulls where it has none; hot keys don't clog the join."""
    extra, types = [c for c in lookup.columns if c != key], dict(lookup.dtypes)
    known = rows.filter(F.col(key).isNotNull())
    hot = hot_keys(known.groupBy(key).agg(F.count(F.lit(1)).alias("n")), [key])
    few = known.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(lookup.join(F.broadcast(hot), key, "left_semi")), key, "left")
    rest = known.join(F.broadcast(hot), key, "left_anti").join(lookup, key, "left")
    blank = rows.filter(F.col(key).isNull()).withColumns({c: F.lit(None).cast(types[c]) for c in extra})
    return few.unionByName(rest).unionByName(blank).select(*rows.columns, *extra)


def delete_keys(df: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` without the rows of some keys (SNK-05); no keys, no change."""
    return df.join(keys.select(key).distinct(), key, "left_anti").select(*df.columns)


def rewritten(old: DataFrame, incoming: DataFrame, excluded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The old rows but for those of excluded keys, then the incoming ones (SNK-08)."""
    return delete_keys(old, excluded, key).unionByName(incoming, allowMissingColumns=True)


def upsert_points(old: DataFrame, points: DataFrame, key: str = "id") -> DataFrame:
    """Points replace those of their id; of several with one id the last by all their columns counts, those without an id get the
    UUID of their content (SNK-09)."""
    named = points.withColumn(key, F.coalesce(F.col(key).cast("string"), uuid_of(F.to_json(F.struct(*points.columns)))))
    others = [c for c in points.columns if c != key]
    one = named.groupBy(key).agg(F.max(F.struct(*others)).alias("_b")).select(key, "_b.*")
    return old.join(one.select(key), key, "left_anti").unionByName(one)


def append_events(log: DataFrame, events: DataFrame, valid: Column, order: list[str]) -> DataFrame:
    """The log with the valid events numbered on from its last id in a given order (SNK-11).

    Numbers come from counts of sorted partitions, so no task holds all events."""
    return log.unionByName(numbered(events.filter(valid), order, "event_id", log.agg(F.coalesce(F.max("event_id"), F.lit(-1)).alias("_last"))).select(*log.columns))


def numbered(df: DataFrame, order: list[str], name: str, last: DataFrame) -> DataFrame:
    """``df`` with consecutive numbers after the one row of ``last``: range-partitioned and written, then numbered by partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    placed = materialize(ranged, "numbered")
    # one row a partition
    starts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_p", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(starts), "_p").join(F.broadcast(last))
    return joined.withColumn(name, F.col("_last") + 1 + F.col("_before") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_first", "_before", "_last")


def resolve_relations(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges without a target get the least document that has their reference (JON-04, T-16)."""
    number = F.nullif(F.regexp_replace("source_ref", r"^.*:", ""), F.lit(""))
    lookup = documents.select(number.alias("target_ref"), "doc_id").filter("target_ref is not null").groupBy("target_ref").agg(F.min("doc_id").alias("_found"))
    return with_lookup(relations, lookup, "target_ref").withColumn("target_doc_id", F.coalesce(F.nullif("target_doc_id", F.lit("")), "_found")).select(*relations.columns)


def latest_versions(documents: DataFrame) -> DataFrame:
    """``(canonical_id, doc_id, version_year)`` of the newest version of each canonical id; ties by the least id (WIN-01, T-14).

    An arg-max aggregate, so a canonical id with a third of all rows is reduced before the shuffle.
    """
    known = documents.filter(F.col("canonical_id").isNotNull() & F.col("doc_id").isNotNull())
    by_year = known.groupBy("canonical_id", "version_year").agg(F.min("doc_id").alias("doc_id"))
    best = by_year.groupBy("canonical_id").agg(F.max(F.struct("version_year", "doc_id")).alias("b"))
    return best.select("canonical_id", "b.doc_id", "b.version_year")


def supersede(documents: DataFrame) -> DataFrame:
    """``documents`` with ``is_latest`` set anew and active older versions superseded (T-14, T-15)."""
    newest = latest_versions(documents).select(F.col("canonical_id").alias("_c"), F.col("doc_id").alias("_d"))
    joined = documents.join(newest, F.col("canonical_id") == F.col("_c"), "left")
    latest = F.when(F.col("_c").isNull(), F.col("is_latest")).otherwise((F.col("doc_id") == F.col("_d")).cast("int"))
    status = F.when(F.col("_c").isNotNull() & (F.col("doc_id") != F.col("_d")) & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return joined.withColumns({"is_latest": latest, "status": status}).select(*documents.columns)


def incremental_work(documents: DataFrame, log: DataFrame, mode: str) -> DataFrame:
    """Documents never embedded, embedded from other content or in another mode (FLT-13); the last log row of a document counts."""
    last = log.groupBy("doc_id").agg(F.max(F.struct("embedded_at", "log_id", "content_hash", "embedding_mode")).alias("_l"))
    joined = documents.join(last.withColumnRenamed("doc_id", "_k"), F.col("doc_id") == F.col("_k"), "left")
    stale = F.col("_k").isNull() | ~F.col("_l.content_hash").eqNullSafe(F.col("content_hash")) | ~F.col("_l.embedding_mode").eqNullSafe(F.lit(mode))
    return joined.filter(stale).select(*documents.columns)


def insert_new(old: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is new, one per key (SNK-12)."""
    new, had = incoming.dropDuplicates(keys).alias("n"), old.select(*keys).distinct().alias("o")
    same = all_of([F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return new.join(had, same, "left_anti")


def edges_of(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, relation_id)`` of edges that have a document at either end, by two equality joins (JON-09)."""
    ends = [relations.select(F.col(c).alias("doc_id"), "relation_id").filter("doc_id is not null") for c in ("source_doc_id", "target_doc_id")]
    return ends[0].unionByName(ends[1]).join(ids.select("doc_id").distinct(), "doc_id", "left_semi").distinct()


def first_seen(df: DataFrame, key, order: list[str]) -> DataFrame:
    """The first row of each key in the given order (SET-03, SET-04), as an aggregate."""
    columns = df.columns
    best = df.withColumn("_k", key).filter("_k is not null").groupBy("_k").agg(F.min(F.struct(*order, *(c for c in columns if c not in order))).alias("_b"))
    return best.select(*(F.col(f"_b.{c}").alias(c) for c in columns))


def replace_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write beside ``path`` first, then move: a failed write leaves the old table whole (SNK-06, SNK-08).

    Between the two renames a reader finds no table, and a crash there leaves the old one as ``path.old``, which the next call
    puts back first. Tables that are read all the time want generations and a manifest, as the history has them."""
    spark = df.sparkSession
    staged = scratch_path(spark, "staged")
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(staged)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs = target.getFileSystem(conf)
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.mkdirs(target.getParent())
    if not fs.rename(new, target):
        fs.rename(old, target)
        raise OSError(f"could not move {staged} to {path}")
    fs.delete(old, True)
