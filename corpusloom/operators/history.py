"""History of changing attributes: every state of an entity with the period in which it held.

The raw observations are kept as a change log beside the history, both in generations. A late or corrected batch is
applied by *affected-chain rebuild*: its rows become a new generation of the log, the touched keys' raw changes are read
from all generations (of the base only from their buckets), all intervals of those keys and no others are built anew and
written as a new generation of the history, and one manifest file makes both current. A reader takes each key from its newest
generation. ``compact`` is a job of its own that merges the generations into a new base.

Defined results for odd input: rows with a null or blank key, a null date or ``is_latest`` other than 1 don't count;
a null attribute is a value like any other; repeated rows and exact ties change nothing (the greatest row counts); an
empty batch leaves the history as it is; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.runtime import delete_path, strip

OPEN_END = "9999-12-31"
LOG_SCHEMA = "key string, day date, version_year string, ingested_at timestamp, effective_date string, status string, snapshot_id bigint"
HISTORY_SCHEMA = "key string, valid_from date, valid_to date, version_year string, effective_date string, status string"
STATE = ["version_year", "effective_date", "status"]
#: What the counting row of a key and day is the greatest by.
ORDER = ["version_year", "ingested_at", "snapshot_id", "effective_date", "status"]
#: Most buckets of a base, and rows of one of its files.
MOST_BUCKETS, FILE_ROWS = 1024, 250_000


def daily_changes(snapshots: DataFrame) -> DataFrame:
    """The counting row of each key and day, in the layout of the change log.

    A maximum is associative, so this pre-aggregates on the map side: a key that holds a third of all rows shrinks to
    one row per day before any shuffle, and merging with older log entries uses the same rule.
    """
    key = F.lower(strip(F.col("canonical_id")))
    rows = snapshots.select(
        key.alias("key"),
        F.col("snapshot_date").cast("date").alias("day"),
        F.struct(*ORDER).alias("row"),
    ).where((F.col("is_latest") == 1) & (F.col("key") != "") & F.col("day").isNotNull())
    return _best(rows)


def _best(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("key", "day").agg(F.max("row").alias("row"))
    return best.select(
        "key", "day", "row.version_year", "row.ingested_at", "row.effective_date", "row.status", "row.snapshot_id"
    )


def build_chains(log: DataFrame, place: tuple[str, ...] = ()) -> DataFrame:
    """Intervals of every key of ``log`` (one row per key and day); ``place`` are columns that depend on the key and that the rows
    may be partitioned by already.

    The window of a key holds at most one row per calendar day, which bounds it at any data size.
    """
    w = Window.partitionBy(*place, "key").orderBy("day")
    state = F.struct(*STATE)
    starts = log.withColumn("_before", F.lag(state).over(w)).filter(
        F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state)
    )
    return starts.select(
        "key",
        F.col("day").alias("valid_from"),
        F.coalesce(F.lead("day").over(w), F.lit(OPEN_END).cast("date")).alias("valid_to"),
        *STATE,
        *place,
    )


class Conflict(Exception):
    """Another writer was first."""


@dataclass
class HistoryStore:
    """A change log and the history built from it, in generations below ``path``.

    The manifest with the highest number is current. It names the folders of all generations; the first, the base, lies in key
    buckets, as many as its size asks for (or ``buckets``). A writer that finds the number it wanted taken rebuilds its
    chains on what the other has made current, so neither loses anything. A reader sees either the whole old or the whole
    new state.
    """

    spark: SparkSession
    path: str
    buckets: int = 0

    # ---- files

    def _hadoop(self, name: str = ""):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(conf)

    def _names(self) -> list[str]:
        p, fs = self._hadoop()
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _publish(self, manifest: dict) -> None:
        """Make ``manifest`` current as the next version, unless there is one of that number."""
        sc, name = self.spark.sparkContext, f"manifest-{manifest['version']:010d}.json"
        new, fs = self._hadoop(f"new-{uuid.uuid4().hex}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fields = sc._jvm.org.apache.hadoop.fs
        context = fields.FileContext.getFileContext(sc._jvm.java.net.URI(self.path), sc._jsc.hadoopConfiguration())
        mode = sc._gateway.new_array(fields.Options.Rename, 1)
        mode[0] = fields.Options.Rename.NONE
        try:
            context.rename(new, self._hadoop(name)[0], mode)
        except Exception as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def manifest(self) -> dict:
        versions = [n for n in self._names() if n.startswith("manifest-")]
        if not versions:
            return {"version": 0, "buckets": 1, "generations": []}
        p, fs = self._hadoop(versions[-1])
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _generations(self, part: str, manifest: dict, buckets: list[int] | None = None) -> list[DataFrame]:
        """The rows of each generation, of the base only those in some buckets."""
        schema, out = LOG_SCHEMA if part == "log" else HISTORY_SCHEMA, []
        for k, folder in enumerate(manifest["generations"]):
            rows = self.spark.read.schema(schema if k else f"{schema}, bucket int").parquet(f"{self.path}/{part}-{folder}")
            if not k:
                rows = (rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).drop("bucket")
            out.append(rows)
        return out

    def log(self, manifest: dict | None = None) -> DataFrame:
        """The counting row of every key and day."""
        parts = self._generations("log", manifest or self.manifest())
        rows = functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], LOG_SCHEMA)
        return _best(rows.select("key", "day", F.struct(*ORDER).alias("row"))) if len(parts) > 1 else rows

    def history(self, manifest: dict | None = None) -> DataFrame:
        """The intervals of every key, each from the newest generation that has it."""
        parts = self._generations("history", manifest or self.manifest())
        out, later = None, None
        for rows in reversed(parts):
            own = rows if later is None else rows.join(later, "key", "left_anti")
            out = own if out is None else out.unionByName(own)
            keys = rows.select("key").distinct()
            later = keys if later is None else later.unionByName(keys)
        return self.spark.createDataFrame([], HISTORY_SCHEMA) if out is None else out

    # ---- updates

    def _write_base(self, log: DataFrame, n: int, name: str) -> int:
        """Write a base of about ``n`` log rows: buckets of the key's hash, each in as many tasks as its size asks for."""
        files = max(1, -(-n // FILE_ROWS))
        buckets = self.buckets or min(MOST_BUCKETS, files)
        slices = -(-files // buckets)
        hashed = F.xxhash64("key")
        placed = log.withColumn("bucket", F.pmod(hashed, F.lit(buckets)).cast("int")).withColumn("slice", F.pmod(F.shiftright(hashed, 32), F.lit(slices)).cast("int"))
        placed.repartition(min(files, 10_000), "bucket", "slice").write.partitionBy("bucket").parquet(f"{self.path}/log-{name}")
        # every key's rows are in one partition, so the window needs no shuffle of its own
        again = self.spark.read.schema(f"{LOG_SCHEMA}, slice int, bucket int").parquet(f"{self.path}/log-{name}").repartition(min(files, 10_000), "bucket", "slice")
        build_chains(again, ("bucket", "slice")).drop("slice").write.partitionBy("bucket").parquet(f"{self.path}/history-{name}")
        return buckets

    def apply(self, snapshots: DataFrame) -> "HistoryStore":
        """Take a batch of observations, in any order and however late, and rebuild the chains it touches."""
        name, manifest = uuid.uuid4().hex, self.manifest()
        if not manifest["generations"]:
            buckets = self._write_base(daily_changes(snapshots), snapshots.count(), name)
            try:
                self._publish({"version": 1, "buckets": buckets, "generations": [name]})
                return self
            except Conflict:
                name = uuid.uuid4().hex
        daily_changes(snapshots).write.parquet(f"{self.path}/log-{name}")
        batch = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log-{name}")
        keys = batch.select("key").distinct()
        while True:
            manifest = self.manifest()
            # at most MOST_BUCKETS numbers
            touched = sorted(r[0] for r in keys.select(F.pmod(F.xxhash64("key"), F.lit(manifest["buckets"])).cast("int")).distinct().collect())
            if not touched:
                return self
            old = functools.reduce(DataFrame.unionByName, self._generations("log", manifest, touched))
            raw = _best(old.join(keys, "key", "left_semi").unionByName(batch).select("key", "day", F.struct(*ORDER).alias("row")))
            build_chains(raw).write.mode("overwrite").parquet(f"{self.path}/history-{name}")
            try:
                self._publish(manifest | {"version": manifest["version"] + 1, "generations": [*manifest["generations"], name]})
                return self
            except Conflict:
                continue

    def compact(self) -> "HistoryStore":
        """Merge all generations into a new base, its buckets by its size. If a writer is first, nothing changes."""
        manifest, name = self.manifest(), uuid.uuid4().hex
        if len(manifest["generations"]) > 1:
            n = sum(rows.count() for rows in self._generations("log", manifest))
            buckets = self._write_base(self.log(manifest), n, name)
            try:
                self._publish({"version": manifest["version"] + 1, "buckets": buckets, "generations": [name]})
            except Conflict:
                for part in ("log", "history"):
                    delete_path(self.spark, f"{self.path}/{part}-{name}")
        return self

    def vacuum(self) -> "HistoryStore":
        """Delete what the current manifest doesn't name. Not to be run while others read older states or write."""
        manifest = self.manifest()
        keep = {f"{part}-{g}" for part in ("log", "history") for g in manifest["generations"]} | {f"manifest-{manifest['version']:010d}.json"}
        for n in self._names():
            if n not in keep and not n.startswith("."):
                delete_path(self.spark, f"{self.path}/{n}")
        return self


def history_rows(store: HistoryStore) -> DataFrame:
    """The history with its dates as ISO text."""
    h = store.history()
    return h.select(
        F.col("key").alias("canonical_id"),
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"),
        *STATE,
    )


def state_history(snapshots: DataFrame, path: str, late_days: int = 90, buckets: int = 0) -> HistoryStore:
    """History of all observations: those that arrived up to ``late_days`` before the last arrival are the first
    load, the later ones (with all late rows and corrections of that time) come in as an update."""
    store = HistoryStore(snapshots.sparkSession, path, buckets)
    last = snapshots.agg(F.max("ingested_at").alias("t")).first()["t"]
    if last is None:
        return store.apply(snapshots)
    late = F.coalesce(F.col("ingested_at") > F.lit(last) - F.expr(f"INTERVAL {int(late_days)} DAYS"), F.lit(False))
    return store.apply(snapshots.filter(~late)).apply(snapshots.filter(late))
