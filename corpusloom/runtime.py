"""Session-level services that every operator shares: tables, the shared scratch folder, skew-safe joins."""

from __future__ import annotations

import functools
import operator
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's ``str.strip`` set, for trims that must agree with text written by other tools.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only a local session without one gets a folder
    of its machine; on a cluster that is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="corpusloom-")
    sc.setCheckpointDir(f"file://{local}")
    return f"file://{local}"


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the session's part of the shared folder."""
    return f"{_session_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this session's queries wrote on the way. Results that were not read yet need it."""
    delete_path(spark, _session_dir(spark))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, whatever its scheme."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(conf).delete(hpath, True)


def strip(c: Column) -> Column:
    """Trim every kind of white space on both sides."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions)


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", share: int = 1000) -> DataFrame:
    """Keys that hold over 1/``share`` of all rows. By that definition there are fewer than ``share`` of them,
    so the result may be broadcast whatever the size of the data."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("_total"))
    return counts.join(F.broadcast(total)).filter(F.col(n) * share > F.col("_total")).select(*keys)


def skew_safe_join(rows: DataFrame, lookup: DataFrame, counts: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (unique on ``keys``) that no hot key can clog.

    ``counts`` has ``keys`` and the number ``n`` of rows of each. Rows of hot keys (fewer than ``share`` of them)
    are joined by broadcast of the lookup entries of just those keys; all others by a shuffled join.
    Rows with a null key have no partner. ``lookup`` must not change between two reads of it.
    """
    hot = hot_keys(counts, keys, share=share)
    hot_lookup = lookup.join(F.broadcast(hot), keys, "left_semi")
    few = rows.join(F.broadcast(hot_lookup), keys)
    marked = rows.join(F.broadcast(hot), keys, "left_anti")
    rest = marked.join(lookup, keys)
    return few.unionByName(rest)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(str(target))
    sc._corpusloom_shipped = True
