"""Dates and times as written anywhere, normalised to one calendar day or one UTC instant.

Raw strings repeat, so they are first reduced to a dictionary of distinct values (with kind, zone and order of day and
month); each entry is parsed once, by trying every known format; the dictionary is kept as a table to which later runs
add unseen values only, each run in a folder of its own that counts once it is complete, so that runs at the same time do
no harm; rows get their normal form by a join with it.

Defined results for odd input: null, blank, incomplete and impossible values denote nothing and get no row; a zone that is
unknown counts as UTC; a null order of day and month counts as day first; repeated rows give one row of the result.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import sys
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import delete_path, materialize, shared_dir, skew_safe_join

MONTHS = {
    name: i
    for language in (
        "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
        "january february march april may june july august september october november december",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
        "jan fev mar abr mai jun jul ago set out nov dez",
        "jan feb mar apr may jun jul aug sep oct nov dec",
        "ene feb mar abr may jun jul ago sep oct nov dic",
    )
    for i, name in enumerate(language.split(), 1)
} | {"marco": 3, "sept": 9, "setiembre": 9}
#: Minutes from UTC of zone names, as used where the sources are.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "brt": -180, "brst": -120, "amt": -240, "amst": -180, "act": -300, "fnt": -120,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "art": -180,
}
TIME = r"(?P<H>\d{1,2})(?::|h)(?P<M>\d{2})(?:(?::|m(?:in)?)(?P<S>\d{2})s?(?:[.,]\d+)?)?h?"
OFFSET = r"(?:\s*(?P<off>[+-]\d{2}(?::?\d{2})?|[a-z]{1,5}(?:[+-]\d{1,2})?(?![a-z/_])))?(?:\s*\[?(?P<tz>[a-z]+(?:/[a-z0-9_+-]+)+)\]?)?"
ISO = r"(?P<Y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})"
NUMERIC = r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4}|\d{2})"
NAMED = r"(?P<d>\d{1,2})(?:\s*[ºo°ª]|\.|st|nd|rd|th)?(?:\s+de\s+|\s+of\s+|\s*-\s*|\s+|/)(?P<mon>[a-zç]{3,10})\.?(?:\s+de\s+|\s*-\s*|,?\s+|/)(?P<y>\d{4}|\d{2})"
NAMED_US = r"(?P<mon>[a-zç]{3,10})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})"
BASIC = r"(?P<Y>\d{4})(?P<m>\d{2})(?P<d>\d{2})"
DAYS = [re.compile(rf"(?:[a-zç]{{2,9}}(?:-feira)?\.?,\s*)?{p}(?:(?:[t,]|\s+às|\s+as|\s+at|\s)\s*{TIME}{OFFSET})?") for p in (ISO, NUMERIC, NAMED, NAMED_US)]
COMPACT = re.compile(rf"{BASIC}(?:t(?P<H>\d{{2}})(?P<M>\d{{2}})(?P<S>\d{{2}})?(?:[.,]\d+)?{OFFSET})?")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Digits after which an all-digit instant is in milli-, micro- or nanoseconds.
UNITS = {**dict.fromkeys((9, 10, 11), 1), **dict.fromkeys((12, 13, 14), 10**3), **dict.fromkeys((15, 16, 17), 10**6), **dict.fromkeys((18, 19, 20), 10**9)}


@lru_cache(maxsize=256)
def _zone(name: str | None):
    try:
        return ZoneInfo(name) if name else timezone.utc
    except Exception:
        return timezone.utc


@lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    return {n.lower(): n for n in available_timezones()}


def _parts(raw: str, month_first: bool):
    """Calendar day, whether there is a time of day, and offset and zone id (or None) of a written date; None if it isn't one."""
    text = re.sub(r"\s+", " ", raw.strip().lower())
    m = COMPACT.fullmatch(text) or next((m for p in DAYS if (m := p.fullmatch(text))), None)
    if not m:
        return None
    g = m.groupdict()
    if g.get("a"):
        month, day = (g["a"], g["b"]) if month_first else (g["b"], g["a"])
    else:
        month, day = g.get("m") or MONTHS.get(g["mon"]), g["d"]
    year = g.get("Y") or g["y"]
    if month is None:
        return None
    y = int(year) if len(year) == 4 else int(year) + (2000 if int(year) < 50 else 1900)
    try:
        if g.get("H") is None:
            return datetime(y, int(month), int(day)), False, None, None
        return datetime(y, int(month), int(day), int(g["H"]), int(g["M"]), int(g["S"] or 0)), True, g.get("off"), g.get("tz")
    except ValueError:
        return None


def _offset(text: str) -> timedelta | None:
    m = re.fullmatch(r"([+-])(\d{2}):?(\d{2})?", text)
    if m:
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return timedelta(minutes=-minutes if m[1] == "-" else minutes) if minutes < 1440 else None
    m = re.fullmatch(r"(utc|gmt)([+-]\d{1,2})", text)
    if m:
        return timedelta(hours=int(m[2]))
    return timedelta(minutes=ZONES[text]) if text in ZONES else None


def parse_day(raw: str, month_first: bool = False) -> str | None:
    """``YYYY-MM-DD`` of a written calendar day; a time of day, if any, is ignored."""
    parts = _parts(raw, month_first)
    return parts[0].strftime("%Y-%m-%d").rjust(10, "0") if parts else None


def parse_instant(raw: str, zone: str | None = None, month_first: bool = False) -> str | None:
    """``YYYY-MM-DDTHH:MM:SSZ`` of a written instant. A local time that occurs twice is its first occurrence; one that
    is skipped takes the offset before the change (both are ``fold=0``)."""
    text = raw.strip()
    try:
        if text.isascii() and text.isdigit() and len(text) in UNITS:
            t = EPOCH + timedelta(seconds=int(text) // UNITS[len(text)])
        else:
            parts = _parts(raw, month_first)
            if not parts or not parts[1]:
                return None
            local, _, off, named = parts
            if off:
                delta = _offset(off)
                if delta is None:
                    return None
                t = local - delta
            elif named and named not in _zone_names():
                return None
            else:
                t = local.replace(tzinfo=_zone(_zone_names()[named] if named else zone)).astimezone(timezone.utc)
    except (OverflowError, ValueError):
        return None
    return t.strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")


ENTRY = "kind string, raw string, zone string, month_first boolean, normal_value string"
KEYS = ["kind", "raw", "zone", "month_first"]


def parse_entries(entries: DataFrame) -> DataFrame:
    """Dictionary entries with their normal form; ``kind`` is ``day`` or ``instant``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, raws, zones, firsts = (b.column(i).to_pylist() for i in range(4))
            normal = [
                parse_day(r, f) if k == "day" else parse_instant(r, z, f) for k, r, z, f in zip(kinds, raws, zones, firsts)
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(normal, pa.string())], names=[*KEYS, "normal_value"])

    return entries.select(*KEYS).mapInArrow(run, ENTRY)


def dictionary_path(spark: SparkSession) -> str:
    """Where the dictionary lies by default: in the shared folder, under a name that changes with the rules of this module."""
    rules = hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/corpusloom-instants-{rules}"


def _complete(spark: SparkSession, path: str) -> list[str]:
    """The folders of a dictionary that were written to their end."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    p = fs_path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(x.toString() for x in found if fs.exists(fs_path(x, "_SUCCESS")))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """All entries at ``path``, each once: two runs at the same time may both have parsed a value, with the same result."""
    parts = _complete(spark, path)
    if not parts:
        return spark.createDataFrame([], ENTRY)
    rows = spark.read.schema(ENTRY).parquet(*parts)
    return rows if len(parts) == 1 else rows.distinct()


def extend_dictionary(spark: SparkSession, path: str, values: DataFrame) -> DataFrame:
    """The dictionary at ``path`` after adding what it lacks of ``values`` (distinct entries); only that is parsed."""
    parts = _complete(spark, path)
    new = values.join(dictionary(spark, path), KEYS, "left_anti") if parts else values
    folder = f"{path}/{uuid.uuid4().hex}"
    parse_entries(new).write.parquet(folder)
    if parts and spark.read.schema(ENTRY).parquet(folder).isEmpty():
        delete_path(spark, folder)
    return dictionary(spark, path)


def normalise(documents: DataFrame, registry: DataFrame, days: list[str], instants: list[str], path: str | None = None) -> DataFrame:
    """``(doc_id, field_name, raw, normal_value)`` for each value that denotes a day or an instant.

    Both the zone and the order of day and month come from ``registry`` (a fixed table, one row per source). Hot raw
    values are joined by broadcast (see ``skew_safe_join``).
    """
    spark = documents.sparkSession
    sources = registry.select(
        "source", F.col("tz_name").alias("zone"), (F.coalesce("date_order", F.lit("dmy")) == "mdy").alias("month_first")
    ).dropDuplicates(["source"])
    fields = [F.struct(F.lit(f).alias("field_name"), F.lit("day").alias("kind"), F.col(f).alias("raw")) for f in days]
    fields += [F.struct(F.lit(f).alias("field_name"), F.lit("instant").alias("kind"), F.col(f).alias("raw")) for f in instants]
    # a source table is small by nature: its join needs no hint, Spark compares its size with the threshold
    rows = (
        documents.select("doc_id", "source", F.explode(F.array(*fields)).alias("v"))
        .select("doc_id", "source", "v.*")
        .filter(F.length(F.trim("raw")) > 0)
        .join(sources, "source", "left")
        .select(
            "doc_id", "field_name", "kind", "raw",
            # a calendar day doesn't depend on the zone
            F.when(F.col("kind") == "day", F.lit("")).otherwise(F.coalesce("zone", F.lit("UTC"))).alias("zone"),
            F.coalesce("month_first", F.lit(False)).alias("month_first"),
        )
    )
    counts = materialize(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), "values")
    known = extend_dictionary(spark, path or dictionary_path(spark), counts.select(*KEYS))
    # the dictionary may hold far more than this table's values
    entries = materialize(known.filter(F.col("normal_value").isNotNull()).join(counts.select(*KEYS), KEYS, "left_semi"), "entries")
    return skew_safe_join(rows, entries, counts, KEYS).select("doc_id", "field_name", "raw", "normal_value")


def changed_values(normalised: DataFrame) -> DataFrame:
    """Distinct values whose normal form differs from what was written."""
    return normalised.filter(F.col("raw") != F.col("normal_value")).select("doc_id", "field_name", "normal_value").distinct()
