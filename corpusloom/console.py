"""A read-only SQL console over the tables of a folder (EXT-05..08, MSC-23)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Statements that only read.
READING = ("select", "with", "explain", "describe", "show")
SAVED = {
    "sources": "SELECT source, count(*) AS n, round(avg(length(content)), 0) AS avg_chars, min(length(content)) AS min_chars, max(length(content)) AS max_chars FROM store_documents GROUP BY source ORDER BY source",
    "types": "SELECT source, doc_type, count(*) AS n FROM store_documents GROUP BY source, doc_type ORDER BY source, n DESC",
}


def open_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temporary views of Parquet tables."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def execute(spark: SparkSession, line: str, names: list[str]) -> DataFrame:
    """One statement or command: ``\\tables``, ``\\schema T``, ``\\counts``, or the name of a saved query after a backslash."""
    command = line.strip().rstrip(";")
    if command.startswith("\\"):
        name, *rest = command[1:].split()
        if name == "tables":
            return spark.sql("SHOW VIEWS").select("viewName")
        if name == "schema":
            return spark.sql(f"DESCRIBE {rest[0]}") if rest and re.fullmatch(r"\w+", rest[0]) else spark.sql("SHOW VIEWS")
        if name == "counts":
            return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in names))
        if name in SAVED:
            return spark.sql(SAVED[name])
        raise ValueError(f"unknown command {name}")
    if not command.lower().startswith(READING):
        raise ValueError("only statements that read are allowed")
    return spark.sql(command)
