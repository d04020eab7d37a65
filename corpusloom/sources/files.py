"""Sources that are files: Parquet by source, query lists, nested histories, JSON folders, XML articles, PDF folders (SRC-01..17)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = (
    "session_id string, title string, model string, created_at string, messages array<struct<role:string,content:string,timestamp:string,"
    "message_id:string,model:string,use_rag:boolean,ratings:map<string,int>>>"
)


def vectors(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    """Chunk vectors of one source or all, schemas merged (SRC-05); one source reads only its partition."""
    df = spark.read.option("mergeSchema", True).parquet(folder)
    return df if source is None else df.filter(F.col("source") == source)


def file_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and size of each file (SRC-07)."""
    df = spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"))
    return df.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.max("size") / 1048576, 2).alias("mb"))


def query_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV list of queries (SRC-08, SRC-09): blank ones are left out; a missing id is ``Q`` and the place in the file.

    The place comes from a file that is read as one partition: such lists are small by nature.
    """
    rows = spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True).coalesce(1)
    numbered = rows.withColumn("_i", F.monotonically_increasing_id() + 1)
    own = F.col("query_id") if "query_id" in rows.columns else F.lit(None).cast("string")
    filled = numbered.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    return filled.withColumn("query_id", F.coalesce(F.nullif(own, F.lit("")), F.format_string("Q%03d", "_i"))).drop("_i")


def json_folder(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """JSON documents of a folder with their path and name (SRC-10)."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(folder)
    return df.withColumns({"_source_path": F.col("_metadata.file_path"), "_filename": F.col("_metadata.file_name")})


def chat_histories(spark: SparkSession, folder: str) -> DataFrame:
    """Nested chat histories (SRC-11)."""
    return spark.read.schema(HISTORY).option("multiLine", True).json(folder)


def parsed_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """JSON text as a map; broken or missing JSON is an empty map (SRC-01, MSC-24)."""
    return df.withColumn(column, F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>")))


def xml_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of legal XML (SRC-17): ``(article, label, text)``, the caput and each paragraph with its label."""
    schema = "_id string, Rotulo string, Caput struct<p:string>, Paragrafo array<struct<Rotulo:string,p:string>>"
    rows = spark.read.format("xml").option("rowTag", "Artigo").schema(schema).load(path)
    parts = F.transform(F.coalesce("Paragrafo", F.array()), lambda p: F.concat_ws(": ", p["Rotulo"], p["p"]))
    return rows.select(F.col("_id").alias("article"), F.col("Rotulo").alias("label"), F.array_join(F.array_compact(F.concat(F.array("Caput.p"), parts)), "\n").alias("text"))


def pdf_texts(spark: SparkSession, folder: str, extractors: list[tuple[Callable[[bytes], str | None], int]]) -> DataFrame:
    """``(path, text)`` of a folder's PDF files (SRC-12, SRC-13): the first extractor whose stripped text is longer than its
    minimum; none gives null. Extractors are the caller's, as no PDF library is part of this package."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for content in b["content"]:
                found = None
                for extract, least in extractors:
                    try:
                        text = extract(bytes(content))
                    except Exception:
                        continue
                    if text and len(text.strip()) > least:
                        found = text
                        break
                texts.append(found)
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def unlogged(files: DataFrame, log: DataFrame, force: bool = False) -> DataFrame:
    """Files whose path isn't in the log yet (SRC-16)."""
    return files if force else files.join(log.select("path").distinct(), "path", "left_anti")
