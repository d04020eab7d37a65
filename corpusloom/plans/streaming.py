"""Queries that run as streams over files, until all that is available is read, with the SQL of the same result in batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import ann
from corpusloom.plans import retrieval
from corpusloom.runtime import scratch_path, table
from corpusloom.streaming import feedback as streams


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _drain(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is. Each batch is written to the shared folder by the executors: in complete mode the last
    one replaces those before, in append mode all count."""
    spark = df.sparkSession
    path, schema = scratch_path(spark, "stream"), df.schema

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces itself
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "checkpoint")).start()
    query.awaitTermination()
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException:  # no batch came
        return spark.createDataFrame([], schema)


def stream_event_windows(spark, folder):
    w = streams.windowed_counts(_stream(spark, folder, "events"), width="1 day", late="40 days")
    return _drain(w, "complete").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", F.round("total", 2).alias("total"))


def stream_event_types(spark, folder):
    events = _stream(spark, folder, "events")
    return _drain(events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_id", "ts").alias("last_event")), "complete")


def stream_current_feedback(spark, folder):
    events = retrieval.feedback_events(_stream(spark, folder, "events"))
    return _drain(streams.current_feedback_stream(events), "complete").drop("last_event_at")


def stream_sessions(spark, folder):
    """Sessions held as state, cut to their last 20 messages; the rows of the batch in which each came."""
    events = _stream(spark, folder, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("-", "event_type", "event_id").alias("content"))
    held = streams.sessions_with_ttl(events.withWatermark("ts", "1 minute"), minutes=60, keep=20)
    return _drain(held, "append").filter("NOT expired").select("session_id", "n_messages", "last_content")


def approx_topk(spark, folder):
    c = retrieval._chunks(spark, folder)
    sample = ann.sample_of(c)
    centroids = ann.fit_cells(sample, ann.cells_for(c.count()))
    path = ann.build_index(c, centroids)
    return ann.approximate_top_k(spark, path, centroids, retrieval._queries(c), retrieval.K, ann.probes_for(sample, centroids, retrieval.K))


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_event_types, stream_current_feedback, stream_sessions, approx_topk)}
SQL = {
    "stream_current_feedback": retrieval.SQL["feedback_current"],
    "stream_sessions": "SELECT CAST(user_id AS VARCHAR) AS session_id, least(count(*), 20) AS n_messages, arg_max(event_type || '-' || event_id, ts) AS last_content FROM events GROUP BY user_id",
    "stream_event_windows": retrieval.SQL["event_windows"],
    "stream_event_types": "SELECT event_type, count(*) AS n, arg_max(event_id, ts) AS last_event FROM events GROUP BY event_type",
}
