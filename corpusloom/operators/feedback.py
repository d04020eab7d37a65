"""Feedback events and chat histories (D7 -> D8, AGG-12..14, PRJ-15, PRJ-16, WIN-06..08, SNK-11, FLT-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import strip

#: What events may say.
KINDS = ["thumbs", "star", "comment", "clear"]
CATEGORIES = ["relevance", "clarity", "completeness", "accuracy", "overall"]


def valid_event() -> Column:
    """Whether an event's fields agree with its kind (FLT-15); null fields of other kinds are fine."""
    return F.coalesce(
        F.col("kind").isin(KINDS)
        & ((F.col("kind") != "thumbs") | F.col("thumbs").isin("up", "down"))
        & ((F.col("kind") != "star") | (F.col("star_category").isin(CATEGORIES) & F.coalesce(F.col("star_value").between(0, 5), F.lit(True)))),
        F.lit(False),
    )


def current_feedback(events: DataFrame) -> DataFrame:
    """One row per session and message with the last of each kind (D8): a single aggregate of arg-max's by event id.

    A star of null clears its category; an empty comment doesn't clear a comment; thumbs can't be cleared (T-34, T-35).
    """
    last = lambda value, when: F.max(F.when(when, F.struct(F.col("event_id"), value.alias("v"))))["v"]
    kind = F.col("kind")
    stars = [last(F.col("star_value"), (kind == "star") & (F.col("star_category") == c)).alias(f"rating_{c}") for c in CATEGORIES]
    return events.groupBy("session_id", "message_id").agg(
        last(F.col("thumbs"), kind == "thumbs").alias("last_thumbs"),
        *stars,
        last(F.col("comment"), (kind == "comment") & (F.col("comment") != "")).alias("last_comment"),
        F.max("event_id").alias("last_event_id"),
        F.max("created_at").alias("last_event_at"),
    )


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each session (WIN-07, WIN-08)."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def previous_question(messages: DataFrame, block: int = 100_000) -> DataFrame:
    """Each message with the last user message before it (PRJ-15, WIN-06).

    Looked for within blocks of turns first, then carried from block to block, so that a session of any length is
    spread over many tasks.
    """
    m = messages.withColumn("_b", F.floor(F.col("turn") / block))
    asked = F.when(F.col("role") == "user", F.col("content"))
    before = Window.partitionBy("session_id", "_b").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = m.withColumn("_near", F.last(asked, ignorenulls=True).over(before))
    ends = m.groupBy("session_id", "_b").agg(F.max_by("content", F.when(asked.isNotNull(), F.col("turn"))).alias("_end"))
    earlier = Window.partitionBy("session_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("session_id", "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_far"))
    joined = near.join(carried, ["session_id", "_b"], "left")
    return joined.select(*messages.columns, F.coalesce("_near", "_far").alias("question"))


def chat_title(messages: DataFrame, most: int = 50) -> DataFrame:
    """First user message that isn't blank, on one line, cut at a word (PRJ-16, SNK-19)."""
    asked = messages.filter((F.col("role") == "user") & (strip(F.col("content")) != ""))
    first = asked.groupBy("session_id").agg(F.min_by(strip(F.translate("content", "\n", " ")), "turn").alias("t"))
    cut = F.regexp_replace(F.substring("t", 1, most), r" [^ ]*$", "")
    return first.select("session_id", F.when(F.length("t") <= most, F.col("t")).otherwise(F.concat(cut, F.lit("..."))).alias("title"))


def unnest_history(sessions: DataFrame) -> DataFrame:
    """Messages of nested session documents, one row each, with their turn (SRC-11)."""
    rows = sessions.select("session_id", F.posexplode("messages").alias("turn", "m"))
    return rows.select("session_id", "turn", "m.*")


def star_events(messages: DataFrame) -> DataFrame:
    """Ratings maps as star events; messages without a time are left out (SRC-11, SNK-12, MSC-25)."""
    rows = messages.filter(F.col("timestamp").isNotNull()).select("session_id", "message_id", "timestamp", F.explode("ratings").alias("star_category", "star_value"))
    return rows.select("session_id", "message_id", F.lit("star").alias("kind"), "star_category", "star_value", F.col("timestamp").alias("created_at"))
