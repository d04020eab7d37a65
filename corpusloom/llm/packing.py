"""Filling containers of fixed capacity, planned over the histogram of lengths instead of over documents.

Lengths (in tokens) are at most the capacity once oversized texts are cut into full parts and a remainder, so their
histogram is bounded by the capacity. Best-fit decreasing runs over its counts: equal containers are planned at once. A
text then takes its slot by its rank among the texts of its length, found without gathering any length in one task.

Tokens are maximal runs of letters, digits and underscores, or maximal runs of other characters that aren't white space
(the public word-and-punctuation tokenizer). Defined results for odd input: null texts and texts without a token take no
slot; repeated ids are items of their own (ties share out the slots of their length); an empty table gives no container.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialize

TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
#: Items of a length that one task numbers.
GROUP = 100_000
#: Ranks of a length that share a key of the join with the plan.
BLOCK = 256


def token_count(text):
    return F.regexp_count(text, F.lit(TOKEN))


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts.

    Returns segments ``(length, first_rank, last_rank, first_container, per_container)`` - the texts of that length with
    ranks from ``first_rank`` (0-based) go to consecutive containers, ``per_container`` to each - and the number of
    containers. Open containers are kept as groups of equal free space; each length goes to the fullest that it fits.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> [(first container, number)]
    free: list[int] = []  # sorted keys of groups
    segments, opened = [], 0

    def put(space: int, first: int, number: int) -> None:
        if not space:
            return
        if not groups[space]:
            bisect.insort(free, space)
        groups[space].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(free, length)
            if k < len(free):
                space = free[k]
                first, number = groups[space].pop()
                if not groups[space]:
                    free.pop(k)
            else:
                space, first = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            each = min(space // length, left)
            full = min(number, left // each)
            segments.append((length, rank, rank + full * each - 1, first, each))
            put(space - each * length, first, full)
            left, rank, first, number = left - full * each, rank + full * each, first + full, number - full
            if number and left and left < each:  # the rest goes into one more container
                segments.append((length, rank, rank + left - 1, first, left))
                put(space - left * length, first, 1)
                left, first, number = 0, first + 1, number - 1
            if number:
                put(space, first, number)
    return segments, opened


def items_of(df: DataFrame, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, part_no, n_parts, token_start, length)``: texts within the capacity whole, others in parts."""
    sized = df.select(F.col(key).alias("key"), token_count(F.col(text)).cast("int").alias("n_tokens")).filter("n_tokens > 0")
    n_parts = F.ceil(F.col("n_tokens") / capacity).cast("int")
    parts = sized.select("key", "n_tokens", n_parts.alias("n_parts"), F.explode(F.sequence(F.lit(1), n_parts)).alias("part_no"))
    start = (F.col("part_no") - 1) * capacity
    return parts.select("key", "n_tokens", "part_no", "n_parts", start.alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - start).alias("length"))


def pack(df: DataFrame, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per item with its ``container_id``: ``key, n_tokens, part_no, n_parts, token_start, length, container_id``."""
    spark = df.sparkSession
    items = materialize(items_of(df, capacity, key, text), "items")
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    segments, _ = plan_containers(histogram, capacity)
    plan = spark.createDataFrame(segments or [(0, 0, -1, 0, 1)], "length int, first_rank long, last_rank long, first_container long, per_container long")
    # rank within length: numbered in slices of about GROUP items, then offset by the sizes of the slices before
    slices = spark.createDataFrame([(k, max(1, -(-n // GROUP))) for k, n in histogram.items()] or [(0, 1)], "length int, slices int")
    sliced = items.join(F.broadcast(slices), "length").withColumn("slice", F.pmod(F.xxhash64("key", "part_no"), F.col("slices")).cast("int"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = sliced.withColumn("in_slice", F.row_number().over(Window.partitionBy("length", "slice").orderBy("key", "part_no")) - 1)
    ranked = numbered.join(offsets, ["length", "slice"]).withColumn("rank", F.col("in_slice") + F.col("offset"))
    # an equality join on blocks of ranks, so that neither a hot length nor a long plan makes a task large
    blocks = plan.withColumn("block", F.explode(F.sequence((F.col("first_rank") / BLOCK).cast("long"), (F.col("last_rank") / BLOCK).cast("long"))))
    slot = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") <= F.col("last_rank"))
    planned = ranked.withColumn("block", (F.col("rank") / BLOCK).cast("long")).join(blocks, ["length", "block"]).filter(slot)
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per_container"))
    return planned.select(F.col("key").alias(key), "n_tokens", "part_no", "n_parts", "token_start", "length", container.cast("long").alias("container_id"))


def containers(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """Number of items, filled tokens and unused space of each container."""
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("length").cast("long").alias("filled"), (F.lit(capacity) - F.sum("length")).cast("long").alias("unused"))
