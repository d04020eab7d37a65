"""Answers of language models as data: JSON in noise, rewritten queries with filters and sorts, rendered sources
(SCH-17, SCH-18, FLT-07, FLT-08, MSC-08, MSC-09, PRJ-14).

The models themselves are the caller's; a text that holds no usable JSON falls back to the original question.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

MAX_QUERY, MIN_QUERY = 500, 3
#: Fields, operators and orders that a rewritten query may have.
REWRITE_FIELDS = ["metadata.type", "metadata.authority", "effective_date", "status"]
OPERATORS = ["eq", "neq", "gt", "gte", "lt", "lte", "in", "range"]


def first_json(text: str | None) -> str | None:
    """The first JSON array or object of a text; null if there is none that is whole."""
    at, decoder = 0, json.JSONDecoder()
    starts = [i for i, c in enumerate(text or "") if c in "[{"]
    for at in starts:
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except ValueError:
            continue
    return None


@pandas_udf(StringType())
def first_json_udf(s: pd.Series) -> pd.Series:
    return s.map(first_json)


def _query_items(raw: str | None, most: int) -> list[dict]:
    """Items of an answer: those of its ``queries``, a single object, or an array; cut to ``most`` before bad ones go."""
    found = first_json(raw)
    data = json.loads(found) if found else []
    if isinstance(data, dict):
        data = data.get("queries", [data])
    return [x for x in data[:most] if isinstance(x, dict) and "text" in x] if isinstance(data, list) else []


REWRITTEN = "query_id string, query_idx int, text string, facet string, filters array<struct<field:string,operator:string,value:string>>, sorts array<struct<field:string,order:string>>"


def rewritten_queries(answers: DataFrame, most: int = 4) -> DataFrame:
    """``(query_id, query_idx, text, facet, filters, sorts)`` of raw answers (``query_id, question, answer``).

    Fields that aren't allowed, empty values and unknown operators or orders go; a text is trimmed, cut and must have three
    characters; of equal texts (whatever their case) the first stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for qid, question, answer in zip(b["query_id"], b["question"], b["answer"]):
                items = _query_items(answer, most)
                rows, seen = [], set()
                for x in items:
                    text = str(x["text"]).strip()
                    if len(text) < MIN_QUERY or (text := text[:MAX_QUERY]).lower() in seen:
                        continue
                    seen.add(text.lower())
                    listed = lambda k, x=x: [f for f in (x.get(k) or []) if isinstance(f, dict)]
                    filters = [{"field": f["field"], "operator": f.get("operator", "eq"), "value": f["value"] if isinstance(f["value"], str) else json.dumps(f["value"])} for f in listed("filters") if f.get("field") in REWRITE_FIELDS and f.get("value") not in (None, "") and f.get("operator", "eq") in OPERATORS]
                    sorts = [{"field": str(f.get("field", "")), "order": f.get("order", "desc")} for f in listed("sorts") if f.get("order", "desc") in ("asc", "desc")]
                    rows.append((text, str(x.get("facet_type", "general")), filters, sorts))
                for i, row in enumerate(rows or [(question, "original", [], [])]):
                    out.append((qid, i, *row))
            yield pd.DataFrame(out, columns=["query_id", "query_idx", "text", "facet", "filters", "sorts"])

    return answers.select("query_id", "question", "answer").mapInPandas(run, REWRITTEN)


def known_values_only(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Filters on type and authority whose value isn't among the registry's most frequent ones go (FLT-07, T-45).

    ``registry`` is ``(field, value)``, a few rows by its definition.
    """
    allowed = registry.agg(F.collect_set(F.concat_ws("=", F.concat(F.lit("metadata."), "field"), "value")).alias("_allowed"))
    joined = queries.join(F.broadcast(allowed))
    free = lambda f: ~f["field"].isin("metadata.type", "metadata.authority") | F.array_contains("_allowed", F.concat_ws("=", f["field"], f["value"]))
    return joined.withColumn("filters", F.filter("filters", free)).drop("_allowed")


def rendered_sources(sources: DataFrame, budget: int = 4000) -> DataFrame:
    """Sources of each query in one text, whole blocks until the budget; the first always, the rest as a count (PRJ-14, WIN-04).

    ``sources``: ``query_id, rank, regulation_id, text``; a query has a few of them, as its top k.
    """
    block = F.concat(F.lit("[Source "), F.col("rank"), F.lit("] "), F.coalesce("regulation_id", F.lit("?")), F.lit("\n"), F.trim(F.coalesce("text", F.lit(""))))
    w = Window.partitionBy("query_id").orderBy("rank")
    sized = sources.withColumn("_b", block).withColumns({"_used": F.sum(F.length("_b")).over(w), "_first": F.row_number().over(w) == 1})
    kept = F.col("_first") | (F.col("_used") <= budget)
    # once a block is left out, all after it are
    open_ = F.min(kept.cast("int")).over(w) == 1
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("_open"), F.struct("rank", "_b")))), lambda x: x["_b"])
    left = F.count_if(~F.col("_open"))
    note = F.when(left > 0, F.concat(F.lit("\n[... "), left, F.lit(" more sources truncated ...]")))
    return sized.withColumn("_open", open_).groupBy("query_id").agg(F.concat_ws("\n\n", parts, note).alias("sources"))
