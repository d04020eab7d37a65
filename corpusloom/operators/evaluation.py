"""Metrics of retrieval and of answers (AGG-17..25, JON-12, FN-20, FN-41, FN-42, FN-45), per query and over queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gains, and the phrases of answers that say nothing or hedge.
GAIN = {"relevant": 2.0, "moderate": 1.0}
EMPTY_PHRASES = [
    r"não encontrei",
    r"não há informação",
    r"não consta",
    r"não foi possível encontrar",
    r"não está disponível",
    r"não possuo informação",
    r"informação não está nos documentos",
]
HEDGE_PHRASES = [
    r"possivelmente",
    r"provavelmente",
    r"acredito que",
    r"pode ser que",
    r"é possível que",
    r"talvez",
    r"não tenho certeza",
    r"pelo que sei",
    r"pelo meu conhecimento",
    r"de modo geral",
]
#: How answers cite, in brackets or without.
CITATION = r"\[([A-ZÁÉÍÓÚÂÊÔÃÕÇa-z][A-ZÁÉÍÓÚÂÊÔÃÕÇa-z.]{2,12}\s+[\d./-]+(?:-art\d+(?:-\d+)?)?)\]"
LOOSE_CITATION = (
    r"(?i)((?:ICA|DCA|MCA|PCA|TCA|FCA|OCA|NSCA|RCA|ROCA|RICA|NPA|CIRCEA|BCA|BMA|IMA|RIMA|RMA)"
    r"[- ]?\d+[- ]?\d*(?:-art\d+)?)"
)


def _matches(hit: Column, expected: Column) -> Column:
    """A hit matches an expected id exactly, or any article of an expected document."""
    return (hit == expected) | F.startswith(hit, F.concat(expected, F.lit("-art")))


def graded_hits(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Greedy one-to-one match of ranked hits with expected ids, relevant before moderate ones (JON-12, T-32).

    ``hits``: ``query_id, rank, id``; ``expected``: ``query_id, seq, id, relevance``. One row per query that expects
    anything: ``gains`` by rank (0 for no match), ``ideal`` gains, and counts. The lists of a query are short (k hits, a
    curated set of expected ids), so they are folded within one row.
    """
    want = (
        expected.filter(F.col("relevance").isin(*GAIN)).dropDuplicates(["query_id", "id"])
        .select("query_id", F.struct((F.when(F.col("relevance") == "relevant", 0).otherwise(1)).alias("o"), "seq", "id", F.when(F.col("relevance") == "relevant", 2.0).otherwise(1.0).alias("gain")).alias("e"))
        .groupBy("query_id").agg(F.sort_array(F.collect_list("e")).alias("expected"))
    )
    got = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("hits"))
    joined = want.join(got, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<bigint>" if dict(hits.dtypes)["id"] == "bigint" else "array<string>")))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<double>").alias("gains"))

    def step(acc: Column, hit: Column) -> Column:
        free = F.filter(F.transform("expected", lambda e, i: F.struct(i.alias("i"), e["id"].alias("id"), e["gain"].alias("gain"))), lambda e: _matches(hit.cast("string"), e["id"].cast("string")) & ~F.array_contains(acc["used"], e["i"]))
        first = F.try_element_at(free, F.lit(1))
        used = F.when(first.isNotNull(), F.concat(acc["used"], F.array(first["i"].cast("int")))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["gains"], F.array(F.coalesce(first["gain"], F.lit(0.0)))).alias("gains"))

    gains = F.aggregate("hits", start, step)["gains"]
    return joined.select("query_id", gains.alias("gains"), F.slice(F.transform("expected", lambda e: e["gain"]), 1, k).alias("ideal"), F.size("expected").alias("n_expected"))


def _dcg(gains: Column) -> Column:
    discounted = F.transform(gains, lambda g, i: g / F.log2(i.cast("double") + 2))
    return F.aggregate(discounted, F.lit(0.0), lambda a, b: a + b)


def query_metrics(graded: DataFrame, k: int) -> DataFrame:
    """Hit, precision, recall, reciprocal rank (of relevant ids only) and NDCG of each query (AGG-23..25)."""
    matched = F.size(F.filter("gains", lambda g: g > 0))
    ranks = F.filter(F.transform("gains", lambda g, i: F.when(g >= GAIN["relevant"], i + 1)), lambda r: r.isNotNull())
    return graded.select(
        "query_id",
        (matched > 0).cast("int").alias("hit"),
        (matched / F.lit(float(k))).alias("precision"),
        (matched / F.col("n_expected")).alias("recall"),
        F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(_dcg(F.col("gains")) / F.nullif(_dcg(F.col("ideal")), F.lit(0.0)), F.lit(0.0)).alias("ndcg"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over queries, 0 for no query (AGG-17)."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), mean("hit").alias("hit_rate"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), mean("ndcg").alias("ndcg"))


def upper_median_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at ``n // 2`` of each group's sorted values (AGG-20), from its counts per distinct value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    total = Window.partitionBy(*keys)
    marked = counts.withColumns({"_upto": F.sum("_n").over(w), "_all": F.sum("_n").over(total)})
    return marked.filter((F.col("_upto") > F.floor(F.col("_all") / 2)) & (F.col("_upto") - F.col("_n") <= F.floor(F.col("_all") / 2))).select(*keys, F.col(value).alias("upper_median"))


def citations(response: Column) -> Column:
    """Bracketed citations, else loose ones (FN-41)."""
    strict = F.regexp_extract_all(response, F.lit(CITATION), F.lit(1))
    return F.when(F.size(strict) > 0, strict).otherwise(F.regexp_extract_all(response, F.lit(LOOSE_CITATION), F.lit(1)))


def says_nothing(response: Column) -> Column:
    """Blank answers and those with a phrase of having found nothing (FN-42)."""
    return (F.trim(F.coalesce(response, F.lit(""))) == "") | F.lower(response).rlike("|".join(EMPTY_PHRASES))


def hedges(response: Column) -> Column:
    return F.coalesce(F.lower(response).rlike("|".join(HEDGE_PHRASES)), F.lit(False))


def verdict(text: Column) -> Column:
    """A judge's score: the integer from 0 to 5 in the JSON of its answer, else null (FN-45, SCH-22)."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    score = F.try_variant_get(F.try_parse_json(body), "$.score", "int")
    return F.when(score.between(0, 5) & ~F.coalesce(body.rlike(r'"score"\s*:\s*(?:true|false|")'), F.lit(False)), score)


def response_metrics(responses: DataFrame) -> DataFrame:
    """Rates over answers (``response``, ``sources`` as ids): empty, citing, hedging, and grounded citations over all (AGG-19, AGG-21)."""
    cited = responses.select("response", citations(F.col("response")).alias("c"), "sources")
    own = cited.select("response", "c", F.filter("c", lambda x: F.exists("sources", lambda s: _matches(s, x) | _matches(x, s))).alias("g"))
    rate = lambda b: F.coalesce(F.avg(F.coalesce(b, F.lit(False)).cast("int")), F.lit(0.0))
    return own.agg(
        F.count(F.lit(1)).alias("n_responses"),
        rate(says_nothing(F.col("response"))).alias("empty_rate"),
        rate(F.size("c") > 0).alias("citation_rate"),
        rate(hedges(F.col("response"))).alias("hedging_rate"),
        F.coalesce(F.sum(F.size("g")) / F.nullif(F.sum(F.size("c")), F.lit(0)), F.lit(0.0)).alias("grounding_rate"),
    )
