"""Filtered top-k search over chunks: dense, sparse and fused (SCH-01..15, FLT-01..08, JON-07, AGG-26, AGG-27).

Queries are compared with the chunks in blocks of bounded size: each partition scores its chunks against a block of queries and
keeps the k best of each query, so only k rows per query and batch are shuffled. The queries are packed into blocks by the
executors; the driver holds one block at a time, and with several blocks the result of each is written before the next
is read. Ties are ordered by id. Chunks with a null vector or text, and queries with none, match nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.store import with_lookup
from corpusloom.runtime import all_of, materialize, scratch_path

#: Queries scored at once, which bounds the broadcast.
QUERY_BLOCK = 4096
#: Pairs of a batch's rows and queries from which a term is scored in a matrix, and terms of one matrix.
DENSE_PAIRS, DENSE_TERMS = 2000, 1024
K1, B, AVERAGE_LENGTH = 1.2, 0.75, 256.0
#: Fields that filters may name, and those that are instants.
FIELDS = ("status", "is_latest", "effective_date", "expiry_date", "version_year", "canonical_id", "regulation_id", "article_number", "type", "authority", "number", "label")
DATE_FIELDS = ("effective_date", "expiry_date")


# ---- filters and sorts


@dataclass(frozen=True)
class Condition:
    """``field operator value``; operators: eq, neq, in, gt, gte, lt, lte, range (a dict of the four)."""

    field: str
    operator: str
    value: object


def predicate(conditions: list[Condition], strict: bool = True) -> Column | None:
    """Conjunction of the conditions on known fields, or None (FLT-02..04).

    ``strict=False`` drops ``in`` and ``neq``, as an engine does whose filters match one value only (T-08).
    """
    out = []
    for c in conditions:
        if c.field not in FIELDS:
            continue
        x = F.try_to_timestamp(F.col(c.field)) if c.field in DATE_FIELDS else F.col(c.field)
        lit = (lambda v: F.try_to_timestamp(F.lit(v))) if c.field in DATE_FIELDS else F.lit
        ops: dict[str, Callable[[object], Column]] = {"gt": lambda v: x > lit(v), "gte": lambda v: x >= lit(v), "lt": lambda v: x < lit(v), "lte": lambda v: x <= lit(v), "eq": lambda v: x == lit(v)}
        if c.operator in ops:
            out.append(ops[c.operator](c.value))
        elif c.operator == "range" and isinstance(c.value, dict):
            out += [ops[k](v) for k, v in c.value.items() if k in ("gt", "gte", "lt", "lte")]
        elif strict and c.operator == "in":
            out.append(x.isin([v for v in c.value]) if c.field not in DATE_FIELDS else F.array_contains(F.array(*(lit(v) for v in c.value)), x))
        elif strict and c.operator == "neq":
            out.append(~x.eqNullSafe(lit(c.value)))
    return all_of(out) if out else None


def current(df: DataFrame) -> DataFrame:
    """Chunks in force: active and latest (FLT-01)."""
    return df.filter((F.col("status") == "active") & (F.col("is_latest") == 1))


def valid_on(df: DataFrame, day: str) -> DataFrame:
    """Chunks valid on a day, whatever their version (FLT-05, SCH-07)."""
    return df.filter((F.col("status") == "active") & (F.col("effective_date") <= day) & ((F.col("expiry_date") >= day) | F.col("expiry_date").isNull()))


def sort_hits(df: DataFrame, sorts: list[tuple[str, str]], seq: str = "seq") -> DataFrame:
    """Hits by several fields, each ``asc`` or ``desc``; null and empty sort as the empty text; then by ``seq`` (SRT-01)."""
    keys = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f, _ in sorts]
    return df.orderBy(*(k.desc() if d == "desc" else k.asc() for k, (_, d) in zip(keys, sorts)), seq)


# ---- scoring in blocks


def _top_k(scored: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*(order or [F.desc("score"), F.asc("id")]))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _packed(queries: DataFrame, what: str) -> DataFrame:
    """One row ``(names, items)`` per block of at most ``QUERY_BLOCK`` queries, packed where they are."""
    rows = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.expr(what).alias("item")).dropna().groupBy("query_id").agg(F.max("item").alias("item"))
    kind = rows.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, QUERY_BLOCK):
                names, items = (c.slice(i, QUERY_BLOCK) for c in b.columns)
                at = pa.array([0, len(names)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, names), pa.ListArray.from_arrays(at, items)], names=["names", "items"])

    return materialize(rows.mapInArrow(run, f"names array<bigint>, items array<{kind}>").withColumn("block", F.monotonically_increasing_id()), "queries")


def _by_block(queries: DataFrame, what: str, score: Callable[[object], DataFrame], k: int) -> DataFrame:
    """The k best of each query over its block's ``score``; that gets one block's row."""
    packed = _packed(queries, what)
    spark = queries.sparkSession
    # one number a block
    numbers = sorted(r[0] for r in packed.select("block").collect())
    if not numbers:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    if len(numbers) == 1:
        return _top_k(score(packed.first()), k)
    path = scratch_path(spark, "blocks")
    for n in numbers:
        _top_k(score(packed.filter(F.col("block") == n).first()), k).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _best_of_batch(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the k best of each query in a batch; all ties with the k-th stay, so ids can break them later."""
    if scores.shape[0] > k:
        kth = np.partition(scores, scores.shape[0] - k, axis=0)[scores.shape[0] - k]
        keep = scores >= kth
    else:
        keep = np.ones(scores.shape, bool)
    if floor is not None:
        keep &= scores >= floor
    r, q = np.nonzero(keep)
    return queries[q], ids[r], scores[r, q]


def dense_top_k(chunks: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """``(query_id, id, score, rank)``: the k chunks of highest cosine with each query, both unit vectors (SCH-01, SCH-20, SCH-21).

    ``chunks`` has ``id`` and a vector, ``queries`` has ``query_id`` and one. Scores are computed in double precision and
    rounded to ``digits``, so ties are the same on every engine. A threshold applies before the choice of the k best.
    """

    def score(block) -> DataFrame:
        shared = chunks.sparkSession.sparkContext.broadcast((np.array(block["names"], np.int64), np.array(block["items"], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                if not len(ids):
                    continue
                values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                # in slices, so that the score matrix stays small
                for i in range(0, len(ids), 2048):
                    scores = np.round(values[i : i + 2048] @ matrix.T, digits)
                    yield _hits(*_best_of_batch(scores, ids[i : i + 2048], names, k, threshold))

        return chunks.select(F.col("id").cast("bigint").alias("id"), vector).filter(F.col(vector).isNotNull()).mapInArrow(run, "query_id bigint, id bigint, score double")

    return _by_block(queries, vector, score, k)


def _hits(q: np.ndarray, x: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])


def _scored_terms(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, names: np.ndarray, lists: dict, ids: np.ndarray, k: int, digits: int) -> pa.RecordBatch:
    """The k best of each query over a batch of postings ``(row, term, weight)``, term by term."""
    scores = np.zeros((n, names.size))
    order = np.argsort(terms, kind="stable")
    rows, terms, weights = rows[order], terms[order], weights[order]
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if terms.size else np.zeros(0, np.int64)
    spans = [(a, z, *lists[terms[a]]) for a, z in zip(starts.tolist(), [*starts[1:].tolist(), terms.size])]
    # terms with many pairs as a product of matrices, the others by their pairs
    many = [x for x in spans if (x[1] - x[0]) * x[2].size > DENSE_PAIRS]
    for i in range(0, len(many), DENSE_TERMS):
        part = many[i : i + DENSE_TERMS]
        left, right = np.zeros((n, len(part))), np.zeros((len(part), names.size))
        for j, (a, z, q, w) in enumerate(part):
            left[rows[a:z], j], right[j, q] = weights[a:z], w
        scores += left @ right
    for a, z, q, w in spans:
        if (z - a) * q.size <= DENSE_PAIRS:
            # a row has a term once
            scores[np.ix_(rows[a:z], q)] += np.outer(weights[a:z], w)
    return _hits(*_best_of_batch(np.round(scores, digits), ids, names, k, 10**-digits))


def tokens(text: Column) -> Column:
    """The words of a text in lower case: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def term_weights(words: list[str]) -> dict[str, float]:
    """Saturated term frequencies of a text's words (SCH-04)."""
    counts = Counter(words)
    return {t: float(saturated(n, len(words))) for t, n in counts.items()}


def saturated(n, length):
    return n * (K1 + 1) / (n + K1 * (1 - B + B * length / AVERAGE_LENGTH))


def _postings(items: list[dict[object, float]]) -> dict[object, tuple[np.ndarray, np.ndarray]]:
    found: dict = defaultdict(lambda: ([], []))
    for i, weights in enumerate(items):
        for t, w in weights.items():
            q, own = found[t]
            q.append(i)
            own.append(w)
    return {t: (np.array(q), np.array(w, np.float64)) for t, (q, w) in found.items()}


def _weighted_top_k(chunks: DataFrame, queries: DataFrame, k: int, what: str, weigh: Callable[[list], dict], batch_weights: Callable, digits: int) -> DataFrame:
    """Top k by the product of weights of common terms. ``what`` gives a row's terms on either side, ``weigh`` the weights of a
    query's; ``batch_weights`` makes ``(rows, terms, weights)`` of a batch's, terms by their place in a list."""

    def score(block) -> DataFrame:
        shared = chunks.sparkSession.sparkContext.broadcast((np.array(block["names"], np.int64), _postings([weigh(x) for x in block["items"]])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, lists = shared.value
            number, by_number = {t: i for i, t in enumerate(lists)}, list(lists.values())
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    part = b.slice(i, 1024)
                    rows, terms, weights = batch_weights(part.column(1), number)
                    yield _scored_terms(rows, terms, weights, part.num_rows, names, by_number, part.column(0).to_numpy(zero_copy_only=False), k, digits)

        rows = chunks.select(F.col("id").cast("bigint").alias("id"), F.expr(what).alias("item"))
        return rows.filter("item IS NOT NULL").mapInArrow(run, "query_id bigint, id bigint, score double")

    return _by_block(queries, what, score, k)


def _summed(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known terms only, each once per row with the sum of its weights."""
    known = terms >= 0
    keys, place = np.unique(rows[known] * size + terms[known], return_inverse=True)
    return keys // size, keys % size, np.bincount(place, weights=weights[known], minlength=keys.size)


def _word_batch(lists: pa.ListArray, number: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths, words = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()
    codes = np.array([number.get(t, -1) for t in words.dictionary.to_pylist()], np.int64)
    terms = codes[words.indices.to_numpy(zero_copy_only=False)] if codes.size else np.zeros(0, np.int64)
    rows, terms, n = _summed(np.repeat(np.arange(len(lists)), lengths), terms, np.ones(terms.size), max(1, len(number)))
    return rows, terms, saturated(n, lengths[rows])


def _vector_batch(lists: pa.ListArray, number: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths, flat = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
    ids, places = np.unique(flat.field("term").to_numpy(zero_copy_only=False), return_inverse=True)
    codes = np.array([number.get(t, -1) for t in ids.tolist()], np.int64)
    terms = codes[places] if codes.size else np.zeros(0, np.int64)
    return _summed(np.repeat(np.arange(len(lists)), lengths), terms, flat.field("weight").to_numpy(zero_copy_only=False), max(1, len(number)))


def sparse_top_k(chunks: DataFrame, queries: DataFrame, k: int, text: str = "text", digits: int = 6) -> DataFrame:
    """``(query_id, id, score, rank)``: the k texts of highest product of term weights with each query (SCH-03, SCH-04).

    Terms are runs of letters, digits and underscores in lower case. Queries are encoded like texts. Texts without a common term
    don't match.
    """
    split = lambda df, key: df.select(key, tokens(F.col(text)).alias("_words"))
    return _weighted_top_k(split(chunks, "id"), split(queries, "query_id"), k, "_words", term_weights, _word_batch, digits)


def sparse_vector_top_k(chunks: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Top k by the product of stored sparse vectors (``indices``, ``values``), by the postings of a block of queries (SCH-03).

    An index that a vector has twice counts with the sum of its values.
    """

    def weigh(items: list) -> dict:
        out: dict = defaultdict(float)
        for p in items:
            out[p["term"]] += p["weight"]
        return out

    what = "transform(arrays_zip(indices, values), p -> named_struct('term', p.indices, 'weight', CAST(p.values AS DOUBLE)))"
    return _weighted_top_k(chunks, queries, k, what, weigh, _vector_batch, digits)


def fuse(branches: list[DataFrame], k: int, constant: int = 2, digits: int = 6) -> DataFrame:
    """Reciprocal rank fusion: the sum of ``1 / (constant + rank)``, ranks from 0, over the branches (SCH-05, T-22)."""
    parts = [b.select("query_id", "id", (1.0 / (constant + F.col("rank") - 1)).alias("part"), F.when(F.lit(i == 0), F.col("rank")).alias("first")) for i, b in enumerate(branches)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum("part"), digits).alias("score"), F.min("first").alias("first"))
    return _top_k(fused, k, [F.desc("score"), F.asc_nulls_last("first"), F.asc("id")]).drop("first")


@dataclass
class SearchPlan:
    """A search over several queries, compiled into one job (SCH-06, SCH-08)."""

    k: int = 5
    mode: str = "hybrid"  # dense, sparse or hybrid
    conditions: list[Condition] = field(default_factory=list)
    day: str | None = None
    threshold: float | None = None
    prefetch: int = 3
    constant: int = 2

    def run(self, chunks: DataFrame, queries: DataFrame) -> DataFrame:
        """Filters before ranking (T-21); with a day, only validity filters (T-07). Missing vectors leave the other branch."""
        if self.day is not None:
            chunks = valid_on(chunks, self.day)
        elif (p := predicate(self.conditions)) is not None:
            chunks = chunks.filter(p)
        dense = self.mode in ("dense", "hybrid") and "embedding" in chunks.columns and "embedding" in queries.columns
        sparse = self.mode in ("sparse", "hybrid") and "indices" in chunks.columns and "indices" in queries.columns
        if not dense and not sparse:
            raise ValueError(f"no vectors for a {self.mode} search")
        if dense and sparse:
            n = self.k * self.prefetch
            return fuse([dense_top_k(chunks, queries, n), sparse_vector_top_k(chunks, queries, n)], self.k, self.constant)
        return dense_top_k(chunks, queries, self.k, self.threshold) if dense else sparse_vector_top_k(chunks, queries, self.k)


# ---- what follows a search


def dedup_key(regulation_id: Column, text: Column) -> Column:
    return F.concat_ws(":", regulation_id, F.substring(text, 1, 100))


def dedup_hits(hits: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    """The best-scored hit of each key, in the order in which the keys were first seen (AGG-27, SCH-10, T-28)."""
    columns = hits.columns
    rest = [c for c in columns if c not in ("score", seq)]
    best = hits.withColumn("_k", key).groupBy("_k").agg(F.max(F.struct("score", (-F.col(seq)).alias("_o"), *rest)).alias("b"), F.min(seq).alias("_first"))
    return best.select(*(F.col("_first").alias(seq) if c == seq else F.col(f"b.{c}").alias(c) for c in columns))


def widened(hits: DataFrame, limit: int, sorts: list[tuple[str, str]], n_queries: int, seq: str = "seq") -> DataFrame:
    """Hits of a widened fetch, deduplicated before, in the order of the sort, cut to ``limit`` per query in all (SCH-09)."""
    return sort_hits(hits, sorts, seq).limit(limit * n_queries)


def enrich(hits: DataFrame, documents: DataFrame, fields: list[str]) -> DataFrame:
    """Missing fields from the document's row, if that has a URL (SCH-11, JON-07, T-37)."""
    rows = documents.filter(F.length("url") > 0).groupBy("doc_id").agg(F.min(F.struct(*fields)).alias("_d"))
    joined = with_lookup(hits, rows, "doc_id")
    return joined.withColumns({f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_d.{f}")) for f in fields}).drop("_d")


def relevance(logit: Column) -> Column:
    """Percentage of a reranker's logit (FN-43)."""
    return 100 / (1 + F.exp(-logit))


def rerank(hits: DataFrame, logit: Column, threshold: float, digits: int = 2) -> DataFrame:
    """Hits whose relevance reaches the threshold (before rounding), with it as ``relevance`` (SCH-12, T-23)."""
    return hits.withColumn("_r", relevance(logit)).filter(F.col("_r") >= threshold).withColumn("relevance", F.round("_r", digits)).drop("_r")


def best_query(scored: DataFrame) -> DataFrame:
    """Each document with the query that scores it best; ties go to the earlier query; scores of 0 don't count (AGG-26, SCH-13)."""
    best = scored.filter("score > 0").groupBy("id").agg(F.max(F.struct("score", (-F.col("query_id")).alias("_q"))).alias("b"))
    return best.select("id", (-F.col("b._q")).alias("query_id"), F.col("b.score").alias("score"))


def context(hits: DataFrame, k: int = 7, chars: int = 2000) -> DataFrame:
    """The k most relevant hits with their text cut (SCH-15)."""
    return hits.orderBy(F.desc("relevance"), "id").limit(k).withColumn("text", F.substring("text", 1, chars))
