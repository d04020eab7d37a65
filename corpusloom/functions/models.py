"""Models as interfaces: a caller gives a loader, called once per task, whose function works on batches (SCH-19, SCH-20, SCH-22, MSC-05, JON-14, SRC-13, SRC-15, EXT-03,
EXT-04). A loader travels with its job, so it must be picklable and find its files on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.search import best_query


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


def backend(kind: str, loaders: dict[str, Callable[[], object]], order: tuple[str, ...] = ("local", "remote", "cpu")) -> Callable[[], object]:
    """The loader of a kind; for ``auto`` the first there is in ``order`` (EXT-04)."""
    if kind != "auto":
        return loaders[kind]
    return next(loaders[k] for k in order if k in loaders)


def encode(df: DataFrame, load: Callable[[], Encoder], text: str = "text", batch: int = 512) -> DataFrame:
    """``df`` with the unit vector of each text as ``embedding`` (SCH-20); null texts and zero vectors give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            vectors: list = [None] * len(b)
            at = [i for i, t in enumerate(b[text]) if t is not None]
            for i in range(0, len(at), batch):
                part = at[i : i + batch]
                m = np.asarray(model([b[text].iloc[k] for k in part]), np.float32)
                norms = np.linalg.norm(m, axis=1)
                for k, v, n in zip(part, m, norms):
                    vectors[k] = (v / n).tolist() if n > 0 else None
            yield b.assign(embedding=vectors)

    df = df.drop("embedding")
    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", embedding array<float>")


def score_pairs(pairs: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 64) -> DataFrame:
    """``pairs`` (with ``query`` and ``eval_text``) with a model's ``logit`` (MSC-05)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            rows = list(zip(b["query"], b["eval_text"]))
            yield b.assign(logit=[float(x) for i in range(0, len(rows), batch) for x in model(rows[i : i + batch])])

    pairs = pairs.drop("logit")
    return pairs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", logit double")


def rerank_over_queries(hits: DataFrame, queries: DataFrame, load, relevance: Callable) -> DataFrame:
    """Each hit with the query, of those of its own search, that scores it best (JON-14).

    ``hits``: ``search_id, id, eval_text``; ``queries``: ``search_id, query_id, query``. A join on the search, which has a few
    queries and a pool of hits, not a cross join."""
    scored = score_pairs(hits.join(queries, "search_id"), load)
    return best_query(scored.select(F.concat_ws(":", "search_id", "id").alias("id"), "query_id", relevance(F.col("logit")).alias("score")))


def generate(prompts: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], fallback: str = "") -> DataFrame:
    """``prompts`` (with ``prompt``) with a model's ``response``; a batch that fails gets the fallback (SCH-19)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            try:
                out = list(model(b["prompt"].tolist()))
            except Exception:  # noqa: BLE001 - whatever the model raises, the answer is the fallback
                out = [fallback] * len(b)
            yield b.assign(response=out)

    prompts = prompts.drop("response")
    return prompts.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", response string")
