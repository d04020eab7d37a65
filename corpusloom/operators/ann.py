"""Approximate top-k with an inverted file of cells (SCH-02).

Centroids are fitted on at most ``SAMPLE`` vectors (those with the least hash of their id); every vector is filed under its
nearest centroid, in a table partitioned by cell. A query is scored against the cells whose centroids are nearest only, and
only those partitions are read. The number of cells follows the number of vectors, the number of cells that are probed
the recall measured on the sample. Null vectors are not filed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.search import _best_of_batch, _by_block
from corpusloom.runtime import scratch_path

#: Bound on the vectors that centroids are fitted on, on the cells, and on the queries that recall is measured with.
SAMPLE, MOST_CELLS, TRIALS = 20_000, 4096, 200


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def cells_for(n: int) -> int:
    """Cells of a table of ``n`` vectors: the root of their number, as many texts a cell as cells."""
    return max(1, min(MOST_CELLS, SAMPLE // 4, round(n**0.5)))


def sample_of(chunks: DataFrame, vector: str = "embedding") -> np.ndarray:
    rows = chunks.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(vector).collect()
    return np.array([r[0] for r in rows], np.float64)


def fit_cells(sample: np.ndarray, n_cells: int, rounds: int = 10) -> np.ndarray:
    """Centroids by spherical k-means."""
    centroids = sample[: min(n_cells, len(sample))].copy()
    for _ in range(rounds if len(sample) else 0):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float = 0.95) -> int:
    """The least number of probed cells that finds ``recall`` of the k nearest on the sample. Where vectors have no clusters that
    is most of them; where they have, a few."""
    if not len(sample):
        return 1
    queries = sample[:TRIALS]
    top = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, :k]
    cell = (sample @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(queries @ centroids.T), axis=1), axis=1)
    # how many cells must be probed to meet each of the nearest
    needed = np.sort(np.take_along_axis(place, cell[top], axis=1).ravel()) + 1
    return int(needed[min(needed.size - 1, int(np.ceil(recall * needed.size)) - 1)])


def build_index(chunks: DataFrame, centroids: np.ndarray, path: str | None = None, vector: str = "embedding") -> str:
    """File every vector under its cell; returns the table's path."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = (_matrix(b.column(1), b.num_rows) @ shared.value.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells)], names=["id", "embedding", "cell"])

    path = path or scratch_path(spark, "cells")
    kind = chunks.schema[vector].dataType.simpleString()
    filed = chunks.select(F.col("id").cast("bigint").alias("id"), F.col(vector).alias("embedding")).filter("embedding IS NOT NULL")
    # a hot cell is divided by id among tasks
    spread = filed.mapInArrow(run, f"id bigint, embedding {kind}, cell int").repartition("cell", F.pmod("id", F.lit(4)))
    spread.write.partitionBy("cell").parquet(path)
    return path


def approximate_top_k(spark, path: str, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, digits: int = 6) -> DataFrame:
    """``(query_id, id, score, rank)`` over the ``probes`` nearest cells of each query, by blocks of queries."""
    return _by_block(queries, "embedding", lambda block: _probed(spark, path, centroids, block, k, probes, digits), k)


def _probed(spark, path: str, centroids: np.ndarray, block, k: int, probes: int, digits: int) -> DataFrame:
    names, matrix = np.array(block["names"], np.int64), np.array(block["items"], np.float64)
    nearest = np.argsort(-(matrix @ centroids.T), axis=1)[:, :probes]
    by_cell = {int(c): np.flatnonzero((nearest == c).any(axis=1)) for c in np.unique(nearest)}
    shared = spark.sparkContext.broadcast((names, matrix, by_cell))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, by_cell = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, cells, values = b.column(0).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(1), b.num_rows)
            for c in np.unique(cells):
                q, at = by_cell[int(c)], np.flatnonzero(cells == c)
                for i in range(0, at.size, 2048):
                    part = at[i : i + 2048]
                    out = _best_of_batch(np.round(values[part] @ matrix[q].T, digits), ids[part], names[q], k, None)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "id", "score"])

    table = spark.read.parquet(path).filter(F.col("cell").isin(list(by_cell))).select("id", "embedding", "cell")
    return table.mapInArrow(run, "query_id bigint, id bigint, score double")
