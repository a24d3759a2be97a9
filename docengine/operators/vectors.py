"""Exact nearest neighbours for batches of queries: numpy blocks of bounded size and a running top k per task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors in one broadcast block, in floats, and its queries; products of one numpy step (queries times rows).
BLOCK_FLOATS, BLOCK_QUERIES, STEP_PRODUCTS = 4_000_000, 4096, 2_000_000


def _distances(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.maximum((rows**2).sum(1)[:, None] + (queries**2).sum(1)[None] - 2 * rows @ queries.T, 0)
    if metric == "cosine":
        norm = lambda x: np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return 1 - (rows / norm(rows)) @ (queries / norm(queries)).T
    if metric == "ip":
        return 1 - rows @ queries.T
    raise ValueError(metric)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector: str = "embedding", only: str | None = None) -> DataFrame:
    """query_id, id, similarity (1 - distance), rank (from 1; ties by id) for queries (query_id, embedding).

    Queries are a stated set, taken in blocks of bounded size; each task keeps k rows per query, so the shuffle
    carries k rows a task and query.  ``only``: a column of both tables; a query with a value there sees
    rows of that value alone (I8).
    """
    spark = corpus.sparkSession
    extra = [only] if only else []
    rows = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), *extra)
    out = None
    for block in _blocks(queries.select("query_id", "embedding", *extra)):
        part = rows.mapInArrow(_top(spark.sparkContext.broadcast(block), k, metric), "query_id long, id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame):
    """(ids, vectors, values of ``only`` or None) of some queries each; those without a vector are left out."""
    ids, rows, only = [], [], []
    pack = lambda: (np.array(ids), np.array(rows, np.float64), np.array(only, object) if only else None)
    for r in queries.toLocalIterator():
        if r[1] is None:
            continue
        ids.append(r[0])
        rows.append(r[1])
        only += r[2:]
        if len(rows) * len(r[1]) >= BLOCK_FLOATS or len(rows) >= BLOCK_QUERIES:
            yield pack()
            ids, rows, only = [], [], []
    if rows:
        yield pack()


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row (ties: least id), unordered."""
    if sims.shape[1] <= k:
        return sims, ids
    least = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k][:, None]
    keep = sims >= least
    for i in np.flatnonzero(keep.sum(axis=1) > k).tolist():  # ties across the rim
        tied = np.flatnonzero(sims[i] == least[i])
        spare = keep[i].sum() - k
        keep[i, tied[np.argsort(ids[i, tied], kind="stable")][len(tied) - spare :]] = False
    return sims[keep].reshape(-1, k), ids[keep].reshape(-1, k)


def _top(shared, k: int, metric: str):
    def run(batches):
        ids, queries, only = shared.value
        best, best_ids = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        step = max(1, STEP_PRODUCTS // len(ids))
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                rows = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                own = part.column(0).to_numpy(zero_copy_only=False)
                sims = np.round(1 - _distances(queries, rows, metric), 9)
                if only is not None:
                    value = np.array(part.column(2).to_pylist(), object)
                    sims[(only[:, None] != value[None]) & np.array([x is not None for x in only])[:, None]] = -np.inf
                sims, near = _best(sims, np.broadcast_to(own[None], sims.shape), k)
                best, best_ids = _best(np.concatenate([best, sims], axis=1), np.concatenate([best_ids, near], axis=1), k)
        q, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(best_ids[q, at], pa.int64()), pa.array(best[q, at], pa.float64())], names=["query_id", "id", "similarity"])

    return run


def zero_vectors(corpus: DataFrame, vector: str = "embedding") -> DataFrame:
    """Audit: rows, zero vectors, distinct dimensions (I4)."""
    return corpus.agg(F.count("*").alias("n"), F.count_if(F.forall(vector, lambda x: x == 0)).alias("zero"), F.count_distinct(F.size(vector)).alias("dimensions"))
