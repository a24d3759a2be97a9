"""An approximate vector index as a table: inverted lists, residual codes, probing, exact re-ranking.

Lists are the cells of a k-means over unit vectors, which Spark trains on a hash sample of about ``SAMPLE`` rows;
every row is indexed.  A row is stored in its list's folder with an int8 code of what its centroid leaves, and
with its vector, which only re-ranking reads.  A search reads the folders of the lists that some query probes, keeps
``refine`` x k candidates a query and task by their codes, and ranks the best of them by their vectors.

What is broadcast is bounded: centroids by ``MOST_LISTS`` and ``CENTROID_FLOATS``, queries by their block.

Rows without a usable vector (null, empty, zero, with a null, NaN or infinite component) are not indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.operators.vectors import _best, _blocks, nearest
from docengine.sources.files import written

#: Rows that k-means and tuning look at, and its rounds.
SAMPLE, ROUNDS, TUNE_QUERIES = 100_000, 8, 200
MOST_LISTS, CENTROID_FLOATS = 1 << 16, 1 << 24
#: Files that a list may be dealt to, so that one list of many rows has several writers and readers.
SPLITS = 8


@dataclass
class VectorIndex:
    rows: DataFrame  # list (a folder each), id, scale, code, embedding
    centroids: np.ndarray  # unit vectors, a row a list

    @property
    def lists(self) -> int:
        return len(self.centroids)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of an Arrow column of lists without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    out = values.reshape(len(column), -1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _nearest_list(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[lo : lo + 4096] @ centroids.T).argmax(1) for lo in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, np.int64)


def k_means(sample: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a written sample (columns key, v). A round sums each list by task, then by list; an empty list keeps its centroid."""
    spark = sample.sparkSession
    start = sample.orderBy("key").limit(lists).select("v").toArrow().column(0).combine_chunks()
    centroids = _matrix(start)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(batches, shared=shared):
            total, n = np.zeros(shared.value.shape, np.float64), np.zeros(len(shared.value), np.int64)
            for batch in batches:
                if batch.num_rows:
                    rows = _matrix(batch.column(0))
                    own = _nearest_list(rows, shared.value)
                    np.add.at(total, own, rows)
                    n += np.bincount(own, minlength=len(n))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["list", "total"])

        parts = sample.select("v").mapInArrow(sums, "list int, total array<double>")
        found = parts.select("list", F.posexplode("total").alias("i", "x")).groupBy("list", "i").agg(F.sum("x").alias("x")).groupBy("list").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("t")).select("list", F.col("t.x").alias("x")).toArrow()
        total = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, centroids.shape[1]))
        length = np.linalg.norm(total, axis=1, keepdims=True)
        good = length[:, 0] > 0
        centroids = centroids.copy()
        centroids[found.column("list").to_numpy()[good]] = (total / np.maximum(length, 1e-30))[good]
        shared.unpersist()
    return centroids


def build(corpus: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", lists: int | None = None) -> VectorIndex:
    """Train, encode every row and save under ``path``; a list is a folder of at most SPLITS files a write task."""
    spark = corpus.sparkSession
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter(usable(F.col("v")))
    n = rows.count()
    lists = lists or int(min(MOST_LISTS, max(1, n**0.5)))
    if lists > MOST_LISTS:
        raise ValueError(f"{lists} lists, at most {MOST_LISTS}")
    share = min(1.0, max(SAMPLE, 4 * lists) / max(n, 1))
    sample = written(rows.withColumn("key", F.xxhash64("id", F.lit(7))).filter((F.col("key").bitwiseAND((1 << 40) - 1)) < int(share * (1 << 40))), "vector-sample")
    if n:
        centroids = k_means(sample, lists)
        if centroids.size > CENTROID_FLOATS:
            raise ValueError(f"{centroids.size} floats of centroids, at most {CENTROID_FLOATS}: take fewer lists")
    else:
        centroids = np.zeros((0, 1), np.float32)
    shared = spark.sparkContext.broadcast(centroids)

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(1))
            own = _nearest_list(unit, shared.value)
            left = unit - shared.value[own]
            scale = np.maximum(np.abs(left).max(axis=1), 1e-30) / 127
            code = np.rint(left / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), pa.array(scale, pa.float32()), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1)], names=["list", "id", "scale", "code", "embedding"])

    kind = rows.schema["v"].dataType.simpleString()
    coded = rows.mapInArrow(encode, f"list int, id long, scale float, code binary, embedding {kind}")
    dealt = coded.repartition("list", F.pmod(F.xxhash64("id"), F.lit(SPLITS))).sortWithinPartitions("list", "id")
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<float>").write.mode("overwrite").parquet(f"{path}/centroids")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    found = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow().column("centroid").combine_chunks()
    # Never by the folders' names alone: an index without rows has none.
    rows = spark.read.schema("list int, id long, scale float, code binary, embedding array<float>").parquet(f"{path}/rows")
    return VectorIndex(rows, found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1) if len(found) else np.zeros((0, 1), np.float32))


def probed(index: VectorIndex, vectors: np.ndarray, probe: int) -> np.ndarray:
    """For each query and list: whether the list is one of the ``probe`` nearest."""
    near = vectors @ index.centroids.T
    out = np.zeros(near.shape, bool)
    probe = min(probe, near.shape[1])
    np.put_along_axis(out, np.argpartition(-near, probe - 1, axis=1)[:, :probe], True, axis=1)
    return out


def _scan(shared, keep: int):
    """Of the rows of probed lists: the ``keep`` best of each query and task, by code."""

    def run(batches):
        ids, queries, wanted, centroids = shared.value
        best, best_ids = np.zeros((len(ids), 0), np.float32), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            lists, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            scale = batch.column(2).to_numpy()
            step = max(1, 2_000_000 // len(ids))
            for lo in range(0, batch.num_rows, step):
                cut = slice(lo, min(lo + step, batch.num_rows))
                code = np.frombuffer(b"".join(batch.column(3).slice(lo, cut.stop - lo).to_pylist()), np.int8).reshape(cut.stop - lo, -1)
                rows = centroids[lists[cut]] + code * scale[cut, None]
                near = np.where(wanted[:, lists[cut]], queries @ rows.T, -np.inf).astype(np.float32)
                near, at = _best(near, np.broadcast_to(own[None, cut], near.shape), keep)
                best, best_ids = _best(np.concatenate([best, near], axis=1), np.concatenate([best_ids, at], axis=1), keep)
        q, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(best_ids[q, at], pa.int64()), pa.array(best[q, at].astype(np.float64))], names=["query_id", "id", "near"])

    return run


def exact_cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(index: VectorIndex, queries: DataFrame, k: int, probe: int, refine: int = 8) -> DataFrame:
    """query_id, id, similarity, rank of the best candidates of the probed lists, for queries (query_id, embedding).

    Queries are a stated set, taken in blocks; a block reads the folders of the lists it probes and no other.
    """
    spark, out = queries.sparkSession, None
    good = queries.select("query_id", "embedding").filter(usable(F.col("embedding")))
    for ids, vectors, _ in _blocks(good):
        if not index.lists:
            break
        unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        wanted = probed(index, unit, probe)
        lists = np.flatnonzero(wanted.any(axis=0)).tolist()
        rows = index.rows.filter(F.col("list").isin(lists))
        shared = spark.sparkContext.broadcast((ids, unit, wanted, index.centroids))
        found = rows.select("list", "id", "scale", "code").mapInArrow(_scan(shared, k * refine), "query_id long, id long, near double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))
        short = found.withColumn("place", place).filter(F.col("place") <= k * refine).select("query_id", "id")
        part = short.join(rows.select("id", "embedding"), "id")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    exact = out.join(good.withColumnRenamed("embedding", "q"), "query_id").select("query_id", "id", F.round(exact_cosine(F.col("embedding"), F.col("q")), 9).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k)


def tune(index: VectorIndex, k: int = 10, recall: float = 0.95, queries: int = TUNE_QUERIES) -> int:
    """The least number of probes that finds ``recall`` of the true neighbours of a hash sample of indexed rows."""
    picked = index.rows.select("id", "embedding").orderBy(F.xxhash64("id", F.lit(11))).limit(queries)
    sample = written(picked.select(F.col("id").alias("query_id"), "embedding"), "vector-queries")
    true = nearest(index.rows.select("id", "embedding"), sample, k).select("query_id", "id").join(index.rows.select("id", "list"), "id").select("query_id", "list").toArrow()
    asked = sample.toArrow()
    order = np.argsort(-(_matrix(asked.column("embedding").combine_chunks()) @ index.centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
    row = {q: i for i, q in enumerate(asked.column("query_id").to_pylist())}
    depth = np.sort([place[row[q], at] for q, at in zip(true.column("query_id").to_pylist(), true.column("list").to_pylist(), strict=True)])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1 if len(depth) else 1


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """queries, hits, wanted, recall of (query_id, id) tables."""
    both = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("hit").alias("hits"), F.count("*").alias("wanted")).withColumn("recall", F.round(F.col("hits") / F.col("wanted"), 4))
