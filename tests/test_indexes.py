"""Saved indexes: the block index against the plain one, the vector index against exact search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import docengine.registry as registry
from docengine.operators import block_index, fusion, lexical, vector_index, vectors
from docengine.sources.files import saved


def zipf_docs(spark, seed, n, words):
    r = random.Random(seed)
    rows = [(i, " ".join(f"w{min(int(r.paretovariate(0.7)), words)}" for _ in range(r.randint(0, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.mark.parametrize("words", [12, 400])
def test_blocks_give_the_plain_rows(spark, tmp_path, words):
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    docs = zipf_docs(spark, words, 1500, words)
    queries = zipf_docs(spark, 99, 30, words).select(F.col("id").alias("query_id"), F.expr("array_join(slice(split(text, ' '), 1, 4), ' ')").alias("text"))
    terms = lexical.query_terms(queries, "query_id", tokens)
    block_index.build(docs, f"file://{tmp_path}/index", "id", tokens)
    index = block_index.load(spark, f"file://{tmp_path}/index")
    assert index.blocks.agg(F.max("n")).first()[0] <= block_index.RANGE
    for k in (1, 7):
        rows = lambda df, k=k: sorted(map(tuple, fusion.top(df.withColumn("score", F.round("score", 6)), k).collect()))
        assert rows(block_index.search(index, terms, k)) == rows(lexical.search(lexical.build(docs, "id", tokens), terms))
    read = block_index.postings_read(index, terms, 1).agg(F.sum("read"), F.sum("total")).first()
    assert read[0] <= read[1] and (words == 12 or read[0] < 0.8 * read[1])


def test_block_index_of_nothing(spark, tmp_path):
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda t: t != "")
    for name, rows in (("none", []), ("blank", [(1, ""), (2, None)])):
        block_index.build(spark.createDataFrame(rows, "id long, text string"), f"file://{tmp_path}/{name}", "id", tokens)
        index = block_index.load(spark, f"file://{tmp_path}/{name}")
        terms = spark.createDataFrame([(1, "a", 1)], "query_id long, term string, mult long")
        assert block_index.search(index, terms, 3).count() == 0


def test_postings_skipped(spark, sf):
    read = registry.QUERIES["i10_block_postings"](spark, sf).agg(F.sum("read"), F.sum("total")).first()
    assert 0 < read[0] <= read[1]


def test_saved_once_for_the_same_files(spark, tmp_path):
    source, built = f"file://{tmp_path}/t.parquet", []

    def build(path):
        built.append(path)
        spark.range(3).write.parquet(path)

    spark.range(5).write.parquet(source)
    paths = [saved(spark, source, "once", build) for _ in range(2)]
    assert len(built) == 1 and paths[0] == paths[1] and spark.read.parquet(paths[0]).count() == 3
    spark.range(6).write.mode("append").parquet(source)
    assert saved(spark, source, "once", build) != paths[0] and len(built) == 2


def clustered(spark, seed, n=3000, width=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, width)) * 3
    rows = [(i, [float(x) for x in (centres[i % 40] + r.normal(size=width)).astype(np.float32)]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, [0.0] * width), (n + 2, [float("nan")] * width)], "id long, embedding array<float>")


def test_vector_recall(spark, sf):
    row = registry.QUERIES["i7_vector_recall"](spark, sf).first()
    assert row.recall >= 0.9 and row.probed < row.lists


def test_vector_index_reads_probed_lists_only(spark, tmp_path):
    rows = clustered(spark, 3)
    index = vector_index.build(rows, f"file://{tmp_path}/index")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    probe = vector_index.tune(index, recall=0.98)
    assert index.rows.count() == 3000 and probe < index.lists / 3
    found = vector_index.search(index, asked, 10, probe)
    exact = vectors.nearest(rows.filter("id < 3000"), asked, 10)
    assert vector_index.recall_of(found, exact).first().recall >= 0.9
    one = asked.filter("query_id = 20")
    (wanted,) = vector_index.probed(index, np.array([one.first().embedding], np.float32), 2)
    plan = vector_index.search(index, one, 10, 2)._jdf.queryExecution().toString()
    lists = np.flatnonzero(wanted).tolist()
    assert len(lists) == 2 and f"PartitionFilters: [list#" in plan and f"IN ({lists[0]},{lists[1]})" in plan
    same = vector_index.load(spark, f"file://{tmp_path}/index")
    assert sorted(map(tuple, vector_index.search(same, one, 3, probe).collect())) == sorted(map(tuple, vector_index.search(index, one, 3, probe).collect()))


def test_vector_index_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, [])], "id long, embedding array<float>")
    index = vector_index.build(rows, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    assert index.lists == 0 and vector_index.search(index, asked, 3, 2).count() == 0
