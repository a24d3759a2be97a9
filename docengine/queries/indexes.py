"""Saved indexes: postings in blocks with bounds, and inverted lists of vectors. Built once for the same files, then read."""

from pyspark.sql import functions as F

from docengine.functions import text as X
from docengine.operators import block_index, fusion, lexical, vector_index, vectors
from docengine.plans import retrieve as R
from docengine.queries.search import _hybrid_inputs
from docengine.registry import ORACLES, query, table
from docengine.sources.files import saved, scratch


def _blocks(spark, sf):
    path = saved(spark, f"{sf}/documents.parquet", "block-index", lambda p: block_index.build(table(spark, sf, "documents"), p, "doc_id", X.tokens(F.col("text"))))
    return block_index.load(spark, path)


def _lists(spark, sf):
    path = saved(spark, f"{sf}/embeddings.parquet", "vector-index", lambda p: vector_index.build(table(spark, sf, "embeddings"), p, "vec_id"))
    return vector_index.load(spark, path)


def _terms(spark, sf):
    return lexical.query_terms(table(spark, sf, "benchmark"), "item_id", R.expanded_tokens(F.col("text")))


@query("i10_block_max", ORACLES["i10_bm25_search_expanded"])
def block_max(spark, sf):
    """The lexical branch over the saved index: blocks that cannot matter are not read."""
    return fusion.top(block_index.search(_blocks(spark, sf), _terms(spark, sf), 10).withColumn("score", F.round("score", 6)), 10)


@query("i10_block_postings")
def block_postings(spark, sf):
    """Postings read and postings there are, of each query."""
    return block_index.postings_read(_blocks(spark, sf), _terms(spark, sf), 10)


@query("k5_block_index", "WITH " + ORACLES["i5_bm25_index"].split("WITH ", 1)[1].rsplit(" SELECT ", 1)[0] + " SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def block_rows(spark, sf):
    """The saved blocks hold every posting once."""
    counted = F.aggregate("posts", F.lit(0).cast("long"), lambda n, p: n + p["tf"])
    return _blocks(spark, sf).blocks.groupBy("term").agg(F.sum(F.size("posts")).alias("df"), F.sum(counted).alias("cf"))


@query("i13_hybrid_indexed", ORACLES["i13_hybrid_expanded"])
def hybrid_indexed(spark, sf):
    return R.hybrid(*_hybrid_inputs(spark, sf), expand=True, index=_blocks(spark, sf))


@query("i24_retrieve_indexed", ORACLES["i24_retrieve_expanded"])
def retrieve_indexed(spark, sf):
    return R.retrieve(*_hybrid_inputs(spark, sf), expand=True, index=_blocks(spark, sf)).drop("content", "title")


@query("k3_vector_index", "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[len(embedding)]::DOUBLE, 6) AS last FROM embeddings")
def vector_rows(spark, sf):
    """Every vector is in the saved index once, as it was."""
    return _lists(spark, sf).rows.select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"))


def _asked(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("i7_vector_index")
def vector_search(spark, sf):
    """The 10 nearest of every vector whose id is divisible by 20, over the lists that tuning asks for."""
    index = _lists(spark, sf)
    return vector_index.search(index, _asked(spark, sf), 10, vector_index.tune(index))


@query("i7_vector_recall")
def vector_recall(spark, sf):
    """queries, hits, wanted, recall against the exact search, and how many of the lists were probed."""
    index = _lists(spark, sf)
    probe = vector_index.tune(index)
    found = vector_index.search(index, _asked(spark, sf), 10, probe)
    exact = vectors.nearest(table(spark, sf, "embeddings"), _asked(spark, sf), 10, id_col="vec_id")
    return vector_index.recall_of(found, exact).withColumn("probed", F.lit(probe)).withColumn("lists", F.lit(index.lists))


# Every list probed and every row re-ranked: the exact search's rows.
@query("i7_vector_index_whole", ORACLES["i7_knn"])
def vector_whole(spark, sf):
    index = vector_index.load(spark, _whole_path(spark, sf))
    asked = table(spark, sf, "benchmark").join(table(spark, sf, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")
    return vector_index.search(index, asked, 10, index.lists, refine=20).withColumn("similarity", F.round("similarity", 6))


def _whole_path(spark, sf):
    path = scratch(spark, "vector-index-whole")
    vector_index.build(table(spark, sf, "embeddings"), path, "vec_id")
    return path
