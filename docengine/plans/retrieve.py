"""Batched retrieval: lexical and vector branches, fused, boosted and joined to context strings."""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as X
from docengine.operators import block_index, fusion, lexical, vectors
from docengine.sources import files


def expanded_tokens(text: Column) -> Column:
    """Terms of an expanded query: its tokens twice, and the distinct tokens and expansions in lower case."""
    once = F.filter(F.transform(X.expand(X.tokens(text), text), F.lower), lambda t: F.length(t) > 1)
    return F.concat(X.tokens(text), X.tokens(text), once)


def hybrid(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, query_vectors: DataFrame, fetch: int = 50, k: int = 30, expand: bool = False, index: lexical.Bm25Index | block_index.BlockIndex | None = None, only: str | None = None) -> DataFrame:
    """query_id, id, rrf_score, rank of the fused branches.

    ``expand``: a query's tokens count twice and once more with its expansions.

    chunks (id, text), embeddings (id, embedding), queries (query_id, text), query_vectors (query_id, embedding).
    ``index``: a saved one, with or without blocks, else it is counted from the texts, of the queries' terms only.  ``only``: a column
    of embeddings and query_vectors that the vector branch has to agree in.
    """
    index = index or lexical.build(chunks, "id", X.tokens(F.col("text")))
    terms = lexical.query_terms(queries, "query_id", expanded_tokens(F.col("text")) if expand else X.tokens(F.col("text")))
    scored = block_index.search(index, terms, fetch) if isinstance(index, block_index.BlockIndex) else lexical.search(index, terms)
    words = fusion.top(scored.withColumn("score", F.round("score", 6)), fetch)
    near = vectors.nearest(embeddings, query_vectors, fetch, only=only)
    fused = fusion.rrf(words, near).withColumn("rrf_score", F.round("rrf_score", 9))
    return fusion.top(fused, k, "rrf_score")


def retrieve(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, query_vectors: DataFrame, fetch: int = 50, fused: int = 30, k: int = 10, threshold: float = 0.0, expand: bool = False, **options) -> DataFrame:
    """query_id, id, score, rank, best_score, low_confidence: the whole retrieval plan.

    Arrays ``keywords`` and ``synonyms`` of the chunks count where there are such columns.
    """
    found = hybrid(chunks, embeddings, queries, query_vectors, fetch, fused, expand, **options)
    q = queries.select("query_id", X.tokens(F.col("text")).alias("base"), (X.expand(X.tokens(F.col("text")), F.col("text")) if expand else F.array_distinct(X.tokens(F.col("text")))).alias("expanded"), X.category_hint(F.col("text")).alias("hint"))
    # The texts of what is found are read where they lie; else all texts would be shuffled.
    few = queries.limit(lexical.BROADCAST_TERMS // fused + 1).count() <= lexical.BROADCAST_TERMS // fused
    found = F.broadcast(found) if few else found
    words = [(F.col(c) if c in chunks.columns else F.array().cast("array<string>")).alias(c) for c in ("keywords", "synonyms")]
    rows = found.join(chunks.select("id", F.col("text").alias("content"), F.col("title"), F.col("category"), *words), "id").join(q, "query_id")
    scored = fusion.boost(rows).withColumn("score", F.round("boosted", 9))
    out = fusion.top(scored, k).withColumn("best_score", F.max("score").over(Window.partitionBy("query_id")))
    return out.select("query_id", "id", "score", "rank", "best_score", (F.col("best_score") < threshold).alias("low_confidence"), "content", "title")


def context(rows: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """query_id, context, sources: contents in rank order and the rounded scores."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "content", "id", F.round("score", 3).alias("score"))))
    got = rows.groupBy("query_id").agg(ordered.alias("r"))
    return got.select(
        "query_id",
        F.array_join(F.transform("r", lambda x: x["content"]), separator).alias("context"),
        F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["id"].cast("string"), x["score"].cast("string"))), ",").alias("sources"),
    )


def retry_simplified(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Queries without any result, cut to their words of more than three characters."""
    empty = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return empty.withColumn("text", F.array_join(F.filter(X.blank_tokens(F.col("text")), lambda t: F.length(t) > 3), " "))


def plan(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, query_vectors: DataFrame, threshold: float = 0.0, **options) -> tuple[DataFrame, DataFrame]:
    """(rows as of ``retrieve``; query_id, error, best_score, low_confidence of every query): the whole of I24.

    queries (query_id, text, filter_source).  A refused text, or a filter that is unsafe or names no source of
    the chunks, is an error and finds nothing.  A filter binds the vector branch, as in the rule set reproduced.
    Queries are expanded; one that finds nothing is asked again with its longer words (I25).
    """
    known = chunks.filter("source is not null").select(F.col("source").alias("_known")).distinct()
    q = queries.select("query_id", X.clean_query(F.col("text")).alias("text"), X.query_error(F.col("text")).alias("error"), F.nullif(X.strip(F.col("filter_source")), F.lit("")).alias("raw"))
    q = q.withColumn("source", X.source_filter(F.col("raw"))).join(known, F.col("source") == F.col("_known"), "left")
    q = q.withColumn("error", F.coalesce("error", F.when(F.col("raw").isNotNull() & F.col("_known").isNull(), "filter_source"))).select("query_id", "text", "error", "source")
    good = q.filter("error is null")
    sources = embeddings.join(chunks.select("id", "source"), "id")
    vectors_of = query_vectors.join(good.select("query_id", "source"), "query_id")
    found = retrieve(chunks.drop("source"), sources, good.select("query_id", "text"), vectors_of, threshold=threshold, expand=True, only="source", **options)
    again = retry_simplified(good.select("query_id", "text"), found)
    more = retrieve(chunks.drop("source"), sources, again.filter("text != ''"), vectors_of.join(again.select("query_id"), "query_id", "left_semi"), threshold=threshold, expand=True, only="source", **options)
    rows = found.unionByName(more)
    best = rows.groupBy("query_id").agg(F.max("best_score").alias("best_score"))
    score = F.coalesce("best_score", F.lit(0.0))
    status = q.join(best, "query_id", "left").select("query_id", "error", score.alias("best_score"), (F.col("error").isNotNull() | F.col("best_score").isNull() | (score < threshold)).alias("low_confidence"))
    return rows, status


def search_or_vectors(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank: hybrid search, or the vector branch alone where that fails.

    The search is run here and its rows, k a query, are written to the shared folder: a fault while it runs, an
    unreadable text or a lost folder, falls back as one of planning does.  Rows are of one branch, never of both.
    """
    try:
        return files.written(hybrid(chunks, embeddings, queries, query_vectors, k=k).withColumnRenamed("rrf_score", "score"), "search")
    except (PySparkException, Py4JJavaError) as e:
        warnings.warn(f"vector search only: {str(e).splitlines()[0]}", stacklevel=2)
        return vectors.nearest(embeddings, query_vectors, k).withColumnRenamed("similarity", "score")
