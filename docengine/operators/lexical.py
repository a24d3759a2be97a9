"""BM25 as ordinary tables: postings, document lengths, corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import tokens

#: Query-term tables up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_TERMS = 200_000


@dataclass
class Bm25Index:
    postings: DataFrame  # id, dl, term, tf
    stats: DataFrame  # n, avgdl
    terms: DataFrame | None = None  # term, df: known for a saved index


def build(docs: DataFrame, id_col: str, token_list: Column) -> Bm25Index:
    """All documents count for n and avgdl, also those without tokens."""
    rows = docs.select(F.col(id_col).alias("id"), token_list.alias("tokens")).withColumn("dl", F.size("tokens"))
    # explode() would have the optimizer test the list's size first, and so tokenise every text twice.
    postings = rows.select("id", "dl", F.explode_outer("tokens").alias("term")).filter("term is not null").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Bm25Index(postings, stats)


def save(index: Bm25Index, path: str) -> None:
    """Three tables under one path; postings are laid out by term so that a lookup reads few files (K5)."""
    index.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.postings.sparkSession.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def load(spark, path: str) -> Bm25Index:
    return Bm25Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "stats", "terms")))


def query_terms(queries: DataFrame, id_col: str, token_list: Column, weight: int = 1) -> DataFrame:
    """query_id, term, mult: how often a term counts."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(token_list).alias("term")).groupBy("query_id", "term").agg((F.count("*") * weight).alias("mult"))


def search(index: Bm25Index, terms: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float | None = None, positive: bool = True) -> DataFrame:
    """query_id, id, score of every matching pair.

    Only postings of query terms are read on: the semi join with the terms is pushed below the counting of an
    index that is not saved.  ``floor``: what a negative idf is replaced by.
    """
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    wanted = terms.select("term").distinct()
    hits = index.postings.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    df = index.terms or hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = idf if floor is None else F.when(idf < 0, F.lit(floor)).otherwise(idf)
    weighted = terms.join(df, "term").crossJoin(F.broadcast(index.stats)).select("query_id", "term", "avgdl", (F.col("mult") * idf).alias("w"))
    scored = hits.join(F.broadcast(weighted) if small else weighted, "term")
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    out = scored.groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return out.filter("score > 0") if positive else out


def document_tokens(column: str = "text") -> Column:
    return tokens(F.col(column))
