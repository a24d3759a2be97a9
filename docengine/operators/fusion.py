"""Rank fusion, boosting, threshold filters and diversity re-ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import dictionaries as D


def ranked(scored: DataFrame, score: str = "score") -> DataFrame:
    """Adds rank from 1 by descending score, ties by id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "id")))


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query."""
    return ranked(scored, score).filter(F.col("rank") <= k)


def rrf(*branches: DataFrame, k: int = 60) -> DataFrame:
    """query_id, id, rrf_score from ranked branches: sum of 1 / (k + rank) (I12). One shuffle for all branches."""
    rows = None
    for b in branches:
        part = b.select("query_id", "id", "rank")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"))


def category_weight(hint: Column, category: Column) -> Column:
    """1.5 for the hinted category, 0.9 for a related one, 0.6 for the general one, else 0."""
    out = F.when(hint == category, 1.5)
    for a, b, w in D.RELATED:
        out = out.when((hint == a) & (category == b), w)
    return out.when((hint == D.GENERAL_CATEGORY) & category.isNotNull(), 0.6).otherwise(0.0)


def boost(df: DataFrame, score: str = "rrf_score") -> DataFrame:
    """Adds ``boosted`` (I16).

    Needs base (array), expanded (array), content, title, keywords, synonyms (arrays), hint, category.
    """
    text, title = F.lower("content"), F.lower("title")
    seen = lambda words: F.size(F.filter(words, lambda w: text.contains(w) | title.contains(w)))
    n = F.greatest(F.size("expanded"), F.lit(1))
    ratio = F.greatest(seen(F.col("base")), seen(F.col("expanded"))) / n

    def share(words: str) -> Column:
        w = F.transform(F.coalesce(F.col(words), F.array().cast("array<string>")), F.lower)
        hit = F.size(F.filter(w, lambda x: F.array_contains("expanded", x) | text.contains(x) | title.contains(x)))
        return F.when(F.size(w) > 0, hit / F.size(w)).otherwise(0.0)

    strong = sum((F.when(title.contains(w) & F.array_contains("expanded", w), 1).otherwise(0) for w in D.STRONG_TITLE_WORDS), F.lit(0))
    factor = 1 + 0.5 * ratio + 0.24 * share("keywords") + 0.16 * share("synonyms") + category_weight(F.col("hint"), F.col("category")) + 0.6 * strong
    return df.withColumn("boosted", F.col(score) * factor)


def threshold_filter(df: DataFrame, k: int, threshold: float = 0.15, margin: float = 0.10, score: str = "score") -> DataFrame:
    """Rows in order of ``pos``: kept at the threshold, or at threshold - margin while fewer than k such rows came before.

    If a query keeps none, its first k rows stand (I18).
    """
    w = Window.partitionBy("query_id").orderBy("pos")
    loose = F.when(F.col(score) >= threshold - margin, 1).otherwise(0)
    before = F.coalesce(F.sum(loose).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keep = (F.col(score) >= threshold) | ((F.col(score) >= threshold - margin) & (before < k))
    marked = df.withColumn("_keep", keep).withColumn("_any", F.max(keep).over(Window.partitionBy("query_id"))).withColumn("_n", F.row_number().over(w))
    return marked.filter(F.col("_keep") | (~F.col("_any") & (F.col("_n") <= k))).drop("_keep", "_any", "_n")


def section_boost(df: DataFrame, add: float, least: float, k: int) -> DataFrame:
    """Adds ``add`` where a section of the row is targeted, keeps scores of at least ``least``, k a query."""
    s = F.col("similarity") + F.when(F.size(F.array_intersect("sections", "targets")) > 0, add).otherwise(0.0)
    return top(df.withColumn("score", s).filter(F.col("score") >= least), k)


def mmr(candidates: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Greedy diversity over distances (query_id, id, distance): picks (query_id, id, pick).

    Sequential by nature; a group is one query's over-fetched candidates, a bounded list.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["distance", "id"], kind="stable").reset_index(drop=True)
        d, left, chosen = frame["distance"].tolist(), list(range(len(frame))), []
        while left and len(chosen) < k:
            value = lambda i: weight * (1 - d[i]) - (1 - weight) * max([0.0, *(1 - abs(d[i] - d[j]) for j in chosen)])
            best = left[0] if not chosen else max(left, key=lambda i: (value(i), -i))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({"query_id": frame["query_id"].iloc[chosen].to_numpy(), "id": frame["id"].iloc[chosen].to_numpy(), "pick": range(1, len(chosen) + 1)})

    return candidates.select("query_id", "id", "distance").groupBy("query_id").applyInPandas(one, "query_id long, id long, pick int")
