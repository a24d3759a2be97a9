"""Comparisons of document sets, rankings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, key: str) -> DataFrame:
    """key, n, percent (A2)."""
    total = df.agg(F.count("*").alias("_total"))
    return df.groupBy(key).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(key, "n", F.round(100.0 * F.col("n") / F.col("_total"), 4).alias("percent"))


def validation_report(df: DataFrame, text: str, required: list[str]) -> DataFrame:
    """Rows, empty (< 50), short (< 200) and rows that lack a required field (A4)."""
    n = F.length(F.coalesce(text, F.lit("")))
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return df.agg(F.count("*").alias("n"), F.count_if(n < 50).alias("empty"), F.count_if((n >= 50) & (n < 200)).alias("short"), F.count_if(missing).alias("incomplete"))


def overlap(found: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Counts of both distinct key sets, shared, missing, extra and coverage in percent."""
    a = found.select(key).distinct().withColumn("_a", F.lit(1))
    b = reference.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    agg = both.agg(F.count("_a").alias("found"), F.count("_b").alias("reference"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_b").isNull()).alias("extra"))
    return agg.withColumn("coverage", F.coalesce(F.round(F.try_divide(100.0 * F.col("shared"), F.col("reference")), 4), F.lit(0.0)))


def diff_report(found: DataFrame, reference: DataFrame, key: str, threshold: float = 95.0) -> DataFrame:
    """reference, found, shared, missing, coverage, enough and a sentence that says so (H4)."""
    o = overlap(found, reference, key)
    enough = F.col("coverage") >= threshold
    text = F.format_string(f"coverage %.2f%%, %s the threshold of {threshold:g}%%; %d documents missing", "coverage", F.when(enough, "at or above").otherwise("below"), "missing")
    return o.select("reference", "found", "shared", "missing", "coverage", enough.alias("enough"), text.alias("summary"))


def missing(reference: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return reference.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins (K6)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def first_seen(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys with their first position."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def best(df: DataFrame, group: list[str], name: str, score: Column) -> DataFrame:
    """The name with the highest score of each group, ties to the least name."""
    ordered = F.struct(score.alias("s"), F.lit(0))
    return df.groupBy(*group).agg(F.max(ordered)["s"].alias("score"), F.max_by(name, F.struct(score, F.col(name))).alias("best")) if group else df.agg(F.max(score).alias("score"), F.max_by(name, F.struct(score, F.col(name))).alias("best"))
