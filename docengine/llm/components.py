"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a map-side combined minimum and a join, written to the shared folder; the number of steps
grows with the logarithm of the longest path, and no node's neighbours are gathered anywhere.  The minima
are written out before they are joined: both sides of the join are then shuffles, of which adaptive
execution splits the one a hub makes large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _minima(both: DataFrame) -> DataFrame:
    return materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")


def _star(rows: DataFrame, least: DataFrame, upward: bool) -> DataFrame:
    """Points the larger (upward) or the smaller-or-equal neighbours of each node at its least neighbour."""
    joined = rows.join(least, "a")
    if upward:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for edges (a, b); nodes of no edge do not appear. Nulls and loops are dropped."""
    now = materialise(edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _minima(both)
        large = _star(both, least, upward=True)
        smaller = _minima(large)
        new = materialise(_star(large, smaller, upward=False), "edges")
        discard(now, least, smaller)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
