"""Page hierarchies: nodes, orphans, depths level by level, breadth-first crawl. Levels are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.sources.files import remove, written


def nodes(pages: DataFrame) -> DataFrame:
    """url, children (distinct), implied: parents that are no page appear too (H1)."""
    own = pages.select("url").distinct().withColumn("_page", F.lit(True))
    edges = pages.filter("parent_url is not null and parent_url != '' and parent_url != url").select("url", "parent_url").distinct()
    kids = edges.groupBy(F.col("parent_url").alias("url")).agg(F.count("*").alias("children"))
    return own.join(kids, "url", "full").select("url", F.coalesce("children", F.lit(0)).cast("long").alias("children"), F.col("_page").isNull().alias("implied"))


def orphans(pages: DataFrame) -> DataFrame:
    """Pages whose parent is given but is no page (H2)."""
    known = pages.select(F.col("url").alias("parent_url")).distinct()
    return pages.filter("parent_url is not null and parent_url != '' and parent_url != url").join(known, "parent_url", "left_anti").select("url", "parent_url")


def depths(pages: DataFrame) -> DataFrame:
    """url, depth from the roots (1); a page that is its own parent is a root, cycles are never entered (H3).

    Level by level, until one is empty: a page has one parent row at least, and is taken at its least depth.
    """
    parents = pages.select("url", F.when(F.col("parent_url") != F.col("url"), F.nullif("parent_url", F.lit(""))).alias("parent_url")).distinct()
    known = parents.select(F.col("url").alias("parent_url"), F.lit(True).alias("_known")).distinct()
    level = written(parents.join(known, "parent_url", "left").filter("_known is null").select("url").distinct().withColumn("depth", F.lit(1)), "depth")
    seen, depth = level, 1
    while level.limit(1).count():
        depth += 1
        below = parents.join(level.select(F.col("url").alias("parent_url")), "parent_url", "left_semi").select("url").distinct()
        level = written(below.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "depth")
        seen = seen.unionByName(level) if depth % 32 else written(seen.unionByName(level), "depth")
    return seen


def depths_by_jumps(pages: DataFrame) -> DataFrame:
    """``depths`` in a number of steps that grows with the logarithm of the depth (H3, H1).

    A page points at its least parent row that leads to a root; in each step it points as far again.  A page of one
    parent has one way up, so steps double its hops.  Pages of several parents are taken at their least depth: all
    their ways are kept, each with its hops.  A way that is still open after as many steps as double to the number of
    pages runs in a cycle, and is dropped.
    """
    parents = pages.select("url", F.when(F.col("parent_url") != F.col("url"), F.nullif("parent_url", F.lit(""))).alias("parent_url")).distinct()
    known = parents.select(F.col("url").alias("parent_url"), F.lit(True).alias("_known")).distinct()
    ways = parents.join(known, "parent_url", "left").select("url", F.when(F.col("_known"), F.col("parent_url")).alias("to"), F.lit(1).cast("long").alias("hops"))
    ways = written(ways, "ways")
    most = parents.select("url").distinct().count()
    steps = 0
    while most >> steps and ways.filter("to is not null").limit(1).count():
        ahead = ways.select(F.col("url").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        far = ways.filter("to is not null").join(ahead, "to").select("url", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops"))
        # Of the ways of one page to one place only the shortest can matter.
        new = written(ways.filter("to is null").unionByName(far).groupBy("url", "to").agg(F.min("hops").alias("hops")), "ways")
        remove(ways)
        ways, steps = new, steps + 1
    return ways.filter("to is null").groupBy("url").agg(F.min("hops").cast("int").alias("depth"))


def crawl(links: DataFrame, start: str, most: int = 1000) -> DataFrame:
    """url, hops reached from ``start`` over links (url, target), nearest first, at most ``most`` pages."""
    spark = links.sparkSession
    seen = spark.createDataFrame([(start, 0)], "url string, hops int")
    front, hops, n_seen = seen.select("url"), 0, 1
    while n_seen < most:
        hops += 1
        new = links.join(front, "url").select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        front = written(new, "crawl")
        n = front.count()
        if n == 0:
            break
        seen, n_seen = seen.unionByName(front.withColumn("hops", F.lit(hops))), n_seen + n
    return seen.orderBy("hops", "url").limit(most)
