"""Answer, model and configuration metrics as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import dictionaries as D


def found_keywords(answer: Column, keywords: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.filter(keywords, lambda k: low.contains(F.lower(k)))


def keyword_share(answer: Column, keywords: Column) -> Column:
    return F.when(F.size(keywords) > 0, F.size(found_keywords(answer, keywords)) / F.size(keywords)).otherwise(0.0)


def answer_quality(answer: Column, keywords: Column, least: Column, long_enough: Column | None = None) -> Column:
    """0.6 keywords + 0.2 [length reached] + 0.2 [more than 50] (E1; E2 passes a token count test)."""
    n = F.length(F.coalesce(answer, F.lit("")))
    return 0.6 * keyword_share(answer, keywords) + F.when(n >= least, 0.2).otherwise(0.0) + F.when(long_enough if long_enough is not None else n > 50, 0.2).otherwise(0.0)


def band(quality: Column) -> Column:
    return F.when(quality > 0.7, "resolved").when(quality > 0.4, "partial").otherwise("failed")


def hundredths(c: Column) -> Column:
    """Rounded to two places as SQL rounds a double: 0.285 is held as a little less and gives 0.28. F.round takes its shortest decimals and gives 0.29."""
    return F.round(c * 100) / 100


def response(df: DataFrame, answer: str = "answer", keywords: str = "keywords", least: int = 200, pass_at: float = 0.8) -> DataFrame:
    """Adds keyword_score, length_score, quality_score, is_fallback and passed."""
    a = F.coalesce(answer, F.lit(""))
    low, n = F.lower(a), F.length(a)
    terms = F.array(*[F.lit(t) for t in D.DOMAIN_TERMS])
    default = F.least(F.lit(1.0), F.size(F.filter(terms, lambda t: low.contains(t))) / 3)
    kw = F.when(F.size(F.coalesce(keywords, F.array().cast("array<string>"))) > 0, keyword_share(a, F.col(keywords))).otherwise(default)
    length = F.when(n >= least, 1.0).otherwise(n / least)
    fallback = F.lit(False)
    for p in D.FALLBACK_PHRASES:
        fallback = fallback | low.contains(p)
    quality = 0.7 * kw + 0.3 * length
    out = df.withColumn("keyword_score", hundredths(kw)).withColumn("length_score", hundredths(length)).withColumn("quality_score", hundredths(quality)).withColumn("is_fallback", fallback)
    out = out.withColumn("passed", (quality >= pass_at) & (n >= least) & ~fallback)
    return out.withColumn("needs_fallback", ~F.col("passed"))


def passes(quality: Column, seconds: Column, least: float = 0.8, limit: float = 45.0) -> Column:
    """E6 (45 s) and E7 (30 s)."""
    return (quality >= least) & (seconds < limit)


def failure_kind(quality: Column, seconds: Column, least: float = 0.8, limit: float = 45.0) -> Column:
    return F.when(passes(quality, seconds, least, limit), "none").when(quality < least, "quality").otherwise("time")


def metadata_quality(answer: Column, keywords: Column, valid: Column) -> Column:
    return 100 * (0.6 * keyword_share(answer, keywords) + 0.4 * F.when(valid, 1.0).otherwise(0.5))


def detection_rate(found: Column, expected: Column) -> Column:
    """Share of distinct expected types that were found; 1 when none is expected."""
    e = F.array_distinct(expected)
    return F.when(F.size(e) > 0, F.size(F.array_intersect(found, e)) / F.size(e)).otherwise(1.0)


def _lines(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""))


def optimisation_precision(original: Column, produced: Column, expected: Column) -> Column:
    """Share of expected added lines that were added."""
    want, got = F.array_except(_lines(expected), _lines(original)), F.array_except(_lines(produced), _lines(original))
    return F.when(F.size(want) > 0, F.size(F.array_intersect(got, want)) / F.size(want)).otherwise(F.when(F.size(got) == 0, 1.0).otherwise(0.0))


def hallucination_rate(produced: Column, known: Column) -> Column:
    """Share of lines whose first word is unknown."""
    rows = F.filter(F.transform(F.split(produced, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    bad = F.filter(rows, lambda x: ~F.array_contains(known, F.element_at(F.split(x, r"\s+"), 1)))
    return F.when(F.size(rows) > 0, F.size(bad) / F.size(rows)).otherwise(0.0)


def global_score(detection: Column, syntax: Column, precision: Column, hallucination: Column, weights=(0.3, 0.3, 0.2, 0.2)) -> Column:
    a, b, c, d = weights
    return a * detection + b * syntax + c * precision + d * (1 - hallucination)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def model_score(quality: Column, seconds: Column, success: Column) -> Column:
    return 0.5 * quality + 0.3 * (100 - F.least(seconds, F.lit(60.0))) + 0.2 * success


def ranking(models: DataFrame) -> DataFrame:
    """Adds by_quality, by_speed and compromise (the most quality for one and its seconds) to a row a model.

    A row a model is few; equal ones share a rank.
    """
    worth = F.round(F.col("quality") / (1 + F.col("seconds")), 6)
    out = models.withColumn("by_quality", F.rank().over(Window.orderBy(F.desc("quality")))).withColumn("by_speed", F.rank().over(Window.orderBy("seconds")))
    best = models.agg(F.max(worth).alias("_best"))
    return out.crossJoin(F.broadcast(best)).withColumn("compromise", worth == F.col("_best")).drop("_best")


def chunk_faults(chunks: DataFrame, parents: DataFrame, required: list[str]) -> DataFrame:
    """id, missing (required keys that are null or empty), orphan: chunks that break an invariant."""
    lacking = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required)))
    known = parents.select("parent_id", F.lit(True).alias("_known")).distinct()
    rows = chunks.withColumn("missing", F.array_join(lacking, ",")).join(known, "parent_id", "left")
    return rows.select("id", "missing", F.col("_known").isNull().alias("orphan")).filter("missing != '' or orphan")


def wilcoxon_p(differences: list[float]) -> float:
    """Two-sided signed-rank p by the normal approximation, ties averaged."""
    d = sorted((abs(x), x > 0) for x in differences if x)
    n = len(d)
    if not n:
        return 1.0
    ranks, i = [0.0] * n, 0
    while i < n:
        j = i
        while j < n and d[j][0] == d[i][0]:
            j += 1
        ranks[i:j] = [(i + j + 1) / 2] * (j - i)
        i = j
    w = sum(r for r, (_, up) in zip(ranks, d, strict=True) if up)
    var = sum(r * r for r in ranks) / 4
    return math.erfc(abs(w - sum(ranks) / 2) / math.sqrt(2 * var))


#: The levels of each suite; a suite holds all cases of the one before it.
SUITES = {"quick": ("easy",), "standard": ("easy", "medium"), "full": ("easy", "medium", "hard")}


def select_cases(cases: DataFrame, suite: str = "full", category: str | None = None) -> DataFrame:
    """Cases by level, and by category if one is given."""
    out = cases.filter(F.col("difficulty").isin(*SUITES[suite]))
    return out if category is None else out.filter(F.col("category") == category)
