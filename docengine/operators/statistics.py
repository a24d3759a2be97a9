"""Paired comparison of two arms at any size: signed ranks with ties, and Student's interval of the mean."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.sources.files import written


def running_total(df: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over all rows before one, in order: sums of sorted ranges, then sums inside each."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = {r[0]: r[1] for r in placed.groupBy("_part").agg(F.sum(value)).collect()}
    base, so_far = {}, 0
    for part in sorted(sums):
        base[part], so_far = so_far, so_far + sums[part]
    names, at = df.columns, df.columns.index(value)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{name} long"])

    def run(batches):
        held = {}
        for batch in batches:
            out = []
            for part, x in zip(batch.column(len(names)).to_pylist(), batch.column(at).to_pylist(), strict=True):
                out.append(held.setdefault(part, base[part]))
                held[part] += x
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.int64())], names=[*names, name])

    # A file is one sorted range, and is read in order; ranges stay whole.
    return placed.repartition(n, "_part").sortWithinPartitions("_part", order).mapInArrow(run, schema)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d)
            c = 1 + up / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def student_quantile(p: float, freedom: float) -> float:
    """Of Student's distribution, by halving on its distribution function."""
    if p < 0.5:
        return -student_quantile(1 - p, freedom)
    low, high = 0.0, 1.0
    upper = lambda t: _beta_share(freedom / 2, 0.5, freedom / (freedom + t * t)) / 2
    while upper(high) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > 1 - p else (low, mid)
    return (low + high) / 2


def paired(rows: DataFrame, before: str, after: str, level: float = 0.95) -> DataFrame:
    """n, improved, worsened, gain, w_plus, p, low, high of paired values.

    Equal absolute differences share their mean rank; pairs without a difference have none.  p is two-sided, by the
    normal approximation with the ties' variance; the interval is Student's (null for fewer than two pairs).
    Rows that lack a value are left out; differences are taken to nine digits.
    """
    d = rows.filter(F.col(before).isNotNull() & F.col(after).isNotNull()).select(F.round(F.col(after) - F.col(before), 9).alias("d"))
    moments = d.agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("worsened"), F.avg("d").alias("gain"), F.stddev_samp("d").alias("spread"))
    sizes = d.filter("d != 0").groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    rank = F.col("before") + (F.col("c") + 1) / 2
    ranked = running_total(sizes, "size", "c").withColumn("rank", rank)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * F.col("c")).alias("ranks"), F.sum(F.col("rank") * F.col("rank") * F.col("c")).alias("squares"))

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                p = low = high = None
                if r["n"]:
                    p = math.erfc(abs(r["w_plus"] - r["ranks"] / 2) / math.sqrt(r["squares"] / 2)) if r["squares"] else 1.0
                if r["n"] > 1:
                    half = student_quantile((1 + level) / 2, r["n"] - 1) * r["spread"] / math.sqrt(r["n"])
                    low, high = r["gain"] - half, r["gain"] + half
                yield pa.RecordBatch.from_pylist([{"n": r["n"], "improved": r["improved"], "worsened": r["worsened"], "gain": r["gain"], "w_plus": r["w_plus"] or 0.0, "p": p, "low": low, "high": high}], schema=_PAIRED)

    return moments.crossJoin(F.broadcast(sums)).mapInArrow(finish, "n long, improved long, worsened long, gain double, w_plus double, p double, low double, high double")


_PAIRED = pa.schema([("n", pa.int64()), ("improved", pa.int64()), ("worsened", pa.int64()), *((c, pa.float64()) for c in ("gain", "w_plus", "p", "low", "high"))])
