"""A keyed store that rewrites only the parts an upsert or delete touches.

Keys are dealt to ``parts`` by a hash.  A change writes the touched parts as a generation of their own, then a manifest that
names the generation of every part; the manifest is written aside and renamed to its version's number.  A reader takes the
highest version, so a change that fails before the rename leaves the one before as it was, and of two changes at a time one
finds its number taken and fails.  Files of untouched parts stay where they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators.sets import latest
from docengine.sources.files import _hadoop


def _manifests(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, f"{path}/versions")
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")) if fs.exists(p) else []


def manifest(spark: SparkSession, path: str) -> dict:
    """version, parts, key, schema, generations (by part) of the store as it is."""
    name = _manifests(spark, path)[-1]
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/versions/{name}", wholetext=True).collect()))


def _publish(spark: SparkSession, path: str, state: dict) -> None:
    fs, aside = _hadoop(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    _, final = _hadoop(spark, f"{path}/versions/{state['version']:012d}.json")
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise RuntimeError(f"version {state['version']} of {path} was written by another change")


def _part(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _write(rows: DataFrame, path: str, key: str, parts: int) -> tuple[str, list[int]]:
    generation = uuid.uuid4().hex
    target = f"{path}/generations/{generation}"
    placed = rows.withColumn("_part", _part(key, parts))
    placed.repartition("_part").write.partitionBy("_part").parquet(target)
    fs, p = _hadoop(rows.sparkSession, target)
    return generation, [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if "=" in f.getPath().getName()]


def create(rows: DataFrame, path: str, key: str, parts: int = 64) -> None:
    generation, own = _write(rows, path, key, parts)
    _publish(rows.sparkSession, path, {"version": 1, "parts": parts, "key": key, "schema": rows.schema.json(), "generations": {str(p): generation for p in own}})


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """All rows, or those of some parts."""
    from pyspark.sql.types import StructType

    state = manifest(spark, path)
    schema = StructType.fromJson(json.loads(state["schema"]))
    paths = [f"{path}/generations/{g}/_part={p}" for p, g in state["generations"].items() if only is None or int(p) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _change(spark: SparkSession, path: str, touched: list[int], rows) -> None:
    state = manifest(spark, path)
    new = dict(state["generations"])
    for p in touched:
        new.pop(str(p), None)
    if touched:
        generation, own = _write(rows(read(spark, path, touched)), path, state["key"], state["parts"])
        new |= {str(p): generation for p in own}
    _publish(spark, path, state | {"version": state["version"] + 1, "generations": new})


def _touched(rows: DataFrame, state: dict) -> list[int]:
    """At most ``parts`` numbers."""
    return [r[0] for r in rows.select(_part(state["key"], state["parts"])).distinct().collect()]


def upsert(spark: SparkSession, path: str, rows: DataFrame, version: str) -> None:
    """The row of the highest ``version`` of each key wins."""
    state = manifest(spark, path)
    _change(spark, path, _touched(rows, state), lambda old: latest(old.unionByName(rows), state["key"], version))


def delete(spark: SparkSession, path: str, keys: DataFrame) -> None:
    state = manifest(spark, path)
    _change(spark, path, _touched(keys, state), lambda old: old.join(keys.select(state["key"]), state["key"], "left_anti").select(*old.columns))
