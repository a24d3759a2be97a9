"""Content-addressed store of token-id streams (operator 5).

A rolling hash over each document's ids cuts the stream into chunks; a chunk is named by the hash of
its bytes and stored once; a recipe per document lists its chunk names in order, with a Merkle root
over them.  Two Parquet tables under one path: ``chunks`` (name, ids, bytes per id) and ``recipes`` (in
ascending order of doc_id, with the place of every row).  Ids too large for the width are refused.

Defined results: null and empty texts are one end id; repeated rows keep a recipe each; equal doc_ids
are ordered by their ids' root; null doc_ids sort first; an empty table gives an empty store; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import delete_path, scratch, spread, tidy

#: Mean, least and most ids between two cuts; ids that the rolling hash sees.
CHUNK_MEAN, CHUNK_LEAST, CHUNK_MOST, WINDOW = 512, 96, 4096, 4
END_ID = 2
DIGEST_BYTES = 16

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def cut_points(ids: np.ndarray, mean: int = CHUNK_MEAN, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> list[int]:
    """Ends of the chunks. A cut depends on the last WINDOW ids only, so equal passages re-align."""
    n = len(ids)
    h = np.zeros(n, np.uint32)
    x = ids.astype(np.uint32) + np.uint32(1)
    for k in range(WINDOW):
        h[k:] += x[: n - k] * _MULTIPLIERS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ends, last = [], 0
    for c in (np.flatnonzero(h % np.uint32(mean) == 0) + 1).tolist():
        while c - last > most:
            last += most
            ends.append(last)
        if c - last >= least:
            ends.append(c)
            last = c
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunk_name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last node moves up unchanged."""
    level = list(leaves) or [chunk_name(b"")]
    while len(level) > 1:
        up = [chunk_name(b"\x01" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        if len(level) % 2:
            up.append(level[-1])
        level = up
    return level[0]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
    return out


_SHIFTS: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes modulo the polynomial."""
    found = _SHIFTS.get(n_bytes)
    if found is None:
        found, square, n = 0x80000000, 0x00800000, n_bytes
        while n:
            if n & 1:
                found = _times(found, square)
            square = _times(square, square)
            n >>= 1
        if len(_SHIFTS) < 1 << 16:
            _SHIFTS[n_bytes] = found
    return found


def crc32_concat(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation, from (CRC-32, bytes) of its parts."""
    crc = 0
    for part, n in parts:
        crc = _times(crc, _shift(n)) ^ part if n else crc
    return crc


def _cut_documents(path: str, end_id: int, width: int):
    dtype = "<u2" if width == 2 else "<u4"

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "names", "root", "chunks")}
            seen: set[bytes] = set()
            for _, ids in tokens.encoded(batch, path):
                ids = np.append(ids, np.uint32(end_id))
                if width == 2 and ids.max() > 0xFFFF:
                    raise ValueError(f"id {ids.max()} does not fit two bytes: write the store with width=4")
                packed, names, fresh, last = ids.astype(dtype), [], [], 0
                for end in cut_points(ids):
                    data = packed[last:end].tobytes()
                    name = chunk_name(data)
                    names.append(name)
                    if name not in seen:
                        seen.add(name)
                        fresh.append({"name": name, "ids": data})
                    last = end
                out["n_tokens"].append(len(ids))
                out["names"].append(names)
                out["root"].append(merkle_root(names))
                out["chunks"].append(fresh)
            chunk = pa.struct([("name", pa.binary()), ("ids", pa.binary())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["names"], pa.list_(pa.binary())), pa.array(out["root"], pa.binary()), pa.array(out["chunks"], pa.list_(chunk))],
                names=["doc_id", "n_tokens", "names", "root", "chunks"],
            )

    return run


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, width: int = 2) -> None:
    """Encode, cut and store whole texts. ``width``: bytes per id (2 where the vocabulary has at most 65,536 ids)."""
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.vocabulary_path()
    n = spread(spark, docs)
    staged = scratch(spark, "token-staging")
    cut = docs.select("doc_id", "text").mapInArrow(
        tidy(_cut_documents(vocabulary, end_id, width)), "doc_id long, n_tokens long, names array<binary>, root binary, chunks array<struct<name: binary, ids: binary>>"
    )
    cut.write.option("compression", "zstd").parquet(staged)
    rows = spark.read.schema(cut.schema).parquet(staged)
    # A chunk that a third of the documents share is combined before the shuffle: once per map task.
    chunks = rows.select(F.explode("chunks").alias("c")).select("c.name", "c.ids").groupBy("name").agg(F.first("ids").alias("ids"))
    chunks.withColumn("width", F.lit(width)).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = rows.select("doc_id", "n_tokens", "names", "root").repartitionByRange(n, F.asc("doc_id")).sortWithinPartitions("doc_id", "root", "n_tokens")
    recipes.withColumn("place", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    delete_path(spark, staged)


def _check_chunks(batches):
    """name, ids and CRC-32 (as 32-bit ids) of every stored chunk, from its bytes."""
    for batch in batches:
        names, n_ids, crcs = [], [], []
        for name, data, width in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            name, data = name.as_py(), data.as_py()
            if chunk_name(data) != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            ids = np.frombuffer(data, "<u2" if width.as_py() == 2 else "<u4")
            names.append(name)
            n_ids.append(len(ids))
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n_ids, pa.int64()), pa.array(crcs, pa.int64())], names=["name", "n_ids", "crc"])


def _verify(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parts = sorted(row["parts"], key=lambda p: p["pos"])
            if [p["pos"] for p in parts] != list(range(row["n_parts"])) or merkle_root([p["name"] for p in parts]) != row["root"]:
                raise ValueError(f"document {row['doc_id']}: its recipe does not match its manifest")
            total = sum(p["n_ids"] for p in parts)
            if total != row["n_tokens"]:
                raise ValueError(f"document {row['doc_id']}: {total} ids, {row['n_tokens']} expected")
            out.append((row["place"], row["doc_id"], total, crc32_concat([(p["crc"], 4 * p["n_ids"]) for p in parts])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["place", "doc_id", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, all from the stored files, each recipe verified.

    A document's checksum is combined from those of its chunks, so chunk bytes are read once and never
    shuffled.  A chunk that many documents share makes one side of the join large; both sides are shuffles,
    so adaptive execution splits it.
    """
    chunks = spark.read.schema("name binary, ids binary, width int").parquet(f"{path}/chunks")
    recipes = spark.read.schema("doc_id long, n_tokens long, names array<binary>, root binary, place long").parquet(f"{path}/recipes")
    checked = chunks.select("name", "ids", "width").mapInArrow(_check_chunks, "name binary, n_ids long, crc long")
    used = recipes.select("place", F.posexplode("names").alias("pos", "name"))
    parts = used.join(checked, "name").groupBy("place").agg(F.collect_list(F.struct("pos", "name", "n_ids", "crc")).alias("parts"))
    whole = recipes.select("place", "doc_id", "n_tokens", "root", F.size("names").alias("n_parts")).join(parts, "place", "left")
    verified = whole.mapInArrow(_verify, "place long, doc_id long, n_tokens long, ids_crc32 long")
    return _with_starts(recipes, verified)


def _with_starts(recipes: DataFrame, verified: DataFrame) -> DataFrame:
    """Ids before each document: a running sum inside each file of the store, after one total per file."""
    part = F.shiftright("place", 33)
    sums = recipes.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("ids"))
    before = sums.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    placed = verified.withColumn("part", part).withColumn("inside", inside)
    return placed.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids as array<long>: documents rebuilt from recipes and chunks."""
    chunks = spark.read.schema("name binary, ids binary, width int").parquet(f"{path}/chunks")
    recipes = spark.read.schema("doc_id long, n_tokens long, names array<binary>, root binary, place long").parquet(f"{path}/recipes")
    rows = recipes.select("place", "doc_id", F.posexplode("names").alias("pos", "name")).join(chunks, "name")
    parts = rows.groupBy("place", "doc_id").agg(F.collect_list(F.struct("pos", "ids", "width")).alias("parts"))

    def rebuild(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = sorted(row["parts"], key=lambda p: p["pos"])
                out.append([int(x) for p in parts for x in np.frombuffer(p["ids"], "<u2" if p["width"] == 2 else "<u4")])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return parts.mapInArrow(rebuild, "doc_id long, ids array<long>")
