"""Shared helpers: table access, the shared folder, Arrow text slices and a vectorised word hash."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at once inside a Python worker (one longer text is handled whole).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: ``spark.checkpoint.dir``. Only a local session without it gets one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (found or f"file://{tempfile.gettempdir()}/checkpoints/docengine").rstrip("/")


def file_system(uri: str):
    """(file system, path) of a shared folder, for files that are not tables; works on executors."""
    from pyarrow import fs

    # Hadoop's ways of writing: file:/folder, s3a://bucket.
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/*", "file:///", uri)))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/docengine-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Remove what ``materialise`` wrote, once no plan reads it any more."""
    for df in written:
        if df is not None:
            delete_path(df.sparkSession, df._scratch_path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's own file API (any store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes of text.

    Null texts have no bytes.  Offsets are relative to the slice's bytes.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def tidy(run):
    """An Arrow function that gives freed memory back when its task ends: workers are reused, and what they keep adds up."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # only glibc has it


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that equal sums of a polynomial do not look alike."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def lut(words: str) -> np.ndarray:
    """True for the bytes that belong to words. 'space': all but ASCII white space; 'alnum': ASCII letters, digits, non-ASCII."""
    out = np.ones(256, bool)
    if words == "space":
        out[[0x20, *range(0x09, 0x0E)]] = False
    elif words == "alnum":
        for lo, hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
            out[lo : hi + 1] = False
    else:
        raise ValueError(words)
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and each document's first word (documents + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] = inside[1:-1][cut]
    ends[cut - 1] = inside[1:-1][cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the slice."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_INV, len(data))[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


_BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F)
_INV_2 = np.uint64(pow(int(_BASE_2), -1, 1 << 64))
_BYTE_VALUES_2 = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another 64 bits of each span, of a base and byte values of their own."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES_2[data] * _powers(_BASE_2, len(data)), out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(_INV_2, len(data))[starts] + (ends - starts).astype(np.uint64)


def ragged(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated values and their offsets."""
    lens = np.fromiter((len(v) for v in values), np.int64, len(values))
    off = np.zeros(len(values) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    return (np.concatenate(values) if values else np.zeros(0)), off


def held_out_expr(column: str = "doc_id") -> str:
    """SQL: the rows no model may learn labels from."""
    return f"coalesce(pmod(crc32(cast(cast({column} as string) as binary)), 3) = 1, false)"


def spread(spark: SparkSession, df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions for tables whose size follows the input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
