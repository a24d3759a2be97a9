"""Benchmark decontamination by one Aho-Corasick automaton (operator 9).

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded.  Every window of
WINDOW consecutive item words (or the whole item, if it has fewer) is a pattern; the automaton scans a
document's normalised words once, and matches are mapped back to word numbers and to offsets of the
original text.  Windows are collected and counted by Spark and fetched in blocks of at most BLOCK_CHARS
characters, of which the driver and a worker hold one at a time: a benchmark of one block (any in use today)
is one scan without a shuffle, and each further block is one more pass over rows written out, which adds its
hits to those found.

Defined results: null texts have no words; items without words have no window; equal items each count, and
each row of a repeated item_id too, in the number and in the list; null item_ids are left out of the list;
repeated documents give repeated rows; an empty benchmark leaves every document clean; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, lut, materialise, tidy

WINDOW = 13
#: Characters of patterns, and eight for each item of one, in one automaton (about 100 bytes of memory each at most).
BLOCK_CHARS = 1 << 20
#: contaminated: hit words times this are at least the words.
SHARE = 20

_FOLD = bytes(int(LOWER[b]) if lut("alnum")[b] else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The folded words, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def windows(item: list[bytes], size: int = WINDOW) -> set[bytes]:
    if not item:
        return set()
    return {b" ".join(item[i : i + size]) for i in range(max(1, len(item) - size + 1))}


_CACHE: dict[str, tuple] = {}


Item = tuple[int, str | None]


def automaton(patterns: list[tuple[str, tuple[Item, ...]]]):
    """patterns: (text, items). Values are (number of words, pattern number)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, (text, _) in enumerate(patterns):
        machine.add_word(f" {text} ", (text.count(" ") + 1, k))
    if patterns:
        machine.make_automaton()
    return machine, [items for _, items in patterns]


def _cached(shared, key: str):
    """A block's automaton, built once per worker."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = automaton(shared.value)
    return _CACHE[key]


def scan(text: str | None, machine, items_of) -> tuple[int, list[tuple[int, int]], set[Item]]:
    """(words, merged hit ranges of word numbers, items found) of one text."""
    found = words(text)
    if not found or not items_of:
        return len(found), [], set()
    line = f" {b' '.join(found).decode()} "
    hits = [(end, value) for end, value in machine.iter(line)]
    if not hits:
        return len(found), [], set()
    gaps = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
    ranges, items = [], set()
    last_of = np.searchsorted(gaps, [end for end, _ in hits])
    for last, (_, (n, k)) in zip(last_of.tolist(), hits, strict=True):
        items.update(items_of[k])
        ranges.append((last - n, last))
    return len(found), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def original_offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of ranges of word numbers."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inside = np.ones(len(chars) + 2, bool)
    inside[1:-1] = (chars >= 128) | lut("alnum")[np.minimum(chars, 127)]
    inside[[0, -1]] = False
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    return [(int(starts[lo]), int(ends[hi - 1])) for lo, hi in ranges]


def patterns(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """pattern, items (row number and item_id as text of each item with that window), written out."""

    def run(batches):
        for batch in batches:
            found = [(n, item, w.decode()) for n, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in windows(words(text), window)]
            columns = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["n", "id", "pattern"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("n"), F.col("item_id").cast("string").alias("id"), "text")
    each = rows.mapInArrow(tidy(run), "n long, id string, pattern string")
    return materialise(each.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("items")), "patterns")


def blocks(rows: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[str, tuple[Item, ...]]]]:
    """Patterns in blocks of bounded size; a partition of the table and a block are held at a time."""
    block, held = [], 0
    for row in rows.toLocalIterator():
        size = len(row["pattern"]) + 8 * len(row["items"])
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append((row["pattern"], tuple((x["n"], x["id"]) for x in row["items"])))
        held += size
    if block:
        yield block


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_ITEMS = pa.list_(pa.struct([("n", pa.int64()), ("id", pa.string())]))


def _scan_block(shared, key: str):
    """Adds one block's hits to the last three columns: n_words, ranges, items."""

    def run(batches):
        machine, items_of = _cached(shared, key)
        for batch in batches:
            k = batch.num_columns - 3
            n, ranges, items = [], [], []
            old = zip(batch.column(k + 1), batch.column(k + 2), strict=True)
            for text, (had, known) in zip(batch.column(batch.schema.get_field_index("text")), old, strict=True):
                count, spans, found = scan(text.as_py(), machine, items_of)
                n.append(count)
                if len(had):
                    spans = merged(spans + [(r["lo"], r["hi"]) for r in had.as_py()])
                    found |= {(x["n"], x["id"]) for x in known.as_py()}
                ranges.append([{"lo": lo, "hi": hi} for lo, hi in spans])
                items.append([{"n": i, "id": x} for i, x in sorted(found, key=lambda r: r[0])])
            done = [pa.array(n, pa.int64()), pa.array(ranges, _SPANS), pa.array(items, _ITEMS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *done], names=batch.schema.names)

    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_CHARS) -> tuple[DataFrame, list[str]]:
    """Documents with three more columns, and their names: words, merged hit ranges, items.

    A block's automaton is gone before the next one is built: rows are written out between two scans.
    """
    spark = docs.sparkSession
    names = ["n_words", "ranges", "items"]
    while set(names) & set(docs.columns):
        names = ["_" + n for n in names]
    kinds = ("long", "array<struct<lo: long, hi: long>>", "array<struct<n: long, id: string>>")
    out = docs
    for name, kind, start in zip(names, kinds, ("0L", "array()", "array()"), strict=True):
        out = out.withColumn(name, F.expr(f"cast({start} as {kind})"))
    before = None
    # Without any pattern there is still one scan, which counts the words.
    for block in blocks(patterns(benchmark, window), limit):
        if before is not None:
            out = materialise(out, "scanned")
            before.unpersist()
        before = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(tidy(_scan_block(before, uuid.uuid4().hex)), out.schema)
    if before is None:
        out = out.mapInArrow(tidy(_scan_block(spark.sparkContext.broadcast([]), uuid.uuid4().hex)), out.schema)
    return out, names


def hit_words(ranges: str) -> str:
    """SQL: the words in merged ranges."""
    return f"aggregate({ranges}, 0L, (a, r) -> a + r.hi - r.lo)"


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    hits, (n_words, ranges, items) = find(docs.select("doc_id", "text"), benchmark, window, limit)
    named = f"concat_ws(',', array_sort(filter(transform({items}, x -> x.id), x -> x is not null)))"
    rows = hits.select("doc_id", F.col(n_words).alias("n_words"), F.expr(hit_words(ranges)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.expr(f"sha2({named}, 256)").alias("items_sha256"))
    return rows.withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_CHARS) -> DataFrame:
    """The documents that are not contaminated, all columns kept."""
    hits, (n_words, ranges, _) = find(docs, benchmark, window, limit)
    hit = hit_words(ranges)
    return hits.filter(f"not ({hit} > 0 and {SHARE} * {hit} >= {n_words})").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT i, item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS t
      FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM k),
x AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS t
      FROM (SELECT d.r, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS p FROM d, s WHERE len(d.w) >= s.n)),
m AS (SELECT x.r, x.p, x.n, k.i, k.item_id FROM x JOIN k ON x.t = k.t AND x.n = k.n),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
f AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, i, item_id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)
"""
