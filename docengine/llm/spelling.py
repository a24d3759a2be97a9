"""Spelling variants by full neighbourhood generation (operator 13).

Words are counted by Spark.  Of every word all distinct deletions, replacements and insertions over the
observed alphabet are generated, and those are hash-joined to the vocabulary: a candidate that equals a
word is exactly one edit away, so nothing is left to verify.  Of each neighbour the join sees both ends.

Candidates are made as hashes, in numpy, from each word's prefix sums.  A bit filter of the vocabulary
(``FILTER_BITS`` bits whatever the input: a proven bound for its broadcast) stops most of those that are no
word before they are written out as text and shuffled.  It only saves rows: a larger vocabulary lets more
of them through to the join, which alone decides.  Words over ``LONG`` code points have more bits each, as
they have more candidates and those are longer.

The word of largest count within one edit is a word's form where it is ``RATIO`` times as frequent, so a
chain of forms is as short as a logarithm of the counts; roots are found by doubling steps over the words
that have a form.

Defined results: a null or empty text has no words; a null doc_id stands for an empty one in the damage's
key; repeated rows count again; equal counts give the first form in code-point order; the signs U+00D7
and U+00F7 are letters here, as the pattern has them; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, discard, materialise, mix64, spread, tidy

LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
#: Bits of the broadcast filter: 16 MB.
FILTER_BITS = 1 << 27
#: Words longer than this have LONG_PROBES bits in the filter, others PROBES.
LONG, PROBES, LONG_PROBES = 32, 2, 8
#: Shuffle partitions whose words go to one file: counting leaves a twentieth of the rows that it shuffles.
A_FILE = 16
#: Hashes of one vectorised step, and bytes of candidates written at once.
BLOCK, BYTES = 1 << 20, 1 << 23

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUNS = r"[A-Za-zÀ-ÿ]+"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_LENGTH = 0xA0761D6478BD642F


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters, damaged as the contract says, of enough length and count (columns doc_id, text)."""
    lower = F.translate("text", _UPPER, _UPPER.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(_RUNS), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= LEAST_LENGTH)
    key = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(key, F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    words = runs.withColumn("key", key).withColumn("at", at).select(F.when(F.col("key") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _by_length(words: list[str]):
    """(places, code point matrix) of words of one length each, in bounded blocks."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for length in np.unique(lengths).tolist():
        own = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, "right")]
        rows = max(1, BLOCK // (128 * (length + 1)))
        for lo in range(0, len(own), rows):
            part = own[lo : lo + rows]
            text = "".join(words[i] for i in part)
            yield part, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(part), length)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Sums of value x power before each place: one more column than there are code points."""
    rows, length = codes.shape
    out = np.zeros((rows, length + 1), np.uint64)
    np.cumsum(_VALUES[codes] * _powers(_BASE, length), axis=1, out=out[:, 1:])
    return out


def _finish(sums: np.ndarray, length: int) -> np.ndarray:
    return mix64(sums + np.uint64(length * _LENGTH % (1 << 64)))


def _places(hashes: np.ndarray, probe: int) -> np.ndarray:
    return (hashes + np.uint64(probe) * ((hashes >> np.uint64(32)) | np.uint64(1))) & np.uint64(FILTER_BITS - 1)


def _probes(length: int) -> int:
    return LONG_PROBES if length > LONG else PROBES


def _bits(batches):
    """slot, bits: what the words of a batch set in the filter, 64 bits a slot."""
    for batch in batches:
        words, found = batch.column(0).to_pylist(), []
        for _, codes in _by_length(words):
            h = _finish(_prefixes(codes)[:, -1], codes.shape[1])
            found += [_places(h, k) for k in range(_probes(codes.shape[1]))]
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        slot, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        bits = np.bitwise_or.reduceat(bit, first) if len(slot) else bit
        yield pa.RecordBatch.from_arrays([pa.array(slot[first].astype(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "bits"])


def word_filter(words: DataFrame) -> np.ndarray:
    """The filter, FILTER_BITS / 8 bytes: combined by Spark, at most one row a slot reaches the driver."""
    slots = words.select("word").mapInArrow(tidy(_bits), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return out


def alphabet(words: DataFrame) -> np.ndarray:
    """The code points of the vocabulary, in order: at most the letters of the pattern."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter != ''").distinct().collect()
    return np.array(sorted(ord(r.letter) for r in letters), np.uint32)


def _known(bits: np.ndarray, sums: np.ndarray, length: int, allowed: np.ndarray) -> np.ndarray:
    """Flat places of the allowed candidates that the filter does not rule out."""
    flat = np.flatnonzero(allowed)
    hashes = _finish(sums.reshape(-1)[flat], length)
    for k in range(_probes(length)):
        at = _places(hashes, k)
        hit = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        flat, hashes = flat[hit], hashes[hit]
    return flat


def _edits(codes: np.ndarray, letters: np.ndarray, bits: np.ndarray):
    """(edit, rows, places, letters) of the distinct candidates of words of one length that may be words.

    Of equal candidates one is made: the first of a run of equal letters is deleted, and a letter is not
    inserted behind its like.
    """
    rows, length = codes.shape
    sums, power, values = _prefixes(codes), _powers(_BASE, length + 1), _VALUES[letters]
    total = sums[:, -1:]
    fresh = np.ones(codes.shape, bool)
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    if length > 1:
        flat = _known(bits, sums[:, :-1] + (total - sums[:, 1:]) * _INVERSE, length - 1, fresh)
        yield "delete", flat // length, flat % length, None
    step = max(1, BLOCK // (rows * len(letters)))
    for lo in range(0, length + 1, step):
        hi = min(lo + step, length + 1)
        before, n = codes[:, max(lo - 1, 0) : hi - 1], hi - lo
        allowed = np.ones((rows, n, len(letters)), bool)
        allowed[:, n - before.shape[1] :] = before[:, :, None] != letters
        made = (sums[:, lo:hi] + (total - sums[:, lo:hi]) * _BASE)[:, :, None] + power[lo:hi, None] * values
        flat = _known(bits, made, length + 1, allowed)
        yield "insert", flat // (n * len(letters)), lo + flat // len(letters) % n, letters[flat % len(letters)]
        now = codes[:, lo:hi]
        if n := now.shape[1]:
            made = (total - _VALUES[now] * power[lo : lo + n])[:, :, None] + power[lo : lo + n, None] * values
            flat = _known(bits, made, length, now[:, :, None] != letters)
            yield "replace", flat // (n * len(letters)), lo + flat // len(letters) % n, letters[flat % len(letters)]


def _spelled(codes: np.ndarray, edit: str, rows: np.ndarray, places: np.ndarray, letters: np.ndarray | None) -> np.ndarray:
    """The candidates as text."""
    own, length = codes[rows], codes.shape[1]
    each = np.arange(len(rows))
    if edit == "replace":
        own[each, places] = letters
    else:
        long = length + (1 if edit == "insert" else -1)
        out = np.empty((len(rows), long), np.uint32)
        at = np.arange(long)
        source = np.where(at >= places[:, None], at + (-1 if edit == "insert" else 1), at)
        out[:] = np.take_along_axis(own, np.clip(source, 0, length - 1), axis=1)
        if edit == "insert":
            out[each, places] = letters
        own = out
    own = np.ascontiguousarray(own, np.uint32)
    return own.view(f"<U{own.shape[1]}").reshape(-1)


def candidates(words: DataFrame, letters: np.ndarray, bits: np.ndarray) -> DataFrame:
    """word, candidate: all distinct texts one edit away, but for those that the filter rules out."""
    shared = words.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part, codes in _by_length(texts):
                step = max(1, BYTES // (8 * (codes.shape[1] + 1)))
                for edit, rows, places, new in _edits(codes, letters, shared.value):
                    for lo in range(0, len(rows), step):
                        cut = slice(lo, lo + step)
                        made = _spelled(codes, edit, rows[cut], places[cut], None if new is None else new[cut])
                        own = pa.array([texts[i] for i in part[rows[cut]]], pa.string())
                        yield pa.RecordBatch.from_arrays([own, pa.array(made, pa.string())], names=["word", "candidate"])

    return words.select("word").mapInArrow(tidy(run), "word string, candidate string")


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every pair of words that differ by one edit, from both ends."""
    found = candidates(words, alphabet(words), word_filter(words))
    return found.join(words.select(F.col("word").alias("candidate"), F.col("n").alias("near_n")), "candidate").select("word", F.col("candidate").alias("near"), "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (columns word, form), by doubling steps."""
    now = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("more")), "roots")
    while now.filter("more").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "roots")
        discard(now)
        now = new
    return now.select("word", "root")


def _few_files(words: DataFrame) -> DataFrame:
    """A table of words dealt out to as many files as it fills, not one for each shuffle partition.

    Hadoop starts `chmod` on an executor for each local file, which for an instant shows as a second JVM of its size.
    """
    spark = words.sparkSession
    n = spread(spark, words)
    return words.repartition(min(n, max(spark.sparkContext.defaultParallelism, n // A_FILE)))


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    spark: SparkSession = docs.sparkSession
    words = materialise(_few_files(vocabulary(docs)), "words")
    dealt = words.repartition(spread(spark, words), "word")
    best = near_words(dealt).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    all_words = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
    held = all_words.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    held = materialise(_few_files(held), "variants")
    roots = _roots(held.filter("form is not null"))
    return held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = f"""
with crc as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i)) as t
),
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_RUNS}')) as run from documents
),
counted as (select id, run, count(*) as c from runs where length(run) >= {LEAST_LENGTH} group by all),
spelled as (select *, hex(encode(id || ':' || run)) as x from counted),
hashed as (
  select run, c, xor(list_reduce(
    list_transform(range(length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295), 4294967295) as h
  from spelled, crc
),
damaged as (select case when h % {DAMAGE} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, c from hashed),
words as materialized (select word, sum(c)::bigint as n from damaged group by 1 having length(word) >= {LEAST_LENGTH} and sum(c) >= {LEAST_COUNT}),
places as (select word, unnest(range(length(word) + 1))::int as i from words),
letters as (select distinct unnest(string_split(word, '')) as letter from words),
edits as (
  select word, left(word, i) || substr(word, i + 2) as near from places where i < length(word)
  union select word, left(word, i) || letter || substr(word, i + 2) from places, letters where i < length(word)
  union select word, left(word, i) || letter || substr(word, i + 1) from places, letters
),
near as (select e.word, v.word as near, v.n as near_n from edits e join words v on v.word = e.near and v.word <> e.word),
best as (select word, count(*) as n_near, min({{'less': -near_n, 'near': near}}) as b from near group by 1),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b.less >= {RATIO} * w.n then b.near end as form, case when -b.less >= {RATIO} * w.n then -b.less end as form_n
  from words w left join best using (word)
),
ways as (
  with recursive way(word, root, form) as (
    select word, word, form from formed
    union all
    select y.word, f.word, f.form from way y join formed f on f.word = y.form
  )
  select word, root from way where form is null
)
select word, form, root, n, n_near, form_n from formed join ways using (word)
"""
