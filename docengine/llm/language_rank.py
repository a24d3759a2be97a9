"""Language identification by rank-order profiles (operator 6).

A profile is the PROFILE most frequent character n-grams (1 to 3 letters, words padded by one blank) in
order of frequency.  A document's own most frequent n-grams are compared to each language's profile by
out-of-place distance: how far each n-gram is from its place there, PROFILE if it is absent.

Profiles are counted over all training rows: n-gram counts are summed per task in bounded memory, then per
language, and each task of the sums keeps a language's first PROFILE before they are ranked in one place.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where no language was
learned; rows with a null lang are not learned from; equal distances go to the language first in
alphabetical order; repeated rows count again and are each predicted; an empty table gives no rows; other
columns are ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out_expr, mix64, tidy

PROFILE = 400
SIZES = (1, 2, 3)
#: Code points and documents of one vectorised step.
SLICE_CHARS, SLICE_ROWS = 1 << 18, 2048
#: N-grams that a task holds while it counts (16 bytes each, and as much again while they are merged).
HELD_GRAMS = 1 << 22
#: keep_known() rejects what scores less.
LEAST_SCORE = 0.05

_CODE_BITS = 44
_CODE_MASK = np.int64((1 << _CODE_BITS) - 1)


def _slices(texts: list[str]):
    lo, held = 0, 0
    for i, text in enumerate(texts):
        if i > lo and (held + len(text) > SLICE_CHARS or i - lo >= SLICE_ROWS):
            yield lo, i
            lo, held = i, 0
        held += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def _letter_codes(chars: np.ndarray) -> np.ndarray:
    """A code of each distinct letter; 0 for what is no letter."""
    letter = np.fromiter((chr(c).isalpha() for c in chars), bool, len(chars))
    return np.where(letter, mix64(chars.astype(np.uint64) + np.uint64(77)), np.uint64(0))


def _hashed(parts: list[np.ndarray]) -> np.ndarray:
    """n-gram codes from the codes of their letters."""
    h = np.full(len(parts[0]), np.uint64(len(parts)))
    for codes in parts:
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes
    return mix64(h) >> np.uint64(64 - _CODE_BITS)


def gram_code(gram: str) -> int:
    """The code by which profiles know an n-gram."""
    return int(_hashed([_letter_codes(np.array([ord(c)])) for c in gram])[0])


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram code, count), ordered by document and code. Texts without letters have no rows."""
    line = " " + " ".join(t.lower() for t in texts) + " "
    chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    distinct, place = np.unique(chars, return_inverse=True) if len(chars) < 4096 else _distinct(chars)
    codes = _letter_codes(distinct)[place]
    blank = codes == 0
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    doc = np.concatenate([[0], doc]).astype(np.int64)[: len(chars)]
    keys = []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = _hashed([codes[k : k + m] for k in range(n)])
        # Blanks only at the rim, and some letter between: the n-grams of padded words.
        good = ~blank[:m] if n == 1 else ~(blank[:m] & blank[1 : m + 1]) if n == 2 else np.logical_and.reduce([~blank[k : k + m] for k in range(1, n - 1)])
        at = np.minimum(np.arange(m) + (n - 1 if n > 1 else 0), len(doc) - 1)
        own = doc[at] if n > 1 else doc[:m]
        # An n-gram that starts in the separator before a text belongs to that text.
        keys.append((own[good] << _CODE_BITS) | h[good].astype(np.int64))
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    if not len(keys):
        return keys, keys, keys
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys >> _CODE_BITS, keys & _CODE_MASK, counts


def _distinct(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct code points and the place of each, by a table instead of a sort."""
    seen = np.zeros(int(chars.max()) + 1, bool)
    seen[chars] = True
    distinct = np.flatnonzero(seen)
    where = np.zeros(len(seen), np.int32)
    where[distinct] = np.arange(len(distinct))
    return distinct, where[chars]


def _sum_grams(batches):
    """lang, code, n of the rows of a task; a code may come again, as at most HELD_GRAMS are held at a time."""
    held: dict[str, list] = {}

    def merge(parts):
        codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

    def emptied():
        for lang in sorted(held):
            codes, n = merge(held[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for lo, hi in _slices(texts):
            doc, code, n = gram_counts(texts[lo:hi])
            for lang in sorted(set(langs[lo:hi])):
                own = (langs[lo:hi] == lang)[doc] if len(doc) else np.zeros(0, bool)
                parts = held.setdefault(lang, [])
                parts.append((code[own], n[own]))
                if len(parts) > 16:
                    held[lang] = [merge(parts)]
            if sum(len(codes) for parts in held.values() for codes, _ in parts) > HELD_GRAMS:
                for lang in held:
                    held[lang] = [merge(held[lang])]
                # Still over half: the grams are distinct ones, which the shuffle has to sum up.
                if 2 * sum(len(parts[0][0]) for parts in held.values()) > HELD_GRAMS:
                    yield from emptied()
    yield from emptied()


def train(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, code, place (from 0): the profiles learned from rows with a lang (columns text, lang)."""
    sums = docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(tidy(_sum_grams), "lang string, code long, n long")
    totals = sums.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # A filter on the row number itself lets each task keep its own first rows before the shuffle by language.
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return totals.withColumn("number", number).filter(F.col("number") <= size).select("lang", "code", (F.col("number") - 1).alias("place"))


class Profiles:
    """Languages, the sorted codes of all profiles, and each language's place of each code (size: absent)."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.array(sorted({r[1] for r in rows}), np.int64)
        self.places = np.full((len(self.langs), len(self.codes) + 1), size, np.int32)
        number = {lang: i for i, lang in enumerate(self.langs)}
        for lang, code, place in rows:
            self.places[number[lang], np.searchsorted(self.codes, code)] = place

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        texts = [t or "" for t in texts]
        for lo, hi in _slices(texts):
            doc, code, n = gram_counts(texts[lo:hi])
            if not len(doc):
                continue
            # Most frequent first, then by code: rows already stand in order of code.
            order = np.lexsort((-n, doc))
            doc, code = doc[order], code[order]
            first = np.searchsorted(doc, np.arange(hi - lo + 1))
            rank = np.arange(len(doc)) - first[doc]
            top = rank < self.size
            doc, code, rank = doc[top], code[top], rank[top]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            at = np.where(self.codes[at] == code, at, len(self.codes))
            grams = np.bincount(doc, minlength=hi - lo)
            sums = []
            for places in self.places:
                p = places[at]
                sums.append(np.bincount(doc, np.where(p == self.size, self.size, np.abs(p - rank)), hi - lo))
            far = np.stack(sums)
            best = far.argmin(axis=0)
            for i in np.flatnonzero(grams).tolist():
                langs[lo + i] = self.langs[best[i]]
                scores[lo + i] = float(1 - far[best[i], i] / (self.size * grams[i]))
        return langs, scores


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles on the driver: at most ``size`` rows a language."""
    return Profiles([tuple(r) for r in train(docs, size).collect()], size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every document (columns doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE) -> DataFrame:
    """The documents of a known language, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(f"not {held_out_expr()}").select("text", "lang")
