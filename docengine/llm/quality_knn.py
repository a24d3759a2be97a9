"""Quality scores by nearest-neighbour voting in a latent-semantic space (operator 3).

Terms of a text are its folded words, its words' shapes (runs of upper case, lower case, digits and each
punctuation mark) and a mark for a word that repeats the one before.  A bounded sample of labelled texts
gives a tf-idf matrix over its most frequent terms, which Spark counts; the driver gets these terms and the
sample's counts of them, SAMPLE x VOCABULARY entries of six bytes at most, whatever the texts' lengths.  The
matrix's leading right singular vectors (randomised subspace iteration) span the space.
The sample's unit vectors are broadcast (SAMPLE x RANK floats at most); every document's exact cosines to
all of them are one blocked product; its NEIGHBOURS nearest vote with their labels, weighted by similarity.

Defined results: null and empty texts, and texts without a learned term, score EMPTY_SCORE; labels for
unknown documents, null labels and held-out rows are not learned from; with no labels all scores are
EMPTY_SCORE; a document with several label rows counts once for each; equal similarities go to the lower
row of the sample, which is ordered by a hash of doc_id, then doc_id, label and text; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, held_out_expr, lut, materialise, span_hashes, text_slices, word_spans

#: Labelled texts of each label that the model may use; vocabulary; dimensions; voters.
SAMPLE_PER_LABEL, VOCABULARY, RANK, NEIGHBOURS = 2048, 8192, 64, 15
EMPTY_SCORE = 0.0
_REPEAT = np.uint64(0x5265706561742021)

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 85
_CLASS[97:123] = 76
_CLASS[128:] = 76
_CLASS[48:58] = 68


def shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its classes with runs collapsed."""
    cls = _CLASS[data]
    keep = np.ones(len(cls), bool)
    keep[1:] = cls[1:] != cls[:-1]
    keep[starts] = True
    at = np.flatnonzero(keep)
    return span_hashes(cls[at], np.searchsorted(at, starts), np.searchsorted(at, ends))


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of every occurrence in a slice."""
    starts, ends, first = word_spans(data, offsets, lut("space"))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    words = span_hashes(LOWER[data], starts, ends)
    shapes = shape_hashes(data, starts, ends) ^ np.uint64(0x5348415045)
    same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    twice = np.flatnonzero(same) + 1
    thrice = np.flatnonzero(same[1:] & same[:-1]) + 2
    marks = np.concatenate([np.full(len(twice), _REPEAT, np.uint64), np.full(len(thrice), _REPEAT + np.uint64(1), np.uint64)])
    return np.concatenate([doc, doc, doc[twice], doc[thrice]]), np.concatenate([words, shapes, marks])


def _count_terms(batches):
    """The first two columns, then each text's distinct terms and their counts."""
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch, "text"):
            doc, term = term_hashes(data, offsets)
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(doc) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(doc)))
            bounds = np.searchsorted(doc[at], np.arange(hi - lo + 1)).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(term[at].view(np.int64), pa.int64()))
            counts = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(n, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), terms, counts], names=["place", "label", "terms", "counts"])


def _known_terms(shared):
    """place, label, the numbers of a text's known terms (16 bits each) and their counts (as 32-bit floats)."""

    def run(batches):
        known = shared.value
        for batch in batches:
            numbers, weights = [], []
            for terms, counts in zip(batch.column(2), batch.column(3), strict=True):
                t, c = terms.values.to_numpy().view(np.uint64), counts.values.to_numpy()
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                ok = known[at] == t
                numbers.append(at[ok].astype(np.uint16).tobytes())
                weights.append(c[ok].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.binary()), pa.array(weights, pa.binary())], names=["place", "label", "numbers", "counts"])

    return run


class Model:
    """Term hashes (sorted), idf-weighted projection rows, and the sample's unit vectors with labels."""

    def __init__(self, terms, projection, vectors, labels, neighbours=NEIGHBOURS):
        self.terms, self.projection, self.vectors, self.labels, self.neighbours = terms, projection, vectors, labels, neighbours

    def embed(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n_docs, v = len(offsets) - 1, len(self.terms)
        out = np.zeros((n_docs, self.projection.shape[1]), np.float32)
        if not v:
            return out
        doc, term = term_hashes(data, offsets)
        at = np.minimum(np.searchsorted(self.terms, term), v - 1)
        known = self.terms[at] == term
        pairs, counts = np.unique(doc[known] * v + at[known], return_counts=True)
        doc, term = pairs // v, pairs % v
        weight = np.log1p(counts).astype(np.float32)
        for lo in range(0, len(pairs), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            d = doc[part]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            out[d[first]] += np.add.reduceat(self.projection[term[part]] * weight[part, None], first, axis=0)
        return unit(out)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        n, k = len(vectors), min(self.neighbours, len(self.labels))
        out = np.full(n, EMPTY_SCORE)
        if not k:
            return out
        for lo in range(0, n, 512):
            block = vectors[lo : lo + 512]
            sims = block @ self.vectors.T
            if k < sims.shape[1]:
                near = nearest(sims, k)
            else:
                near = np.broadcast_to(np.arange(k), (len(block), k))
            w = np.maximum(np.take_along_axis(sims, near, axis=1), 0).astype(float)
            total = w.sum(axis=1)
            vote = (w * self.labels[near]).sum(axis=1)
            out[lo : lo + 512] = np.where(total > 0, vote / np.maximum(total, 1e-12), EMPTY_SCORE)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def nearest(sims: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest values, in order of column; of equal values the lower columns."""
    near = np.sort(np.argpartition(-sims, k - 1, axis=1)[:, :k], axis=1)
    least = np.take_along_axis(sims, near, axis=1).min(axis=1)
    for i in np.flatnonzero((sims >= least[:, None]).sum(axis=1) > k).tolist():  # ties across the rim
        near[i] = np.sort(np.argsort(-sims[i], kind="stable")[:k])
    return near


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], terms: np.ndarray, df: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """A model from rows (label, numbers of terms, counts) and the terms (sorted hashes) with their document counts."""
    n = len(rows)
    if not n or not len(terms):
        return Model(np.zeros(0, np.uint64), np.zeros((0, rank), np.float32), np.zeros((0, rank), np.float32), np.zeros(0), neighbours)
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)
    x = np.zeros((n, len(terms)), np.float32)
    for i, (_, at, counts) in enumerate(rows):
        x[i, at] = np.log1p(counts) * idf[at]
    x = unit(x)
    k = min(rank, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((n, min(k + 16, n))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ np.linalg.qr(x @ q)[0])[0]
    right = np.linalg.svd(x @ q, full_matrices=False)[2][:k] @ q.T
    projection = np.ascontiguousarray((right * idf).T.astype(np.float32))
    return Model(terms, projection, unit((x @ right.T).astype(np.float32)), np.array([r[0] for r in rows], float), neighbours)


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """label, doc_id, text of at most ``per_label`` training rows of each of the labels 0 and 1, by order of a hash."""
    rows = labels.filter(f"not {held_out_expr()} and {label} in (0, 1)").select("doc_id", F.col(label).cast("long").alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = None
    for value in (0, 1):
        part = rows.filter(F.col("label") == value).orderBy(*order).limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_label rows: small by construction.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "doc_id", "text")


def train(docs: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY, rank: int = RANK, neighbours: int = NEIGHBOURS, **options) -> Model:
    spark = docs.sparkSession
    place = F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id", "label", F.xxhash64("text").alias("text"))
    counted = sample(docs, labels, **options).select(place.alias("place"), "label", "text").mapInArrow(_count_terms, "place struct<hash: long, doc_id: long, label: long, text: long>, label long, terms array<long>, counts array<long>")
    counted = materialise(counted.filter("size(terms) > 0"), "quality-sample")
    n = counted.count()
    # At most ``vocabulary`` terms, the most frequent by documents.
    best = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min(2, n)).orderBy(F.desc("df"), "term").limit(min(vocabulary, 1 << 16)).collect()
    found = sorted((r["term"] & (1 << 64) - 1, r["df"]) for r in best)
    terms, df = np.array([t for t, _ in found], np.uint64), np.array([d for _, d in found], np.int64)
    if not len(terms):
        return fit([], terms, df, rank, neighbours)
    known = counted.mapInArrow(_known_terms(spark.sparkContext.broadcast(terms)), "place struct<hash: long, doc_id: long, label: long, text: long>, label long, numbers binary, counts binary").collect()
    known.sort(key=lambda r: tuple((x is not None, x or 0) for x in r["place"]))
    return fit([(r["label"], np.frombuffer(r["numbers"], np.uint16), np.frombuffer(r["counts"], np.float32)) for r in known], terms, df, rank, neighbours)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.score(model.embed(data, offsets)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
