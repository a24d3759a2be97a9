"""Vector best-fit packing of documents into sequences (operator 7).

A piece demands a vector (tokens, one document, attention cost = tokens squared); a sequence has a
residual of each.  Pieces are taken longest first; of the sequences that can hold a piece under every
constraint, the best by the rule gets it: the smallest weighted norm of what would be left
(``residual_norm``) or the largest weighted dot product of demand and residual (``dot_product``).

Packing works on shards of about SHARD_PIECES pieces dealt by a hash of the piece's row, so a task is
bounded at any corpus size; a shard leaves at most a few sequences partly filled.

Defined results: null and empty texts are one separator id; repeated rows are packed each; ties go to
the sequence opened first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialise, tidy

CAPACITY, SEPARATOR_ID = 2048, 0
SHARD_PIECES = 20_000
#: With these two a sequence of 2048 one-id documents and one of a single 2048-id document both fit.
MAX_DOCUMENTS, MAX_ATTENTION = CAPACITY, CAPACITY * CAPACITY
WEIGHTS = (1.0, 0.01, 0.05)


def _pieces(path: str, capacity: int, separator: int):
    tail = np.array([separator], "<u4").tobytes()

    def run(batches):
        for batch in batches:
            rows, doc_ids = [], batch.column(0).to_pylist()
            for row, ids in tokens.encoded(batch, path):
                data, doc_id = ids.astype("<u4").tobytes() + tail, doc_ids[row]
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR_ID, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: only texts over the capacity are cut."""
    run = _pieces(vocabulary or tokens.vocabulary_path(), capacity, separator)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_attention: float = MAX_ATTENTION, weights=WEIGHTS, rule: str = "residual_norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece. Raises if a piece alone breaks a constraint."""
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    caps = np.array([capacity, max_documents, max_attention], float)
    w = np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    if n and (lengths.max() > capacity or float(lengths.max()) ** 2 > max_attention or max_documents < 1):
        raise ValueError("a piece is larger than a sequence may be")
    least = int(lengths.min()) if n else 0
    room = np.zeros((256, 3))  # residuals of sequences that can still take something
    names = np.zeros(256, np.int64)
    used, opened = 0, 0
    for i in order.tolist():
        demand = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        left = room[:used] - demand
        fits = np.flatnonzero((left >= 0).all(axis=1)) if used else np.zeros(0, np.int64)
        if len(fits):
            if rule == "dot_product":
                best = fits[np.argmax(((room[fits] / caps) * (demand / caps)) @ w)]
            elif rule == "residual_norm":
                best = fits[np.argmin(((left[fits] / caps) ** 2) @ w)]
            else:
                raise ValueError(rule)
        else:
            if used == len(room):
                room, names = np.vstack([room, np.zeros_like(room)]), np.concatenate([names, np.zeros_like(names)])
            best = used
            room[best], names[best] = caps, opened
            used, opened = used + 1, opened + 1
        where[i], offset[i] = names[best], capacity - int(room[best, 0])
        room[best] -= demand
        if room[best, 0] < least or room[best, 1] < 1 or room[best, 2] < float(least) ** 2:
            # Full: close it, keeping the order in which the others were opened.
            room[best : used - 1], names[best : used - 1] = room[best + 1 : used].copy(), names[best + 1 : used].copy()
            used -= 1
    return where, offset


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_attention: float = MAX_ATTENTION, weights=WEIGHTS, rule: str = "residual_norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length``."""
    rows = materialise(piece_rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n_shards = max(1, -(-rows.count() // shard_pieces))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", kind="stable")
        where, offset = best_fit(frame["length"].to_numpy(np.int64), capacity, max_documents, max_attention, weights, rule)
        frame["sequence_id"] = (frame["_shard"].to_numpy(np.int64) << 32) + where
        frame["offset"] = offset
        return frame[[*columns, "sequence_id", "offset"]]

    columns = [f.name for f in piece_rows.schema.fields]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in piece_rows.schema.fields)
    sharded = rows.withColumn("_shard", F.expr(f"pmod(xxhash64(_row), {n_shards}L)"))
    return sharded.groupBy("_shard").applyInPandas(one, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    capacity = options.get("capacity", CAPACITY)
    return pack(pieces(docs, capacity, vocabulary=vocabulary), **options)
