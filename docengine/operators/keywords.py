"""Texts joined with a table of keywords they contain, by one multi-pattern automaton."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the keywords of one automaton; a larger table is taken in blocks of so many, a scan each.
AUTOMATON_CHARS = 8_000_000


def _blocks(keywords: DataFrame):
    held, size = [], 0
    for (word,) in keywords.toLocalIterator():
        held.append(word)
        size += len(word)
        if size >= AUTOMATON_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def containing(texts: DataFrame, id_col: str, text: str, keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """id, keyword of every keyword that a text contains, once a row.

    As written: fold both sides before where case does not matter.  Null and empty keywords are in no text.
    """
    words = keywords.select(F.col(keyword).alias("w")).filter("w != ''").distinct()
    rows, out = texts.select(F.col(id_col).alias("id"), F.col(text).alias("t")).filter("t is not null"), None
    kind = rows.schema["id"].dataType.simpleString()
    for block in _blocks(words):
        shared = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, w in enumerate(shared.value):
                automaton.add_word(w, i)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    hits = {k for _, k in automaton.iter(t)}
                    at += [i] * len(hits)
                    found += [shared.value[k] for k in sorted(hits)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["id", "keyword"])

        part = rows.mapInArrow(run, f"id {kind}, keyword string")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.filter("false").select("id", F.lit("").alias("keyword"))
