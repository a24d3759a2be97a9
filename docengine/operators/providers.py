"""External models behind an interface, with deterministic providers for tests."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(width: int = 64, blank: str | None = None) -> Embedder:
    """Feature hashing: a test provider that needs no model.  Only a text of white space has a zero vector.

    ``blank``: what counts as white space there; a text of other white space alone is one word.
    """

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            words = (t or "").lower().split() or [t][: bool((t or "").strip(blank))]
            hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in words]
            for h in hashes:
                v[h % width] += 1.0 if h >> 63 else -1.0
            if not any(v):  # words that cancel each other out count without their signs
                for h in hashes:
                    v[h % width] += 1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out

    return embed


def failing_on(mark: str, embedder: Embedder) -> Embedder:
    """A test provider that never answers for texts with this mark."""

    def embed(texts: list[str]) -> list[list[float]]:
        if any(mark in t for t in texts):
            raise OSError("no answer")
        return embedder(texts)

    return embed


def _tried(provider: Embedder, part: list[str], retries: int, wait: float) -> list | None:
    """The provider's answer, tried again after wait, 2 wait, 4 wait, ...; None if every attempt fails."""
    for attempt in range(retries):
        try:
            return provider(part)
        except OSError:
            if attempt < retries - 1:
                time.sleep(wait * 2**attempt)
    return None


def embed(df: DataFrame, text: str, provider: Embedder, batch: int = 32, retries: int = 3, out: str = "embedding", wait: float = 0.0) -> DataFrame:
    """Adds vectors in batches; each batch is retried, then the task fails and Spark re-runs it."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            done: list = []
            for lo in range(0, len(series), batch):
                found = _tried(provider, series.iloc[lo : lo + batch].fillna("").tolist(), retries, wait)
                if found is None:
                    raise OSError(f"no answer in {retries} attempts")
                done += found
            yield pd.Series(done)

    return df.withColumn(out, run(F.col(text)))


def embed_one_by_one(df: DataFrame, text: str, provider: Embedder, retries: int = 3, wait: float = 0.0, gap: float = 0.0, missing: list[float] | None = None, out: str = "embedding") -> DataFrame:
    """Adds a vector per row, at least ``gap`` seconds after the one before in a task; ``missing``, or null, where all attempts fail.

    I2 for queries (null), I1 for chunks (a zero vector).
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        last = 0.0
        for series in batches:
            done = []
            for value in series.fillna(""):
                time.sleep(max(0.0, last + gap - time.monotonic()))
                last = time.monotonic()
                found = _tried(provider, [value], retries, wait)
                done.append(missing if found is None else found[0])
            yield pd.Series(done, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def embed_at_rate(df: DataFrame, text: str, provider: Embedder, gap: float, lanes: int = 4, retries: int = 3, wait: float = 0.0, out: str = "embedding") -> DataFrame:
    """Adds a vector (null where all attempts fail) and ``called_at``: the calls of all tasks together are ``gap`` seconds apart.

    Time is cut into slots of ``gap``; of every ``lanes`` slots each task has the one of its number, and makes one call, or
    one attempt again, in a slot of its own.  A task that starts later, or is run again, takes the next of its slots; one
    that wakes too late for a slot leaves it out.  Machines' clocks have to agree to within half a slot.
    """
    began = time.time()
    declared = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{out} array<float>", "called_at double"])
    at = df.columns.index(text)

    def run(batches):
        lane, last = TaskContext.get().partitionId() % lanes, -1

        def slot():
            nonlocal last
            while True:
                last = max(last + 1, math.ceil(((time.time() - began) / gap - lane) / lanes))
                due = began + (last * lanes + lane) * gap
                time.sleep(max(0.0, due - time.time()))
                if time.time() < due + gap / 2:
                    return time.time()

        for batch in batches:
            found, stamps = [], []
            for value in batch.column(at).to_pylist():
                answer = None
                for attempt in range(retries):
                    stamps_at = slot()
                    answer = _tried(provider, [value or ""], 1, 0.0)
                    if answer is not None:
                        break
                    time.sleep(wait * 2**attempt)
                found.append(None if answer is None else answer[0])
                stamps.append(stamps_at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32())), pa.array(stamps, pa.float64())], names=[*batch.schema.names, out, "called_at"])

    # As many tasks as lanes: the rows are dealt evenly, and no two tasks share a lane.
    return df.repartition(lanes).mapInArrow(run, declared)


def embed_distinct(df: DataFrame, text: str, provider: Embedder, width: int, out: str = "embedding", **options) -> DataFrame:
    """Each distinct text is embedded once (I1's memo); a zero vector where the provider fails."""
    once = embed_one_by_one(df.select(F.col(text).alias("_text")).distinct(), "_text", provider, missing=[0.0] * width, out=out, **options)
    return df.join(once, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def available(wanted: list[str], listed: list[str]) -> list[str]:
    """The wanted models that a server lists, by full name or without the tag."""
    names = {*listed, *(x.split(":")[0] for x in listed)}
    return [w for w in wanted if w in names]


def rerank_text(title: Column, keywords: Column, content: Column) -> Column:
    """The text a cross-encoder sees."""
    return F.concat_ws("\n", title, F.concat(F.lit("keywords: "), F.array_join(keywords, ", ")), content)


def rerank(df: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] | None = None, query: str = "query", text: str = "text") -> DataFrame:
    """Adds rerank_score; without a model it is the fused score."""
    if scorer is None:
        return df.withColumn("rerank_score", F.col("rrf_score"))

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), t.tolist()))

    return df.withColumn("rerank_score", run(F.col(query), F.col(text)))


def generate(df: DataFrame, provider: Callable[[list[str]], list[str]], prompt: str = "prompt", out: str = "answer") -> DataFrame:
    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(provider(p.fillna("").tolist()))

    return df.withColumn(out, run(F.col(prompt)))
