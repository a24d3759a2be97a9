"""Chat sessions as keyed state of a stream: append with a cap, touch, expiry by event-time timers.

The state of a session is its first and last time, its count of messages and the numbers of the last ``cap`` of them; a
micro-batch of one key of any size is taken frame by frame and never kept whole.  Each touch moves the session's one
timer; when the watermark passes it, the session is reported as expired and its state is gone.  State lives in RocksDB
and is checkpointed to the shared folder, so a query that is stopped or loses executors goes on where it was.

Rows without a key or time are left out, and so are those at or before the watermark, which are late; messages of one
time stand in order of their numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from docengine.sources.files import scratch

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds since 1970.
_OUT = "key long, created long, last_activity long, messages long, kept array<long>, expired boolean"


class ChatSessions(StatefulProcessor):
    def __init__(self, cap: int, idle_ms: int | None):
        self.cap, self.idle_ms = cap, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "created long, last long, messages long, timer long")
        self.kept = handle.getListState("kept", "at long, number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        created, last, messages, timer = self.session.get() if self.session.exists() else (None, None, 0, None)
        kept = [tuple(x) for x in self.kept.get()] if self.kept.exists() else []
        for frame in rows:
            at = frame["at"].to_numpy()
            created = int(at.min()) if created is None else min(created, int(at.min()))
            last = int(at.max()) if last is None else max(last, int(at.max()))
            messages += len(frame)
            kept = heapq.nlargest(self.cap, [*kept, *zip(at.tolist(), frame["number"].tolist(), strict=True)])
        kept.sort()
        if self.idle_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = last // 1000 + self.idle_ms + 1  # idle for longer than the limit
            self.handle.registerTimer(timer)
        self.session.update((created, last, messages, timer))
        self.kept.put(kept)
        yield self._row(key, created, last, messages, kept, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, last, messages, timer = self.session.get()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            kept = [tuple(x) for x in self.kept.get()]
            self.session.clear()
            self.kept.clear()
            yield self._row(key, created, last, messages, kept, True)

    @staticmethod
    def _row(key, created, last, messages, kept, expired) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "created": [created], "last_activity": [last], "messages": [messages], "kept": [[number for _, number in kept]], "expired": [expired]})

    def close(self) -> None:
        pass


def session_updates(messages: DataFrame, cap: int = 50, idle_hours: int | None = 24, late: str = "0 seconds") -> DataFrame:
    """A stream (key long, ts timestamp, number long) as a stream of sessions' new states."""
    good = messages.filter("key is not null and ts is not null").withWatermark("ts", late)
    rows = good.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    processor = ChatSessions(cap, None if idle_hours is None else idle_hours * 3_600_000)
    return rows.groupBy("key").transformWithStateInPandas(processor, _OUT, "Update", "EventTime")


@contextmanager
def rocks_state(spark: SparkSession):
    """State of the queries started inside is kept in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def advance(updates: DataFrame, out: str, checkpoint: str) -> None:
    """Work off what has come in, from the checkpoint on; a batch that is done again replaces its own folder."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with rocks_state(updates.sparkSession):
        query = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each session: key, created, last_activity, messages, kept, expired."""
    rows = spark.read.option("basePath", out).schema(f"{_OUT}, batch long").parquet(out)
    # In one batch a timer acts after the rows.
    now = rows.groupBy("key").agg(F.max_by(F.struct("created", "last_activity", "messages", "kept", "expired"), F.struct("batch", "expired")).alias("s"))
    return now.select("key", F.timestamp_micros("s.created").alias("created"), F.timestamp_micros("s.last_activity").alias("last_activity"), "s.messages", "s.kept", "s.expired")


def replay(rows: DataFrame, feeds: int = 3, **options) -> DataFrame:
    """A table (key, ts, number) fed in order of time, a slice at a time; after each slice the query ends and is started again from its checkpoint."""
    spark = rows.sparkSession
    base = scratch(spark, "sessions")
    timed = rows.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = timed.approxQuantile("_at", [i / feeds for i in range(1, feeds)], 0.01) if feeds > 1 else []
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        own = timed if low is None else timed.filter(F.col("_at") > int(low))
        own = own if high is None else own.filter(F.col("_at") <= int(high))
        own.drop("_at").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        advance(session_updates(stream, **options), f"{base}/out", f"{base}/checkpoint")
    return latest(spark, f"{base}/out")
