"""Chat sessions: batch forms as windows, streaming forms with event-time state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_messages(messages: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def turn_pairs(messages: DataFrame, window: int = 6, pairs: int = 3) -> DataFrame:
    """conv_id, turn, user, assistant: each assistant message with the latest user message before it."""
    recent = last_messages(messages, window)
    w = Window.partitionBy("conv_id").orderBy("turn")
    user = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = recent.withColumn("user", user).filter((F.col("role") == "assistant") & F.col("user").isNotNull())
    return last_messages(rows, pairs).select("conv_id", "turn", "user", F.col("text").alias("assistant"))


def sessions(messages: DataFrame, key: str, ts: str) -> DataFrame:
    """created, last_activity and messages of each session."""
    return messages.groupBy(key).agg(F.min(ts).alias("created"), F.max(ts).alias("last_activity"), F.count("*").alias("messages"))


def expired(session_rows: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Sessions idle for longer than the limit (Z3)."""
    return session_rows.filter(F.col("last_activity") < now - F.expr(f"interval {hours} hours"))


def rate_limited(calls: DataFrame, key: str, seconds: str, gap: float) -> DataFrame:
    """Adds ``allowed_at``: each call at least ``gap`` after the one before (Z6), as one running maximum."""
    w = Window.partitionBy(key).orderBy(seconds, "event_id")
    i = F.row_number().over(w) - 1
    rows = calls.withColumn("_i", i)
    running = F.max(F.col(seconds) - F.col("_i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("allowed_at", running + F.col("_i") * gap).drop("_i")


def route(messages: DataFrame, budget: int = 2) -> DataFrame:
    """conv_id, next: the step after the last message."""
    last = messages.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"), F.count_if(F.col("role") == "tool").alias("calls"))
    step = F.when(F.col("calls") >= budget, "answer").when(F.col("role") == "tool", "agent").when((F.col("role") == "assistant") & F.col("text").contains("tool:"), "tools").when(F.col("role") == "assistant", "end").otherwise("agent")
    return last.select("conv_id", step.alias("next"))


def summary_input(messages: DataFrame, more_than: int = 4, last: int = 10, chars: int = 200) -> DataFrame:
    """conv_id, text: what is summarised of conversations with more than four messages."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > more_than).select("conv_id")
    recent = last_messages(messages.join(n, "conv_id", "left_semi"), last)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", F.left("text", F.lit(chars))).alias("line"))))
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def needs_analysis(text: Column, words: int = 15) -> Column:
    """Short questions skip the analysis."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")) >= words


def message_list(messages: DataFrame, system: str, question: Column, turns: int = 3) -> DataFrame:
    """conv_id, messages: the system message, the last turns and the question."""
    history = turn_pairs(messages, 2 * turns, turns)
    rows = history.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "user", "assistant"))).alias("h"))
    pair = lambda x: F.array(F.concat(F.lit("user: "), x["user"]), F.concat(F.lit("assistant: "), x["assistant"]))
    return rows.select("conv_id", F.concat(F.array(F.lit(f"system: {system}")), F.flatten(F.transform("h", pair)), F.array(F.concat(F.lit("user: "), question))).alias("messages"))


def stream_text(lines: DataFrame, key: str = "answer_id", order: str = "seq") -> DataFrame:
    """Token lines (NDJSON with a response and a done flag) joined to texts; lines that are no JSON are passed over."""
    parsed = lines.select(key, order, F.from_json("line", "response string, done boolean, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("p")).filter("p is not null and p._bad is null")
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce("p.response", F.lit("")).alias("r"))))
    return parsed.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["r"]), "").alias("text"), F.max("p.done").alias("done"))


def updated(stored: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Stored settings with the non-null given ones in their place."""
    new = given.select(key, *(F.col(c).alias(f"_{c}") for c in given.columns if c != key))
    return stored.join(new, key, "left").select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in given.columns else F.col(c) for c in stored.columns if c != key))


def ensured(asked: DataFrame, known: DataFrame, key: str, created_at: str) -> DataFrame:
    """key, session_id, created: the stored session of a key, else a new one named by key and time."""
    made = F.concat(F.lit("session-"), F.left(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(created_at)), 256), F.lit(16)))
    return asked.select(key).distinct().join(known.select(key, "session_id"), key, "left").select(key, F.coalesce("session_id", made).alias("session_id"), F.col("session_id").isNull().alias("created"))


def history(messages: DataFrame) -> DataFrame:
    """conv_id, messages, answers and the distinct sources named by the answers."""
    named = F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("answers"), F.array_join(named, ",").alias("sources"))


def session_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream by gap, closed once the watermark passes (Z1, Z3): state ends with the session."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("messages")).select(key, F.col("w.start").alias("created"), F.col("w.end").alias("expires"), "messages")
