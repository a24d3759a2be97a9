"""Sessions and routing over `conversations` and `events`."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docengine.registry import ORACLES, query, table
from docengine.streaming import sessions as S
from docengine.streaming import stateful

_LAST = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)"


@query("z2_last_messages", f"SELECT conv_id, turn, role FROM {_LAST} WHERE n <= 3")
def last_messages(spark, sf):
    return S.last_messages(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role")


_PAIRS = f"""r AS (SELECT * FROM {_LAST} WHERE n <= 6), u AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usr FROM r),
p AS (SELECT conv_id, turn, usr, text AS assistant FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM u WHERE role = 'assistant' AND usr IS NOT NULL) WHERE k <= 3)"""


@query("z5_turn_pairs", f'WITH {_PAIRS} SELECT conv_id, turn, usr AS "user", assistant FROM p')
def turn_pairs(spark, sf):
    return S.turn_pairs(table(spark, sf, "conversations"))


@query("f26_message_list", f"WITH {_PAIRS} SELECT conv_id, 'system: help' || chr(10) || string_agg('user: ' || usr || chr(10) || 'assistant: ' || assistant, chr(10) ORDER BY turn) || chr(10) || 'user: q' AS messages FROM p GROUP BY conv_id")
def message_list(spark, sf):
    return S.message_list(table(spark, sf, "conversations"), "help", F.lit("q")).select("conv_id", F.array_join("messages", "\n").alias("messages"))


@query("z1_sessions", "SELECT user_id, min(ts) AS created, max(ts) AS last_activity, count(*)::BIGINT AS messages FROM events GROUP BY user_id")
def sessions(spark, sf):
    return S.sessions(table(spark, sf, "events"), "user_id", "ts")


@query("z3_expired", "WITH s AS (SELECT user_id, max(ts) AS l FROM events GROUP BY user_id) SELECT user_id FROM s WHERE l < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def expired(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    rows = S.sessions(e, "user_id", "ts").crossJoin(F.broadcast(now))
    return S.expired(rows, F.col("now")).select("user_id")


@query("z6_rate_limit", "WITH e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) - 1 AS i FROM events) SELECT user_id, event_id, round(max(t - i * 2.5::DOUBLE) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + i * 2.5::DOUBLE, 3) AS allowed_at FROM e")
def rate_limit(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return S.rate_limited(e, "user_id", "t", 2.5).select("user_id", "event_id", F.round("allowed_at", 3).alias("allowed_at"))


@query("z8_route", "WITH l AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, count(*) FILTER (WHERE role = 'tool') AS calls FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN calls >= 2 THEN 'answer' WHEN role = 'tool' THEN 'agent' WHEN role = 'assistant' AND contains(text, 'tool:') THEN 'tools' WHEN role = 'assistant' THEN 'end' ELSE 'agent' END AS next FROM l")
def route(spark, sf):
    return S.route(table(spark, sf, "conversations"))


@query("z9_summary_input", f"WITH c AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 4) SELECT conv_id, string_agg(role || ': ' || left(text, 200), chr(10) ORDER BY turn) AS text FROM {_LAST} WHERE n <= 10 AND conv_id IN (SELECT conv_id FROM c) GROUP BY conv_id")
def summary_input(spark, sf):
    return S.summary_input(table(spark, sf, "conversations"))


@query("z10_needs_analysis", r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 15 AS needed FROM conversations")
def needs_analysis(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.needs_analysis(F.col("text")).alias("needed"))


@query("z7_token_stream", "WITH l AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id AS answer_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE turn % 3 <> 1), '') AS text, coalesce(bool_or(turn = last AND turn % 3 <> 1), false) AS done FROM l GROUP BY conv_id HAVING count(*) FILTER (WHERE turn % 3 <> 1) > 0")
def token_stream(spark, sf):
    """Every third line is no JSON, and only the last message is done."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    line = F.to_json(F.struct(F.col("text").alias("response"), (F.col("turn") == last).alias("done")))
    rows = table(spark, sf, "conversations").withColumn("line", F.when(F.col("turn") % 3 == 1, F.lit('{"response": "cut o')).otherwise(line))
    return S.stream_text(rows.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"), "line"))


@query("z4_update_config", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 5 ELSE 10 END::INT AS top_k, CASE WHEN conv_id % 2 = 0 THEN 'long' ELSE 'short' END AS style FROM (SELECT DISTINCT conv_id FROM conversations)")
def update_config(spark, sf):
    """Given settings replace stored ones, the others stay."""
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    stored = c.select("conv_id", F.lit(10).alias("top_k"), F.lit("short").alias("style"))
    given = c.filter("conv_id % 2 = 0 or conv_id % 3 = 0").select("conv_id", F.expr("if(conv_id % 3 = 0, 5, null)").alias("top_k"), F.expr("if(conv_id % 2 = 0, 'long', null)").alias("style"))
    return S.updated(stored, given, "conv_id")


@query("z17_ensure_session", "SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'session-' || conv_id ELSE 'session-' || left(sha256(conv_id || '|2024'), 16) END AS session_id, conv_id % 2 = 1 AS created FROM conversations")
def ensure_session(spark, sf):
    """Known sessions are found, unknown ones made."""
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    known = c.filter("conv_id % 2 = 0").select("conv_id", F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("session_id"))
    return S.ensured(c, known, "conv_id", "2024")


@query("z13_history", "SELECT conv_id, count(*)::BIGINT AS messages, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS answers, coalesce(array_to_string(list_sort(list(DISTINCT 'src' || (turn % 3)) FILTER (WHERE role = 'assistant')), ','), '') AS sources FROM conversations GROUP BY conv_id")
def history(spark, sf):
    """A session's history with the sources its answers named."""
    named = F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("src"), (F.col("turn") % 3).cast("string"))))
    return S.history(table(spark, sf, "conversations").withColumn("sources", named))


@query("a17_session_stats", "SELECT count(DISTINCT conv_id)::BIGINT AS sessions, count(*)::BIGINT AS messages, round(count(*) / count(DISTINCT conv_id)::DOUBLE, 4) AS mean FROM conversations")
def session_stats(spark, sf):
    n = F.count_distinct("conv_id")
    return table(spark, sf, "conversations").agg(n.alias("sessions"), F.count("*").alias("messages"), F.round(F.count("*") / n, 4).alias("mean"))


def _messages(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("number"))


@query("z1_stateful", ORACLES["z1_sessions"])
def stateful_sessions(spark, sf):
    """The sessions of a stream kept as state, over restarts."""
    rows = stateful.replay(_messages(spark, sf), idle_hours=None)
    return rows.select(F.col("key").alias("user_id"), F.col("created").cast("timestamp_ntz").alias("created"), F.col("last_activity").cast("timestamp_ntz").alias("last_activity"), "messages")


@query("z3_stateful", ORACLES["z3_expired"])
def stateful_expired(spark, sf):
    """Sessions whose timer the watermark has passed and that no later message has opened again."""
    return stateful.replay(_messages(spark, sf), feeds=2).filter("expired").select(F.col("key").alias("user_id"))


@query("z2_stateful", ORACLES["z2_last_messages"])
def stateful_last(spark, sf):
    """The last messages of each conversation, held by the cap of its state."""
    talks = table(spark, sf, "conversations")
    rows = talks.select(F.col("conv_id").alias("key"), F.timestamp_seconds(F.col("turn") * 60 + 86400).alias("ts"), F.col("turn").alias("number"))
    kept = stateful.replay(rows, feeds=2, cap=3, idle_hours=None).select(F.col("key").alias("conv_id"), F.explode("kept").alias("turn"))
    return kept.join(talks.select("conv_id", "turn", "role"), ["conv_id", "turn"]).select("conv_id", "turn", "role")
