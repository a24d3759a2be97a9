"""Paired statistics, keyword tables, partition-wise stores, mixed encodings and one rate for all tasks."""

from pyspark.sql import functions as F

from docengine.operators import evaluate as E
from docengine.operators import keywords, providers, statistics
from docengine.plans import agent
from docengine.queries.aggregates import _KW, _L, _Q, _answers, _quality
from docengine.queries.search import _unsteady
from docengine.registry import ORACLES, query, table
from docengine.sources import files, keyed

# Of the error function: a series of positive terms. Of Student's quantile: Cornish and Fisher's expansion about z.
_Z = 1.959963984540054
_T = f"({_Z} + ({_Z}**3 + {_Z}) / 4 / f + (5 * {_Z}**5 + 16 * {_Z}**3 + 3 * {_Z}) / 96 / f**2 + (3 * {_Z}**7 + 19 * {_Z}**5 + 17 * {_Z}**3 - 15 * {_Z}) / 384 / f**3)"


@query(
    "a16_signed_rank",
    f"""WITH q AS (SELECT round(0.7::DOUBLE * {_KW} + 0.3::DOUBLE * {_L}, 2) - round({_Q}, 6) AS d0 FROM documents), d AS (SELECT round(d0, 9) AS d FROM q WHERE d0 IS NOT NULL),
m AS (SELECT count(*) AS n, count(*) FILTER (WHERE d > 0) AS improved, count(*) FILTER (WHERE d < 0) AS worsened, avg(d) AS gain, stddev_samp(d) AS spread FROM d),
r AS (SELECT d, (rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE) AS r FROM d WHERE d <> 0),
w AS (SELECT sum(r) FILTER (WHERE d > 0) AS w_plus, sum(r) AS s, sum(r * r) AS ss FROM r),
x AS (SELECT *, least(abs(w_plus - s / 2) / sqrt(ss / 2), 6) AS x, (n - 1)::DOUBLE AS f FROM m, w),
e AS (SELECT *, 1 - 2 / sqrt(pi()) * exp(-x * x) * list_reduce(list_transform(range(1, 300), lambda k: {{'t': k::DOUBLE, 's': 0::DOUBLE}}), lambda a, b: {{'t': a.t * 2 * x * x / (2 * b.t + 1), 's': a.s + a.t * 2 * x * x / (2 * b.t + 1)}}, {{'t': x, 's': x}}).s AS p FROM x)
SELECT n, improved, worsened, round(gain, 6) AS gain, round(w_plus, 1) AS w_plus, abs(round(p, 6)) AS p, round(gain - {_T} * spread / sqrt(n), 6) AS low, round(gain + {_T} * spread / sqrt(n), 6) AS high FROM e""",
)
def signed_rank(spark, sf):
    """Two ways of scoring every answer, as a paired run."""
    arms = E.response(_answers(spark, sf)).select("doc_id", F.col("quality_score").alias("after")).join(_quality(spark, sf).select("doc_id", F.col("quality").alias("before")), "doc_id")
    r = statistics.paired(arms, "before", "after")
    return r.select("n", "improved", "worsened", F.round("gain", 6).alias("gain"), F.round("w_plus", 1).alias("w_plus"), F.round("p", 6).alias("p"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("j5_keyword_table", r"WITH k AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\s+')) AS keyword FROM benchmark) SELECT doc_id, keyword FROM documents JOIN k ON contains(lower(text), keyword) WHERE length(keyword) >= 4")
def keyword_table(spark, sf):
    """Every document with every longer word of the benchmark that it contains."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("keyword")).filter(F.length("keyword") >= 4)
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return keywords.containing(docs, "doc_id", "t", words).withColumnRenamed("id", "doc_id")


@query("k6_upsert_parts", ORACLES["k6_upsert"])
def upsert_parts(spark, sf):
    """The even events are stored, the odd ones upserted; only the parts of their keys are written again."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    path = files.scratch(spark, "keyed")
    keyed.create(keyed.latest(e.filter("event_id % 2 = 0"), "user_id", "event_id"), path, "user_id", 16)
    keyed.upsert(spark, path, e.filter("event_id % 2 = 1"), "event_id")
    return keyed.read(spark, path)


@query("k4_delete_parts", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def delete_parts(spark, sf):
    path = files.scratch(spark, "keyed")
    keyed.create(table(spark, sf, "documents").select("doc_id", "source"), path, "doc_id", 16)
    keyed.delete(spark, path, table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")))
    return keyed.read(spark, path)


@query("s7_mixed_encodings", "SELECT doc_id, text FROM documents")
def mixed_encodings(spark, sf):
    """A folder of UTF-8 and UTF-16 files of both orders, each read in its own encoding."""
    path, d = files.scratch(spark, "mixed"), table(spark, sf, "documents").select("doc_id", "text")
    for i, encoding in enumerate(("UTF-8", "UTF-16LE", "UTF-16BE")):
        d.filter(F.col("doc_id") % 3 == i).write.mode("append").option("encoding", encoding).option("lineSep", "\n").json(path)
    return files.read_detected(spark, path, "doc_id long, text string")


@query("i2_embed_at_rate", ORACLES["i2_embed_queries"])
def embed_at_rate(spark, sf):
    """Queries embedded by several tasks at one rate for all of them."""
    rows = providers.embed_at_rate(table(spark, sf, "benchmark"), "text", _unsteady, gap=0.01, retries=2)
    return rows.select("item_id", F.col("embedding").isNotNull().alias("embedded"))


_ROUTE = "CASE WHEN calls >= 2 THEN 'answer' WHEN role = 'tool' THEN 'agent' WHEN role = 'assistant' AND contains(s.text, 'tool:') THEN 'tools' WHEN role = 'assistant' THEN 'end' ELSE 'agent' END"


@query(
    "z20_agent_loop",
    f"""WITH RECURSIVE s AS (SELECT conv_id, 0 AS step, role, text, 0 AS calls, false AS done FROM conversations WHERE turn = 0
UNION ALL SELECT conv_id, step + 1, CASE go WHEN 'tools' THEN 'tool' ELSE 'assistant' END,
 CASE go WHEN 'tools' THEN 'found ' || coalesce(len, 0) WHEN 'answer' THEN 'final ' || length(text) ELSE CASE WHEN length(text) % 2 = 0 THEN 'tool: ' || (length(text) % 97) WHEN length(text) % 3 = 0 THEN 'tool: none' ELSE 'reply ' || length(text) END END,
 calls + CASE go WHEN 'tools' THEN 1 ELSE 0 END, go = 'answer'
 FROM (SELECT s.*, {_ROUTE} AS go, length(d.text) AS len FROM s LEFT JOIN documents d ON s.text = 'tool: ' || d.doc_id WHERE NOT done) WHERE go <> 'end')
SELECT conv_id, step, role, text FROM s WHERE step > 0""",
)
def agent_loop(spark, sf):
    """Every conversation's first message answered by a loop of agent, look-ups of documents and a budget of two."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("tool: "), "doc_id").alias("text"), F.length("text").cast("string").alias("n"))

    def reply(texts):
        return [f"tool: {len(t) % 97}" if len(t) % 2 == 0 else "tool: none" if len(t) % 3 == 0 else f"reply {len(t)}" for t in texts]

    def look_up(calls):
        return calls.join(docs, "text", "left").select("conv_id", F.concat(F.lit("found "), F.coalesce("n", F.lit("0"))).alias("result"))

    first = table(spark, sf, "conversations").filter("turn = 0")
    return agent.run(first, reply, look_up, lambda texts: [f"final {len(t)}" for t in texts])
