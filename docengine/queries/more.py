"""Composed plans, round trips through files, hierarchy reports and result tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docengine.functions import dictionaries as D
from docengine.functions import sql
from docengine.operators import evaluate as E
from docengine.operators import fusion, hierarchy, lexical
from docengine.operators import sets as S
from docengine.plans import chat
from docengine.plans import retrieve as R
from docengine.queries.search import _BM25, _BOOST, _KNN, _RRF, _hybrid_inputs
from docengine.registry import ORACLES, query, table
from docengine.sources import files
from docengine.sources import html as X


_scratch = files.scratch


def _echo(prompts):
    return [str(len(p)) for p in prompts]


@query("k1_jsonl_round_trip", "SELECT doc_id, text FROM documents")
def jsonl(spark, sf):
    path = _scratch(spark, "jsonl")
    files.write_jsonl(table(spark, sf, "documents").select("doc_id", "text"), path)
    return files.read_jsonl(spark, path, "doc_id long, text string")


@query("k3_collection", "SELECT vec_id, label FROM embeddings")
def collection(spark, sf):
    path = _scratch(spark, "collection")
    files.write_collection(table(spark, sf, "embeddings"), path)
    return spark.read.parquet(path).select("vec_id", "label")


@query("k4_delete_by_id", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def delete(spark, sf):
    path = _scratch(spark, "collection")
    table(spark, sf, "embeddings").select("vec_id").write.parquet(path)
    return files.without(spark, path, table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id")


@query("k5_saved_index", f"WITH {_BM25} SELECT query_id, id, score FROM bmr WHERE rank <= 5")
def saved_index(spark, sf):
    path = _scratch(spark, "bm25")
    lexical.save(lexical.build(table(spark, sf, "documents"), "doc_id", lexical.document_tokens()), path)
    terms = lexical.query_terms(table(spark, sf, "benchmark"), "item_id", lexical.document_tokens())
    found = lexical.search(lexical.load(spark, path), terms).withColumn("score", F.round("score", 6))
    return fusion.top(found, 5).drop("rank")


@query("s13_by_keys", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def by_keys(spark, sf):
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return files.by_keys(table(spark, sf, "documents"), ids, "doc_id").select("doc_id", "lang")


@query("i27_simple_pipeline", f"WITH {_BM25}, {_KNN}, {_RRF}, {_BOOST} SELECT query_id, count(*)::BIGINT AS passages, sum(length(d.text))::BIGINT AS chars FROM rt JOIN documents d ON d.doc_id = rt.id GROUP BY query_id")
def simple_pipeline(spark, sf):
    return R.retrieve(*_hybrid_inputs(spark, sf)).groupBy("query_id").agg(F.count("*").alias("passages"), F.sum(F.length("content")).alias("chars"))


_ASKED = "CASE item_id % 5 WHEN 0 THEN '<b>' || text || '</b>' WHEN 1 THEN 'qqqq zzzz' ELSE text END"


@query("z12_chat", f"""WITH q AS (SELECT item_id, {_ASKED} AS text FROM benchmark)
SELECT item_id AS query_id, CASE WHEN regexp_matches(text, '(?is)<[^>]*>') THEN 'refused' WHEN item_id % 5 = 1 THEN 'fallback' ELSE 'answered' END AS status,
 CASE WHEN regexp_matches(text, '(?is)<[^>]*>') THEN 'Refused: HTML tags' WHEN item_id % 5 = 1 THEN '{chat.FALLBACK_ANSWER}' END AS told FROM q""")
def chat_plan(spark, sf):
    """Refused questions, those without any passage, and answered ones."""
    chunks, vectors, _, query_vectors = _hybrid_inputs(spark, sf)
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(_ASKED).alias("text"))
    found = R.retrieve(chunks, vectors, questions, query_vectors.filter("query_id % 5 != 1"))
    contexts = R.context(found).join(found.groupBy("query_id").agg(F.max("low_confidence").alias("low_confidence")), "query_id")
    return chat.answers(questions, contexts, _echo).select("query_id", "status", F.when(F.col("status") != "answered", F.col("answer")).alias("told"))


_SIMPLE = "CASE doc_id % 4 WHEN 0 THEN 'not available' WHEN 1 THEN text WHEN 2 THEN left(text, 20) END"
_AGENT = "CASE doc_id % 3 WHEN 0 THEN 'the ' || text WHEN 1 THEN 'no' ELSE left(text, 100) END"


def _arm(a: str) -> str:
    raw = f"(0.7 * CASE WHEN contains(lower(coalesce({a}, '')), 'the') THEN 1 ELSE 0 END + 0.3 * least(1, length(coalesce({a}, '')) / 200.0::DOUBLE))"
    fallback = " OR ".join(f"contains(lower(coalesce({a}, '')), '{p.replace(chr(39), chr(39) * 2)}')" for p in D.FALLBACK_PHRASES)
    return f"round({raw}, 2) AS q, {raw} >= 0.8 AND length(coalesce({a}, '')) >= 200 AND NOT ({fallback}) AS ok"


@query("z15_best_of", f"WITH s AS (SELECT doc_id, {_arm(_SIMPLE)} FROM documents), a AS (SELECT doc_id, {_arm(_AGENT)} FROM documents WHERE doc_id % 7 <> 0) SELECT s.doc_id AS query_id, NOT s.ok AND coalesce(a.q, -1) > s.q AS used_fallback FROM s LEFT JOIN a USING (doc_id)")
def best_of(spark, sf):
    """Two different arms, one of which may be missing."""
    d = table(spark, sf, "documents")
    words = d.select(F.col("doc_id").alias("query_id"), F.array(F.lit("the")).alias("keywords"))
    simple = d.select(F.col("doc_id").alias("query_id"), F.expr(_SIMPLE).alias("answer"))
    agent = d.filter("doc_id % 7 != 0").select(F.col("doc_id").alias("query_id"), F.expr(_AGENT).alias("answer"))
    return chat.best_of(simple, agent, words).select("query_id", "used_fallback")


@query("x22_crawl_cycles", """WITH RECURSIVE n AS (SELECT max(doc_id) + 1 AS n FROM documents), l AS (SELECT doc_id AS a, (doc_id * 2 + 1) % n AS b FROM documents, n UNION SELECT doc_id, (doc_id * 3) % n FROM documents, n UNION SELECT doc_id, doc_id FROM documents),
t AS (SELECT 1::BIGINT AS u, 0 AS hops UNION SELECT l.b, t.hops + 1 FROM t JOIN l ON l.a = t.u WHERE t.hops < 60), m AS (SELECT u, min(hops) AS hops FROM t GROUP BY u)
SELECT 'p' || u AS url, hops::INT AS hops FROM m ORDER BY hops, url LIMIT 1000""")
def crawl_cycles(spark, sf):
    """Pages that link in cycles and to themselves, and several ways to a page."""
    d = table(spark, sf, "documents").select("doc_id").crossJoin(F.broadcast(table(spark, sf, "documents").agg((F.max("doc_id") + 1).alias("n"))))
    ways = F.explode(F.array((F.col("doc_id") * 2 + 1) % F.col("n"), (F.col("doc_id") * 3) % F.col("n"), F.col("doc_id"))).alias("b")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    links = d.select("doc_id", ways).select(name("doc_id").alias("url"), name("b").alias("target"))
    return hierarchy.crawl(links, "p1")


@query("x22_crawl", "SELECT 'p' || doc_id::VARCHAR AS url, (length(bin(doc_id + 1)) - 1)::INT AS hops FROM documents WHERE doc_id < 127")
def crawl(spark, sf):
    d = table(spark, sf, "documents").filter("doc_id between 1 and 126").select("doc_id")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    links = d.select(name(F.floor((F.col("doc_id") - 1) / 2)).alias("url"), name(F.col("doc_id")).alias("target"))
    return hierarchy.crawl(links, "p0")


@query("x22_crawl_all", "SELECT 'p' || doc_id::VARCHAR AS url, (length(bin(doc_id + 1)) - 1)::INT AS hops FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY hops, url LIMIT 1000")
def crawl_all(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    links = d.select(name(F.floor((F.col("doc_id") - 1) / 2)).alias("url"), name(F.col("doc_id")).alias("target"))
    return hierarchy.crawl(links, "p0")


_TITLE_SQL = r"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '')"


@query("x23_page_document", rf"""WITH p AS (SELECT page_id, url, coalesce({_TITLE_SQL.format(t='h1')}, {_TITLE_SQL.format(t='title')}, '') AS title, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*/?$', '') AS parent_url, CASE WHEN contains(url, '#') THEN split_part(url, '#', 2) END AS anchor,
 len(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/'), lambda x: x <> ''))::INT AS depth FROM pages)
SELECT page_id, url, title, parent_url, depth, title AS section_path, anchor FROM p""")
def page_document(spark, sf):
    """The fields of a page taken as one document; its content is x15_main_lines."""
    u = F.col("url")
    title = X.title(F.col("html"))
    return table(spark, sf, "pages").select("page_id", "url", title.alias("title"), X.parent_url(u).alias("parent_url"), X.url_depth(u).alias("depth"), title.alias("section_path"), X.anchor_of(u).alias("anchor"))


_DIFF = """WITH n AS (SELECT (SELECT count(DISTINCT doc_id) FROM labels)::BIGINT AS reference, (SELECT count(DISTINCT doc_id) FROM documents)::BIGINT AS found, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))::BIGINT AS shared, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))::BIGINT AS missing)
SELECT *, round(100.0::DOUBLE * shared / reference, 4) AS coverage, 100.0 * shared / reference >= 95 AS enough, 'coverage ' || printf('%.2f', 100.0::DOUBLE * shared / reference) || '%, ' || CASE WHEN 100.0 * shared / reference >= 95 THEN 'at or above' ELSE 'below' END || ' the threshold of 95%; ' || missing || ' documents missing' AS summary FROM n"""


@query("h4_diff_report", _DIFF)
def diff_report(spark, sf):
    """The report with its summary sentence, saved as JSON and read back."""
    report = S.diff_report(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")
    path = _scratch(spark, "diff")
    files.write_json_array(report, path)
    return files.read_json_array(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in report.schema.fields))


@query("k2_json_array", "SELECT doc_id, text, source FROM documents")
def json_array(spark, sf):
    path = _scratch(spark, "array")
    files.write_json_array(table(spark, sf, "documents").select("doc_id", "text", "source"), path)
    return files.read_json_array(spark, path, "doc_id long, text string, source string")


@query("k8_chat_export", "SELECT conv_id, turn, role, text FROM conversations")
def chat_export(spark, sf):
    """Conversations exported as JSON, one object each, and imported again."""
    path = _scratch(spark, "chat")
    c = table(spark, sf, "conversations")
    files.write_json_array(c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")), path)
    back = files.read_json_array(spark, path, "conv_id long, messages array<struct<turn: long, role: string, text: string>>")
    return back.select("conv_id", F.explode("messages").alias("m")).select("conv_id", "m.turn", "m.role", "m.text")


@query("k11_collection_alias", "SELECT vec_id, label FROM embeddings WHERE vec_id % 3 IN (0, 1)")
def collection_alias(spark, sf):
    """A collection made, added to twice, and another one deleted, which leaves it empty."""
    root = _scratch(spark, "collections")
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    for name in ("docs", "gone"):
        files.create_collection(spark, root, name, e.schema)
    for k in (0, 1):
        files.add_documents(e.filter(F.col("vec_id") % 3 == k), root, "docs")
    files.add_documents(e, root, "gone")
    files.delete_collection(spark, root, "gone")
    return files.get_collection(spark, root, "docs").unionByName(files.get_collection(spark, root, "gone"))


@query("k7_report_files", "WITH r AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT '# Documents' AS line UNION ALL SELECT '| lang | n |' UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || lang || ' | ' || n || ' |' FROM r")
def report_files(spark, sf):
    """A report as Markdown (read back here) and as JSON."""
    path = _scratch(spark, "report")
    rows = table(spark, sf, "documents").filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    files.write_report(rows, path, "Documents")
    return spark.read.text(f"{path}/markdown").select(F.col("value").alias("line")).filter("line != ''")


@query("s10_texts", "SELECT DISTINCT 'lang=' || lang AS folder, count(*) OVER (PARTITION BY lang)::BIGINT AS n FROM documents WHERE lang IS NOT NULL")
def texts(spark, sf):
    """Texts saved under relative folders and read back, counted by folder."""
    path = _scratch(spark, "texts")
    d = table(spark, sf, "documents").filter("lang is not null")
    files.write_texts(d.select(F.concat(F.lit("lang="), "lang").alias("folder"), F.translate("text", "\n\r", "  ").alias("text")), path, "folder")
    back = spark.read.text(path)
    return back.groupBy("folder").agg(F.count("*").alias("n"))


@query("s7_encodings", "SELECT doc_id, text FROM documents")
def encodings(spark, sf):
    """JSON lines of UTF-16, whose encoding is found from the first bytes."""
    path = _scratch(spark, "utf16")
    table(spark, sf, "documents").select("doc_id", "text").write.option("encoding", "UTF-16LE").option("lineSep", "\n").json(path)
    return files.read_detected(spark, path, "doc_id long, text string")


@query("j8_self_join", "SELECT a.doc_id, b.lang AS parent_lang FROM documents a LEFT JOIN documents b ON a.doc_id // 2 = b.doc_id")
def self_join(spark, sf):
    d = table(spark, sf, "documents")
    b = d.select(F.col("doc_id").alias("parent"), F.col("lang").alias("parent_lang"))
    return d.join(b, F.expr("doc_id div 2") == F.col("parent"), "left").select("doc_id", "parent_lang")


@query("j9_adjacent", "SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def adjacent(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lead("role").over(w).alias("next_role"))


@query("t1_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def top_k(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("w4_last_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n <= 2")
def last_turns(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    users = table(spark, sf, "conversations").filter("role = 'user'")
    return users.withColumn("n", F.row_number().over(w)).filter("n <= 2").select("conv_id", "turn")


@query("z4_clear_session", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def clear_session(spark, sf):
    gone = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    return table(spark, sf, "conversations").join(gone, "conv_id", "left_anti").select("conv_id", "turn")


@query("z11_tool_budget", "SELECT conv_id, turn, (sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) <= 2) AS allowed FROM conversations")
def tool_budget(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w)
    return table(spark, sf, "conversations").select("conv_id", "turn", (used <= 2).alias("allowed"))


_RUN = "(CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0.0 END)::DOUBLE"


def _runs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", E.keyword_share(F.col("text"), F.array(F.lit("the"))).alias("q"), (F.col("n_chars") / 100.0).alias("seconds"))


@query("e8_failure_split", f"SELECT CASE WHEN {_RUN} >= 0.8 AND n_chars / 100.0 < 45 THEN 'none' WHEN {_RUN} < 0.8 THEN 'quality' ELSE 'time' END AS failure, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def failure_split(spark, sf):
    return _runs(spark, sf).groupBy(E.failure_kind(F.col("q"), F.col("seconds")).alias("failure")).agg(F.count("*").alias("n"))


@query("e16_projection", "SELECT round(sum(n_chars / 100.0::DOUBLE) / count(*) * 92, 4) AS projected FROM (SELECT n_chars FROM documents ORDER BY doc_id LIMIT 5)")
def projection(spark, sf):
    five = _runs(spark, sf).orderBy("doc_id").limit(5)
    return five.agg(F.round(F.sum("seconds") / F.count("*") * 92, 4).alias("projected"))


@query("e19_chunk_invariants", "SELECT count(*)::BIGINT AS orphans FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def chunk_invariants(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return e.join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("e20_paired_arms", f"SELECT lang, round(avg(q), 6) AS quality_without, round(avg(least(q + 0.25, 1)), 6) AS quality_with FROM (SELECT lang, {_RUN} AS q FROM documents) GROUP BY lang")
def paired_arms(spark, sf):
    r = _runs(spark, sf)
    arms = r.withColumn("arm", F.lit("without")).unionByName(r.withColumn("q", F.least(F.col("q") + 0.25, F.lit(1.0))).withColumn("arm", F.lit("with")))
    wide = arms.groupBy("lang").pivot("arm", ["without", "with"]).agg(F.round(F.avg("q"), 6))
    return wide.select("lang", F.col("without").alias("quality_without"), F.col("with").alias("quality_with"))


@query("e22_cut_off", "SELECT lang, count(*) FILTER (WHERE n_chars / 100.0 > 90)::BIGINT AS timed_out, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def cut_off(spark, sf):
    return _runs(spark, sf).groupBy("lang").agg(F.count_if(F.col("seconds") > 90).alias("timed_out"), F.count("*").alias("n"))


@query("e11_syntax_compliance", r"SELECT doc_id, CASE WHEN trim(text, E' \n\t\r') <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS compliance FROM documents")
def syntax_compliance(spark, sf):
    from docengine.functions import text as T

    return table(spark, sf, "documents").select("doc_id", F.when(T.strip(F.col("text")) != "", 1.0).otherwise(0.0).alias("compliance"))


@query("f29_generic_tags", r"SELECT doc_id, (contains(text, '```') OR regexp_matches(text, '(?m)^\s{4,}\S')) AS looks_like_code FROM documents")
def generic_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.col("text").contains("```") | F.col("text").rlike(r"(?m)^\s{4,}\S")).alias("looks_like_code"))


@query("k7_report", "SELECT lang, source, count(*)::BIGINT AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY lang, source")
def report(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("i11_bm25_all", f"WITH {_BM25}, raw AS (SELECT query_id, id, round(sum(mult * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN l USING (id), st GROUP BY query_id, id) SELECT query_id, count(*)::BIGINT AS hits, min(score) AS least FROM raw GROUP BY query_id")
def bm25_all(spark, sf):
    index = lexical.build(table(spark, sf, "documents"), "doc_id", lexical.document_tokens())
    terms = lexical.query_terms(table(spark, sf, "benchmark"), "item_id", lexical.document_tokens())
    return lexical.search(index, terms, positive=False).groupBy("query_id").agg(F.count("*").alias("hits"), F.min(F.round("score", 6)).alias("least"))


@query("p1_sql_chunks", "SELECT doc_id, 0 AS chunk_index, text AS chunk FROM documents WHERE length(text) <= 800")
def sql_chunks(spark, sf):
    sql.register(spark)
    table(spark, sf, "documents").filter("length(text) <= 800").createOrReplaceTempView("docengine_short")
    return spark.sql("select doc_id, chunk_index, chunk from docengine_short, lateral semantic_chunks(text)")


@query("p1_sql_chunks_all", ORACLES["c2_semantic_split"])
def sql_chunks_all(spark, sf):
    sql.register(spark)
    # Not a view of a fixed name, which another call in the session could replace.
    return spark.sql("select doc_id, chunk_index, chunk from {documents}, lateral semantic_chunks(text)", documents=table(spark, sf, "documents"))


@query("p2_sql_markdown")
def sql_markdown(spark, sf):
    sql.register(spark)
    table(spark, sf, "pages").createOrReplaceTempView("docengine_html")
    return spark.sql("select page_id, md_text(html) as markdown from docengine_html")
