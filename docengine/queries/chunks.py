"""Chunking over `documents`: source stands for url, doc_id for the sequence."""

from pyspark.sql import functions as F

from docengine.operators import chunking as C
from docengine.registry import ORACLES, query, table


def _sections(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("url"), F.col("lang").alias("title"), F.col("text").alias("content"))


def _parents(spark, sf):
    return C.parents(_sections(spark, sf))


@query("c1_merge_short", r"""WITH RECURSIVE s AS (SELECT doc_id AS seq, source AS url, lang AS title, text AS content, coalesce(doc_id - lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) <> 1, true) AS start FROM documents),
m AS (SELECT seq AS first, seq, url, title, content FROM s WHERE start
UNION ALL SELECT CASE WHEN length(m.content) < 300 THEN m.first ELSE s.seq END, s.seq, s.url, CASE WHEN length(m.content) < 300 THEN m.title ELSE s.title END,
 CASE WHEN length(m.content) < 300 THEN m.content || CASE WHEN s.title <> m.title THEN E'\n\n## ' || s.title ELSE '' END || E'\n\n' || s.content ELSE s.content END
 FROM m JOIN s ON s.seq = m.seq + 1 AND NOT s.start AND s.url = m.url)
SELECT first AS seq, url, title, arg_max(content, seq) AS content FROM m GROUP BY first, url, title""")
def merge_short(spark, sf):
    return C.merge_short(_sections(spark, sf))


@query("c2_semantic_split", r"""WITH RECURSIVE r AS (SELECT doc_id, -1 AS i, text AS rem, NULL::VARCHAR AS chunk, length(text) > 800 AS more FROM documents
UNION ALL SELECT doc_id, i + 1, CASE WHEN more THEN substr(rem, greatest(0, cut - 150) + 1) ELSE '' END,
  CASE WHEN i = -1 AND NOT more THEN rem WHEN more THEN trim(left(rem, cut), E' \n\t\r') ELSE trim(rem, E' \n\t\r') END, more AND length(substr(rem, greatest(0, cut - 150) + 1)) > 800
 FROM (SELECT *, CASE WHEN strpos(substr(rem, 302, 498), '. ') > 0 THEN 800 - strpos(reverse(substr(rem, 302, 499)), ' .') + 1 ELSE 800 END AS cut FROM r) WHERE (more OR rem <> ''))
SELECT doc_id, i AS chunk_index, chunk FROM r WHERE i >= 0 AND (chunk <> '' OR i = 0)""")
def semantic(spark, sf):
    return C.split(table(spark, sf, "documents").select("doc_id", "text"), "text", C.semantic_split).select("doc_id", "chunk_index", "chunk")


@query("c3_build_chunks")
def build(spark, sf):
    return C.with_sequence(C.build_chunks(_sections(spark, sf)), ["seq", "chunk_index"]).select("id", "seq", "chunk_index", "total_chunks", "char_len", "has_code", F.array_join("tags", ",").alias("tags"))


@query("c4_recursive_split")
def recursive(spark, sf):
    return C.split(table(spark, sf, "documents").select("doc_id", "text"), "text", C.recursive_split).select("doc_id", "chunk_index", "chunk")


@query("c5_parents", "SELECT 'parent_' || left(sha256(source || '|' || doc_id::VARCHAR), 16) AS parent_id, doc_id AS seq FROM documents WHERE length(text) BETWEEN 100 AND 4000")
def parents(spark, sf):
    return _parents(spark, sf).select("parent_id", "seq")


@query("c6_children")
def children(spark, sf):
    return C.children(_parents(spark, sf)).select("child_id", "parent_id", "content")


@query("c7_coverage")
def coverage(spark, sf):
    p = _parents(spark, sf)
    return C.coverage(p, C.children(p)).groupBy("verdict").count()


@query("c8_statistics", "SELECT count(*)::BIGINT AS n, round(avg(length(text)), 4) AS mean_len, min(length(text))::INT AS min_len, max(length(text))::INT AS max_len, count(*) FILTER (WHERE length(text) < 300)::BIGINT AS short, count(*) FILTER (WHERE length(text) BETWEEN 300 AND 599)::BIGINT AS medium, count(*) FILTER (WHERE length(text) >= 600)::BIGINT AS long, (count(*) FILTER (WHERE contains(text, '```')) * 100 // count(*))::BIGINT AS code_percent FROM documents")
def statistics(spark, sf):
    return C.statistics(table(spark, sf, "documents"), F.col("text"))


@query("c9_pack_paragraphs")
def paragraphs(spark, sf):
    return C.split(table(spark, sf, "documents").select("doc_id", "text"), "text", C.pack_paragraphs).select("doc_id", "chunk_index", "chunk")


@query("w2_chunk_numbers", "SELECT doc_id, source, (row_number() OVER (ORDER BY source, doc_id) - 1)::BIGINT AS id FROM documents")
def numbers(spark, sf):
    return C.with_sequence(table(spark, sf, "documents").select("doc_id", "source"), ["source", "doc_id"])


@query("c1_merge_split", ORACLES["c1_merge_short"])
def merge_short_split(spark, sf):
    """The same, block by block: no url is one task's."""
    return C.merge_short_split(_sections(spark, sf), block=256)
