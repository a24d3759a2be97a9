"""Indexing, search, fusion and retrieval; benchmark rows are queries, embeddings stand for chunk vectors."""

from pyspark.sql import functions as F

from docengine.functions import dictionaries as D
from docengine.functions import text as X
from docengine.operators import fusion, lexical, providers, vectors
from docengine.plans import retrieve as R
from docengine.queries.text import _EXP_ALL
from docengine.registry import ORACLES, query, table

_STOP = ", ".join(f"'{w}'" for w in D.STOPWORDS)


def _tok(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9][a-z0-9\-\.]*[a-z0-9]|[a-z0-9]'), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"


_BM25 = f"""d AS (SELECT doc_id AS id, {_tok('text')} AS t FROM documents), l AS (SELECT id, len(t) AS dl FROM d),
p AS (SELECT id, unnest(t) AS term FROM d), tf AS (SELECT id, term, count(*) AS tf FROM p GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
q AS (SELECT item_id AS query_id, term, count(*) AS mult FROM (SELECT item_id, unnest({_tok('text')}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, id, round(sum(mult * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM q JOIN df USING (term) JOIN tf USING (term) JOIN l USING (id), st GROUP BY query_id, id HAVING sum(mult * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0),
bmr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 50)"""
_KNN = """kq AS (SELECT item_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS qv FROM benchmark JOIN embeddings ON vec_id = item_id),
kn AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(qv, list_transform(embedding, lambda x: x::DOUBLE)), 9) AS similarity FROM kq, embeddings),
knr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM kn) WHERE rank <= 50)"""
_RRF = """rr AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score FROM (SELECT query_id, id, rank FROM bmr UNION ALL SELECT query_id, id, rank FROM knr) GROUP BY ALL),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM rr) WHERE rank <= 30)"""


def _index(spark, sf):
    return lexical.build(table(spark, sf, "documents"), "doc_id", X.tokens(F.col("text")))


def _terms(spark, sf):
    return lexical.query_terms(table(spark, sf, "benchmark"), "item_id", X.tokens(F.col("text")))


def _bm25(spark, sf):
    return lexical.search(_index(spark, sf), _terms(spark, sf)).withColumn("score", F.round("score", 6))


def _query_vectors(spark, sf):
    return table(spark, sf, "benchmark").join(table(spark, sf, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")


def _knn(spark, sf, k=50, corpus=None):
    return vectors.nearest(corpus if corpus is not None else table(spark, sf, "embeddings"), _query_vectors(spark, sf), k, id_col="vec_id")


def _chunks(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", F.left("text", F.lit(40)).alias("title"), F.col("lang").alias("category"))


def _hybrid_inputs(spark, sf):
    return (
        _chunks(spark, sf),
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"),
        _query_vectors(spark, sf),
    )


@query("i5_bm25_index", f"WITH {_BM25} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def bm25_index(spark, sf):
    return _index(spark, sf).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("i6_bm25_stats", f"WITH {_BM25} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM st")
def bm25_stats(spark, sf):
    return _index(spark, sf).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


_BM25_PATH = _BM25.replace(f"d AS (SELECT doc_id AS id, {_tok('text')} AS t FROM documents)", f"d AS (SELECT doc_id AS id, {_tok(chr(34) + 'full' + chr(34))} AS t FROM (SELECT doc_id, text || ' Section ' || coalesce(source, '') AS \"full\" FROM documents))")


@query("i6_bm25_with_path", f"WITH {_BM25_PATH} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM bmr WHERE rank <= 10")
def bm25_with_path(spark, sf):
    """Contents indexed together with their section path."""
    full = F.concat(F.col("text"), F.lit(" Section "), F.coalesce("source", F.lit("")))
    index = lexical.build(table(spark, sf, "documents"), "doc_id", X.tokens(full))
    return fusion.top(lexical.search(index, _terms(spark, sf)).withColumn("score", F.round("score", 6)), 10)


@query("i10_bm25_search", f"WITH {_BM25} SELECT query_id, id, score, rank FROM bmr WHERE rank <= 10")
def bm25_search(spark, sf):
    return fusion.top(_bm25(spark, sf), 10)


@query("i4_zero_vectors", "SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE list_sum(list_transform(embedding, lambda x: abs(x))) = 0)::BIGINT AS zero, count(DISTINCT len(embedding))::BIGINT AS dimensions FROM embeddings")
def zero_vectors(spark, sf):
    return vectors.zero_vectors(table(spark, sf, "embeddings"))


@query("i7_knn", f"WITH {_KNN} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM knr WHERE rank <= 10")
def knn(spark, sf):
    return _knn(spark, sf, 10).withColumn("similarity", F.round("similarity", 6))


@query("i8_knn_filtered", f"WITH {_KNN} SELECT query_id, id, rank FROM (SELECT query_id, k.id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, k.id) AS rank FROM kn k JOIN documents d ON d.doc_id = k.id WHERE d.source = 'src1') WHERE rank <= 10")
def knn_filtered(spark, sf):
    own = table(spark, sf, "documents").filter("source = 'src1'").select(F.col("doc_id").alias("vec_id"))
    corpus = table(spark, sf, "embeddings").join(own, "vec_id", "left_semi")
    return _knn(spark, sf, 10, corpus).select("query_id", "id", "rank")


@query("i9_knn_by_text")
def knn_by_text(spark, sf):
    embedder = providers.hashing_embedder()
    docs = providers.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", embedder)
    q = providers.embed(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text", embedder)
    return vectors.nearest(docs, q, 5, id_col="doc_id").select("query_id", "id", "rank")


@query("i12_rrf", f"WITH {_BM25}, {_KNN}, {_RRF} SELECT query_id, id, rrf_score FROM rr")
def rrf(spark, sf):
    return fusion.rrf(fusion.top(_bm25(spark, sf), 50), _knn(spark, sf, 50)).withColumn("rrf_score", F.round("rrf_score", 9))


@query("i13_hybrid", f"WITH {_BM25}, {_KNN}, {_RRF} SELECT query_id, id, rrf_score, rank FROM hy")
def hybrid(spark, sf):
    return R.hybrid(*_hybrid_inputs(spark, sf))


_BOOST = f"""qq AS (SELECT item_id AS query_id, {_tok('text')} AS base, CASE {' '.join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in D.CATEGORY_HINTS.items())} END AS hint FROM benchmark),
bo AS (SELECT query_id, h.id, rrf_score, base, list_distinct(base) AS ex, hint, lower(d.text) AS c, lower(left(d.text, 40)) AS ti, d.lang FROM hy h JOIN documents d ON d.doc_id = h.id JOIN qq USING (query_id)),
bs AS (SELECT query_id, id, round(rrf_score * (1 + 0.5 * greatest(len(list_filter(base, lambda w: contains(c, w) OR contains(ti, w))), len(list_filter(ex, lambda w: contains(c, w) OR contains(ti, w)))) / greatest(len(ex), 1)
  + CASE WHEN hint = lang THEN 1.5 WHEN hint = 'acl' AND lang IS NOT NULL THEN 0.6 ELSE 0 END
  + 0.6 * ({' + '.join(f"CASE WHEN contains(ti, '{w}') AND list_contains(ex, '{w}') THEN 1 ELSE 0 END" for w in D.STRONG_TITLE_WORDS)})), 9) AS score FROM bo),
rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs) WHERE rank <= 10)"""


@query("i16_boost", f"WITH {_BM25}, {_KNN}, {_RRF}, {_BOOST} SELECT query_id, id, score, rank FROM rt")
def boost(spark, sf):
    return R.retrieve(*_hybrid_inputs(spark, sf)).select("query_id", "id", "score", "rank")


@query("i17_category_weight", "SELECT a.s AS hint, b.s AS category, CASE WHEN a.s = b.s THEN 1.5 WHEN (a.s, b.s) IN (('backend','loadbalancing'),('loadbalancing','backend'),('ssl','frontend'),('frontend','ssl'),('healthcheck','loadbalancing')) THEN 0.9 WHEN a.s = 'acl' THEN 0.6 ELSE 0.0 END::DOUBLE AS weight FROM (SELECT unnest(['backend','loadbalancing','ssl','frontend','healthcheck','acl']) AS s) a, (SELECT unnest(['backend','loadbalancing','ssl','frontend','healthcheck','acl']) AS s) b")
def category_weight(spark, sf):
    names = spark.createDataFrame([(x,) for x in ("backend", "loadbalancing", "ssl", "frontend", "healthcheck", "acl")], "hint string")
    both = names.crossJoin(names.select(F.col("hint").alias("category")))
    return both.withColumn("weight", fusion.category_weight(F.col("hint"), F.col("category")).cast("double"))


@query("i24_retrieve", f"WITH {_BM25}, {_KNN}, {_RRF}, {_BOOST} SELECT query_id, id, score, rank, max(score) OVER (PARTITION BY query_id) AS best_score, false AS low_confidence FROM rt")
def retrieve(spark, sf):
    return R.retrieve(*_hybrid_inputs(spark, sf)).drop("content", "title")


@query("i26_context", f"WITH {_BM25}, {_KNN}, {_RRF}, {_BOOST} SELECT query_id, string_agg(d.text, E'\\n\\n---\\n\\n' ORDER BY rank) AS context FROM rt JOIN documents d ON d.doc_id = rt.id GROUP BY query_id")
def context(spark, sf):
    return R.context(R.retrieve(*_hybrid_inputs(spark, sf))).select("query_id", "context")


@query("i25_retry_queries", r"SELECT item_id AS query_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: length(t) > 3), ' ') AS text FROM benchmark WHERE item_id % 3 <> 0")
def retry_queries(spark, sf):
    """Queries that found nothing; those divisible by three found something."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.retry_simplified(q, _knn(spark, sf, 3).filter("query_id % 3 = 0").unionByName(q.filter("query_id % 3 = 0").selectExpr("query_id", "0L id", "0.0D similarity", "1 rank")))


@query("i26_sources", f"WITH {_BM25}, {_KNN}, {_RRF}, {_BOOST} SELECT query_id, string_agg(id || ':' || round(score, 3), ',' ORDER BY rank) AS sources FROM rt GROUP BY query_id")
def sources(spark, sf):
    return R.context(R.retrieve(*_hybrid_inputs(spark, sf))).select("query_id", "sources")


@query("i29_fallback", f"WITH {_KNN} SELECT query_id, id, round(similarity, 6) AS score, CAST(rank AS INTEGER) AS rank FROM knr WHERE rank <= 10")
def fallback(spark, sf):
    """Chunks without texts: the vector branch answers alone."""
    chunks, embeddings, questions, query_vectors = _hybrid_inputs(spark, sf)
    return R.search_or_vectors(chunks.drop("text"), embeddings, questions, query_vectors).withColumn("score", F.round("score", 6))


@query("i29_runtime_fallback", ORACLES["i29_fallback"])
def runtime_fallback(spark, sf):
    """Texts that plan well and fail once they are read: the vector branch answers alone."""
    chunks, embeddings, questions, query_vectors = _hybrid_inputs(spark, sf)
    broken = chunks.withColumn("text", F.when(F.length("text") >= 0, F.raise_error(F.lit("unreadable text"))).otherwise(F.col("text")))
    return R.search_or_vectors(broken, embeddings, questions, query_vectors).withColumn("score", F.round("score", 6))


@query("i29_hybrid_first", f"WITH {_BM25}, {_KNN}, {_RRF} SELECT query_id, id, rrf_score AS score, CAST(rank AS INTEGER) AS rank FROM hy WHERE rank <= 10")
def hybrid_first(spark, sf):
    return R.search_or_vectors(*_hybrid_inputs(spark, sf))


# The same with query expansion: tokens twice, and once more with the expansions.
_BM25_X = _BM25.replace(f"unnest({_tok('text')}) AS term FROM benchmark", f"unnest({_tok('text')} || {_tok('text')} || list_filter(list_transform(list_distinct({_tok('text')} {_EXP_ALL}), lambda x: lower(x)), lambda x: length(x) > 1)) AS term FROM benchmark")
_BOOST_X = _BOOST.replace(f"{_tok('text')} AS base,", f"{_tok('text')} AS base, list_distinct({_tok('text')} {_EXP_ALL}) AS ex,").replace("list_distinct(base) AS ex,", "ex,")
_RANK = "CAST(rank AS INTEGER) AS rank"


@query("i10_bm25_search_expanded", f"WITH {_BM25_X} SELECT query_id, id, score, {_RANK} FROM bmr WHERE rank <= 10")
def bm25_search_expanded(spark, sf):
    terms = lexical.query_terms(table(spark, sf, "benchmark"), "item_id", R.expanded_tokens(F.col("text")))
    return fusion.top(lexical.search(_index(spark, sf), terms).withColumn("score", F.round("score", 6)), 10)


@query("i13_hybrid_expanded", f"WITH {_BM25_X}, {_KNN}, {_RRF} SELECT query_id, id, rrf_score, {_RANK} FROM hy")
def hybrid_expanded(spark, sf):
    return R.hybrid(*_hybrid_inputs(spark, sf), expand=True)


@query("i24_retrieve_expanded", f"WITH {_BM25_X}, {_KNN}, {_RRF}, {_BOOST_X} SELECT query_id, id, score, {_RANK}, max(score) OVER (PARTITION BY query_id) AS best_score, false AS low_confidence FROM rt")
def retrieve_expanded(spark, sf):
    return R.retrieve(*_hybrid_inputs(spark, sf), expand=True).drop("content", "title")


@query("i26_context_expanded", f"WITH {_BM25_X}, {_KNN}, {_RRF}, {_BOOST_X} SELECT query_id, string_agg(d.text, E'\\n\\n---\\n\\n' ORDER BY rank) AS context FROM rt JOIN documents d ON d.doc_id = rt.id GROUP BY query_id")
def context_expanded(spark, sf):
    return R.context(R.retrieve(*_hybrid_inputs(spark, sf), expand=True)).select("query_id", "context")


_PLANNED = "CASE item_id % 7 WHEN 0 THEN '<i>' || text || '</i>' WHEN 3 THEN text || ' timeout of the acl' ELSE text END"
_FILTER = "CASE item_id % 5 WHEN 1 THEN ' src1 ' WHEN 2 THEN 'src2 $where' WHEN 3 THEN 'nowhere' WHEN 4 THEN ' ' END"
_THRESHOLD = 0.034
_PLAN_SQL = (
    f"""bq AS (SELECT item_id, {_PLANNED} AS text, nullif(trim({_FILTER}), '') AS flt, CASE WHEN regexp_matches({_PLANNED}, '(?is)<[^>]*>') THEN 'HTML tags' WHEN trim({_FILTER}) <> '' AND NOT coalesce(trim({_FILTER}) IN (SELECT source FROM documents), false) THEN 'filter_source' END AS error FROM benchmark),
ok AS (SELECT item_id, text, flt FROM bq WHERE error IS NULL), """
    + _BM25_X.replace("FROM benchmark)", "FROM ok)")
    + """, kq AS (SELECT item_id AS query_id, flt, list_transform(embedding, lambda x: x::DOUBLE) AS qv FROM ok JOIN embeddings ON vec_id = item_id),
kn AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(qv, list_transform(embedding, lambda x: x::DOUBLE)), 9) AS similarity FROM kq, embeddings JOIN documents ON doc_id = vec_id WHERE flt IS NULL OR source = flt),
knr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM kn) WHERE rank <= 50), """
    + _RRF
    + ", "
    + _BOOST_X.replace("FROM benchmark)", "FROM ok)")
)


def _planned(spark, sf):
    chunks, embeddings, _, query_vectors = _hybrid_inputs(spark, sf)
    chunks = chunks.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(_PLANNED).alias("text"), F.expr(_FILTER).alias("filter_source"))
    return R.plan(chunks, embeddings, asked, query_vectors, threshold=_THRESHOLD)


@query("i24_plan", f"WITH {_PLAN_SQL} SELECT query_id, id, score, {_RANK} FROM rt")
def planned(spark, sf):
    """Validation, source filter, expansion, fusion and boost: what is found."""
    return _planned(spark, sf)[0].select("query_id", "id", "score", "rank")


@query("i24_plan_status", f"WITH {_PLAN_SQL}, b AS (SELECT query_id, max(score) AS best FROM rt GROUP BY query_id) SELECT item_id AS query_id, error, coalesce(best, 0)::DOUBLE AS best_score, error IS NOT NULL OR coalesce(best, 0) < {_THRESHOLD} AS low_confidence FROM bq LEFT JOIN b ON query_id = item_id")
def plan_status(spark, sf):
    """Refused queries, unknown sources, and confident or doubtful answers."""
    return _planned(spark, sf)[1]


def _positions(spark, sf):
    return _knn(spark, sf, 30).select("query_id", F.col("rank").alias("pos"), "id", F.round("similarity", 6).alias("score"))


@query("i18_threshold", f"""WITH {_KNN}, b AS (SELECT query_id, rank AS pos, id, round(similarity, 6) AS score FROM knr WHERE rank <= 30),
m AS (SELECT *, coalesce(count(*) FILTER (WHERE score >= 0.20) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
k AS (SELECT *, score >= 0.30 OR (score >= 0.20 AND before < 5) AS keep FROM m),
a AS (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS found FROM k)
SELECT query_id, pos, id, score FROM a WHERE keep OR (NOT found AND pos <= 5)""")
def threshold(spark, sf):
    return fusion.threshold_filter(_positions(spark, sf), 5, 0.30, 0.10)


def _section_rows(spark, sf):
    rows = _knn(spark, sf, 30).drop("rank").withColumn("similarity", F.round("similarity", 6))
    return rows.withColumn("sections", F.array((F.col("id") % 5).cast("string"))).withColumn("targets", F.array((F.col("query_id") % 5).cast("string")))


def _section_sql(add: float, least: float, k: int) -> str:
    return f"""WITH {_KNN}, s AS (SELECT query_id, id, round(similarity, 6) + CASE WHEN id % 5 = query_id % 5 THEN {add} ELSE 0 END AS score FROM knr WHERE rank <= 30)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= {least}) WHERE rank <= {k}"""


for _n, _add, _least in (("i19_boost_015", 0.15, 0.20), ("i20_boost_020", 0.2, 0.15), ("i21_boost_025", 0.2, 0.25)):
    query(_n, _section_sql(_add, _least, 10))(lambda spark, sf, a=_add, m=_least: fusion.section_boost(_section_rows(spark, sf), a, m, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank"))


@query("i14_mmr")
def mmr(spark, sf):
    return fusion.mmr(_knn(spark, sf, 30).select("query_id", "id", (1 - F.col("similarity")).alias("distance")), 10)


@query("i15_rerank_default", f"WITH {_BM25}, {_KNN}, {_RRF} SELECT query_id, id, rrf_score AS rerank_score FROM hy")
def rerank_default(spark, sf):
    return providers.rerank(R.hybrid(*_hybrid_inputs(spark, sf))).select("query_id", "id", "rerank_score")


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda x: x <> ''))"


@query("i15_rerank_scored", f"WITH {_BM25}, {_KNN}, {_RRF} SELECT query_id, id, round(len(list_intersect({_WORDS.format(c='b.text')}, {_WORDS.format(c=chr(39) + 'keywords: ' + chr(39) + ' || coalesce(lang, ' + chr(39) * 2 + ') || chr(10) || d.text')})) / len({_WORDS.format(c='b.text')})::DOUBLE, 6) AS rerank_score FROM hy JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id")
def rerank_scored(spark, sf):
    """A scorer of shared words over the text a cross-encoder would see."""
    rows = R.hybrid(*_hybrid_inputs(spark, sf)).select("query_id", "id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), providers.rerank_text(F.lit(None).cast("string"), F.array(F.coalesce("lang", F.lit(""))), F.col("text")).alias("text"))
    asked = rows.join(docs, "id").join(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    words = lambda t: set(t.lower().split())
    share = lambda qs, ts: [len(words(q) & words(t)) / len(words(q)) for q, t in zip(qs, ts, strict=True)]
    return providers.rerank(asked, share).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"))


_unsteady = providers.failing_on("tionsh", providers.hashing_embedder(16, " \n\t\r"))


@query("i1_embed_memo", "SELECT doc_id, CASE WHEN contains(coalesce(text, ''), 'tionsh') OR trim(coalesce(text, ''), E' \\n\\t\\r') = '' THEN 0 ELSE 1 END::DOUBLE AS norm FROM documents")
def embed_memo(spark, sf):
    """Texts are embedded once each; zero vectors where the provider fails."""
    rows = providers.embed_distinct(table(spark, sf, "documents").select("doc_id", "text"), "text", _unsteady, 16, retries=2)
    return rows.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 5).alias("norm"))


@query("i2_embed_queries", "SELECT item_id, NOT contains(text, 'tionsh') AS embedded FROM benchmark")
def embed_queries(spark, sf):
    """Null, not a failed job, where the provider gives no answer."""
    rows = providers.embed_one_by_one(table(spark, sf, "benchmark"), "text", _unsteady, retries=2)
    return rows.select("item_id", F.col("embedding").isNotNull().alias("embedded"))


@query("i22_get_by_id", "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def get_by_id(spark, sf):
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, sf, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "text")


@query("i23_surrogate_id", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '\d+', 0), ''), '0')::BIGINT AS key FROM pages")
def surrogate_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("url", r"\d+", 0), F.lit("")), F.lit("0")).cast("long").alias("key"))


# DuckDB numbers rows as BIGINT, Spark as INT.
for _n in ("i7_knn", "i8_knn_filtered", "i10_bm25_search", "i13_hybrid", "i16_boost", "i24_retrieve", "i19_boost_015", "i20_boost_020", "i21_boost_025"):
    ORACLES[_n] = f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({ORACLES[_n]})"
ORACLES["i18_threshold"] = f"SELECT * REPLACE (CAST(pos AS INTEGER) AS pos) FROM ({ORACLES['i18_threshold']})"
