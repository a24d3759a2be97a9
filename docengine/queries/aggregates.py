"""Aggregates, set comparisons and evaluation metrics."""

from pyspark.sql import functions as F

from docengine.functions import dictionaries as D
from docengine.operators import evaluate as E
from docengine.operators import sets as S
from docengine.registry import query, table
from docengine.sources import files


@query("a1_totals", "SELECT count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 4) AS mean, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (WHERE n_chars > 1000)::BIGINT AS long FROM documents")
def totals(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("n_chars") > 1000).alias("long"))


@query("a2_histogram", "SELECT lang, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 4) AS percent FROM documents GROUP BY lang")
def histogram(spark, sf):
    return S.histogram(table(spark, sf, "documents"), "lang")


@query("a3_two_counts", "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def two_counts(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("documents_a3")
    return spark.sql("select lang, source, count(*) as n from documents_a3 group by grouping sets ((lang), (source))")


@query("a4_validation", "SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE length(text) < 50)::BIGINT AS empty, count(*) FILTER (WHERE length(text) BETWEEN 50 AND 199)::BIGINT AS short, count(*) FILTER (WHERE lang IS NULL OR source IS NULL)::BIGINT AS incomplete FROM documents")
def validation(spark, sf):
    return S.validation_report(table(spark, sf, "documents"), "text", ["lang", "source"])


@query("a5_volume", "SELECT count(*)::BIGINT AS n, count(DISTINCT url)::BIGINT AS urls, count(*) FILTER (WHERE length(html) < 500)::BIGINT AS b0, count(*) FILTER (WHERE length(html) BETWEEN 500 AND 1999)::BIGINT AS b1, count(*) FILTER (WHERE length(html) BETWEEN 2000 AND 9999)::BIGINT AS b2, count(*) FILTER (WHERE length(html) >= 10000)::BIGINT AS b3 FROM pages")
def volume(spark, sf):
    n = F.length("html")
    return table(spark, sf, "pages").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"), F.count_if(n < 500).alias("b0"), F.count_if((n >= 500) & (n < 2000)).alias("b1"), F.count_if((n >= 2000) & (n < 10000)).alias("b2"), F.count_if(n >= 10000).alias("b3"))


_WORDS = ["thing", "tion", "server", "zu"]


@query("a6_keyword_hits", f"WITH k AS (SELECT unnest({_WORDS!r}) AS k), h AS (SELECT doc_id, k FROM documents, k WHERE contains(lower(text), k)) SELECT count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS hits, count(DISTINCT k)::BIGINT AS words FROM h")
def keyword_hits(spark, sf):
    hit = F.filter(F.array(*[F.lit(w) for w in _WORDS]), lambda w: F.lower("text").contains(w))
    rows = table(spark, sf, "documents").select(hit.alias("h")).filter(F.size("h") > 0)
    return rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("h")), F.lit(0)).alias("hits"), F.size(F.array_distinct(F.flatten(F.collect_set("h")))).cast("long").alias("words"))


@query("a7_section_groups", "SELECT split_part(url, ':', 1) AS prefix, count(*)::BIGINT AS n, min(url) AS first FROM pages GROUP BY 1")
def section_groups(spark, sf):
    return table(spark, sf, "pages").groupBy(F.split_part("url", F.lit(":"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"), F.min("url").alias("first"))


@query("a8_composite", "SELECT lang, round(0.4 * avg(quality) + 0.4 * (1 - avg(toxic)) + 0.2 * least(count(*) / 100.0, 1), 6) AS score FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def composite(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return rows.groupBy("lang").agg(F.round(0.4 * F.avg("quality") + 0.4 * (1 - F.avg("toxic")) + 0.2 * F.least(F.count("*") / 100.0, F.lit(1.0)), 6).alias("score"))


@query("a9_growth", "SELECT round(100.0::DOUBLE * (sum(length(html)) - (SELECT sum(n_chars) FROM documents)) / (SELECT sum(n_chars) FROM documents), 4) AS growth FROM pages")
def growth(spark, sf):
    a = table(spark, sf, "pages").agg(F.sum(F.length("html")).alias("a"))
    b = table(spark, sf, "documents").agg(F.sum("n_chars").alias("b"))
    return a.crossJoin(b).select(F.round(100.0 * (F.col("a") - F.col("b")) / F.col("b"), 4).alias("growth"))


_OVER = "WITH a AS (SELECT DISTINCT doc_id AS k FROM labels), b AS (SELECT DISTINCT vec_id AS k FROM embeddings), j AS (SELECT a.k AS a, b.k AS b FROM a FULL JOIN b ON a.k = b.k) SELECT count(a)::BIGINT AS found, count(b)::BIGINT AS reference, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL)::BIGINT AS shared, count(*) FILTER (WHERE a IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE b IS NULL)::BIGINT AS extra, coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(b), 4), 0) AS coverage FROM j"


@query("a19_overlap", _OVER)
def overlap(spark, sf):
    return S.overlap(table(spark, sf, "labels").select(F.col("doc_id").alias("k")), table(spark, sf, "embeddings").select(F.col("vec_id").alias("k")), "k")


@query("a10_coverage", "SELECT round(100.0::DOUBLE * sum(n_chars) FILTER (WHERE lang = 'en') / sum(n_chars), 4) AS coverage, 100.0::DOUBLE * sum(n_chars) FILTER (WHERE lang = 'en') / sum(n_chars) >= 95 AS enough FROM documents")
def coverage(spark, sf):
    share = 100.0 * F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))) / F.sum("n_chars")
    return table(spark, sf, "documents").agg(F.round(share, 4).alias("coverage"), (share >= 95).alias("enough"))


@query("j7_missing", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing(spark, sf):
    return S.missing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("j5_substring_join", f"SELECT doc_id, k AS keyword FROM documents, (SELECT unnest({_WORDS!r}) AS k) WHERE contains(lower(text), k)")
def substring_join(spark, sf):
    hit = F.filter(F.array(*[F.lit(w) for w in _WORDS]), lambda w: F.lower("text").contains(w))
    return table(spark, sf, "documents").select("doc_id", F.explode(hit).alias("keyword"))


@query("j1_hydrate", "SELECT l.doc_id, quality, n_chars FROM labels l JOIN documents d USING (doc_id)")
def hydrate(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", "quality", "n_chars")


@query("j2_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def semi(spark, sf):
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "lang")


@query("j3_first_parent", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_parent(spark, sf):
    return S.first_seen(table(spark, sf, "documents"), "source", "doc_id")


@query("j4_full_outer", "SELECT coalesce(l.doc_id, e.vec_id) AS id, quality, label FROM labels l FULL JOIN embeddings e ON l.doc_id = e.vec_id")
def full_outer(spark, sf):
    l, e = table(spark, sf, "labels"), table(spark, sf, "embeddings")
    return l.join(e, l.doc_id == e.vec_id, "full").select(F.coalesce("doc_id", "vec_id").alias("id"), "quality", "label")


@query("j6_intersection", "SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def intersection(spark, sf):
    return table(spark, sf, "labels").select("doc_id").intersect(table(spark, sf, "embeddings").select("vec_id"))


@query("u1_union", "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels UNION ALL SELECT vec_id FROM embeddings)")
def union(spark, sf):
    return table(spark, sf, "labels").select("doc_id").union(table(spark, sf, "embeddings").select("vec_id")).distinct()


@query("u3_except", "SELECT doc_id FROM labels EXCEPT SELECT vec_id FROM embeddings")
def subtract(spark, sf):
    return table(spark, sf, "labels").select("doc_id").subtract(table(spark, sf, "embeddings").select("vec_id"))


@query("w3_cap_per_group", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 3")
def cap(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("user_id", "event_id")


@query("k6_upsert", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert(spark, sf):
    """The even events are stored, the odd ones upserted over them."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    path, target = files.scratch(spark, "store"), files.scratch(spark, "store")
    S.latest(e.filter("event_id % 2 = 0"), "user_id", "event_id").write.parquet(path)
    files.upsert(spark, path, S.latest(e.filter("event_id % 2 = 1"), "user_id", "event_id"), "user_id", "event_id", target)
    return spark.read.parquet(target)


@query("k6_delete", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def delete(spark, sf):
    """Keys deleted from a store; a cleared store is empty (K6)."""
    path, target = files.scratch(spark, "store"), files.scratch(spark, "store")
    d = table(spark, sf, "documents").select("doc_id", "source")
    d.write.parquet(path)
    files.delete(spark, path, table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", target)
    cleared = files.scratch(spark, "store")
    files.clear(spark, target, cleared)
    return spark.read.parquet(target).unionByName(spark.read.parquet(cleared))


@query("s12_cases", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, lang AS category FROM documents WHERE doc_id % 3 IN (0, 1) AND lang = 'en'")
def cases(spark, sf):
    """Cases of the levels of a suite and of a category (S12, E21: each suite holds the ones before it)."""
    d = table(spark, sf, "documents").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END").alias("difficulty"), F.col("lang").alias("category"))
    return E.select_cases(d, "standard", category="en")


@query("s11_suites", "SELECT suite, count(*)::BIGINT AS n FROM documents, (VALUES ('quick', 0), ('standard', 1), ('full', 2)) s(suite, most) WHERE doc_id % 3 <= most GROUP BY suite")
def suites(spark, sf):
    """quick is part of standard, and standard of full."""
    d = table(spark, sf, "documents").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END").alias("difficulty"))
    out = None
    for suite in E.SUITES:
        n = E.select_cases(d, suite).agg(F.lit(suite).alias("suite"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("a18_store_stats", "SELECT source, count(*)::BIGINT AS parents, count(quality)::BIGINT AS children FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def store_stats(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("parents"), F.count("quality").alias("children"))


@query("a20_sample", "SELECT doc_id, left(text, 80) AS head FROM documents ORDER BY doc_id LIMIT 5")
def sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(80)).alias("head")).orderBy("doc_id").limit(5)


# ---- evaluation: documents stand for answers, their source for the model


def _answers(spark, sf):
    d = table(spark, sf, "documents")
    kw = F.array(F.lit("the"), F.lit("thing"), F.col("source"))
    return d.select("doc_id", "source", "lang", F.col("text").alias("answer"), kw.alias("keywords"), F.lit(200).alias("least"), (F.col("n_chars") / 100.0).alias("seconds"))


_KW = "(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'thing') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), source) THEN 1 ELSE 0 END) / 3.0::DOUBLE"
_Q = f"(0.6::DOUBLE * {_KW} + CASE WHEN length(text) >= 200 THEN 0.2 ELSE 0 END + CASE WHEN length(text) > 50 THEN 0.2 ELSE 0 END)"
_QUAL = E.answer_quality


def _quality(spark, sf):
    return _answers(spark, sf).withColumn("quality", F.round(E.answer_quality(F.col("answer"), F.col("keywords"), F.col("least")), 6))


@query("e1_answer_quality", f"SELECT doc_id, round({_Q}, 6) AS quality FROM documents")
def answer_quality(spark, sf):
    return _quality(spark, sf).select("doc_id", "quality")


@query("e2_token_quality", f"SELECT doc_id, round(0.6::DOUBLE * {_KW} + CASE WHEN length(text) >= 200 THEN 0.2 ELSE 0 END + CASE WHEN len(string_split(text, ' ')) > 50 THEN 0.2 ELSE 0 END, 6) AS quality FROM documents")
def token_quality(spark, sf):
    a = _answers(spark, sf)
    return a.select("doc_id", F.round(E.answer_quality(F.col("answer"), F.col("keywords"), F.col("least"), F.size(F.split("answer", " ")) > 50), 6).alias("quality"))


@query("e3_band", f"SELECT CASE WHEN q > 0.7 THEN 'resolved' WHEN q > 0.4 THEN 'partial' ELSE 'failed' END AS band, count(*)::BIGINT AS n FROM (SELECT round({_Q}, 6) AS q FROM documents) GROUP BY 1")
def band(spark, sf):
    return _quality(spark, sf).groupBy(E.band(F.col("quality")).alias("band")).agg(F.count("*").alias("n"))


_FB = " OR ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in D.FALLBACK_PHRASES)
_L = "CASE WHEN length(text) >= 200 THEN 1.0::DOUBLE ELSE length(text) / 200.0::DOUBLE END"


@query("e4_response", f"SELECT doc_id, round(0.7::DOUBLE * {_KW} + 0.3::DOUBLE * {_L}, 2) AS quality_score, ({_FB}) AS is_fallback, (0.7::DOUBLE * {_KW} + 0.3::DOUBLE * {_L} >= 0.8 AND length(text) >= 200 AND NOT ({_FB})) AS passed FROM documents")
def response(spark, sf):
    return E.response(_answers(spark, sf)).select("doc_id", "quality_score", "is_fallback", "passed")


@query("e5_needs_fallback", f"SELECT doc_id, NOT (0.7::DOUBLE * {_KW} + 0.3::DOUBLE * {_L} >= 0.8 AND length(text) >= 200 AND NOT ({_FB})) AS needs_fallback FROM documents")
def needs_fallback(spark, sf):
    return E.response(_answers(spark, sf)).select("doc_id", "needs_fallback")


@query("e6_pass_45", f"SELECT doc_id, ({_KW} >= 0.6 AND n_chars / 100.0 < 45) AS passed, CASE WHEN {_KW} >= 0.6 AND n_chars / 100.0 < 45 THEN 'none' WHEN {_KW} < 0.6 THEN 'quality' ELSE 'time' END AS failure FROM documents")
def pass_45(spark, sf):
    kw = E.keyword_share(F.col("answer"), F.col("keywords"))
    return _answers(spark, sf).select("doc_id", E.passes(kw, F.col("seconds"), 0.6).alias("passed"), E.failure_kind(kw, F.col("seconds"), 0.6).alias("failure"))


@query("e7_pass_30", f"SELECT count(*) FILTER (WHERE {_KW} >= 0.6 AND n_chars / 100.0 < 30)::BIGINT AS passed, count(*)::BIGINT AS n FROM documents")
def pass_30(spark, sf):
    kw = E.keyword_share(F.col("answer"), F.col("keywords"))
    return _answers(spark, sf).agg(F.count_if(E.passes(kw, F.col("seconds"), 0.6, 30.0)).alias("passed"), F.count("*").alias("n"))


@query("e9_metadata_quality", f"SELECT doc_id, round(100 * (0.6::DOUBLE * {_KW} + 0.4::DOUBLE * CASE WHEN lang = 'en' THEN 1 ELSE 0.5 END), 4) AS quality FROM documents")
def metadata_quality(spark, sf):
    return _answers(spark, sf).select("doc_id", F.round(E.metadata_quality(F.col("answer"), F.col("keywords"), F.col("lang") == "en"), 4).alias("quality"))


_TYPES = ("syntax", "logic", "security", "reference")
_HAS = lambda bit: f"(doc_id >> {bit}) & 1 = 1"
_EXPECTED_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_HAS(i)} THEN '{t}' END" for i, t in enumerate(_TYPES)) + "], lambda x: x IS NOT NULL)"
_CLAIMED_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_HAS(i + 2)} THEN '{t}' END" for i, t in enumerate(_TYPES)) + "], lambda x: x IS NOT NULL)"


def _typed(shift: int):
    return F.array_compact(F.array(*[F.when(F.expr(f"shiftright(doc_id, {i + shift}) & 1") == 1, F.lit(t)) for i, t in enumerate(_TYPES)]))


@query("e10_detection_rate", f"WITH t AS (SELECT doc_id, {_EXPECTED_SQL} AS e, {_CLAIMED_SQL} AS c FROM documents) SELECT doc_id, round(CASE WHEN len(e) = 0 THEN 1 ELSE len(list_intersect(e, c)) / len(e)::DOUBLE END, 6) AS rate FROM t")
def detection_rate(spark, sf):
    """Expected and claimed types are chosen by bits of doc_id; repeats count once."""
    twice = F.concat(_typed(0), _typed(0))
    return table(spark, sf, "documents").select("doc_id", F.round(E.detection_rate(_typed(2), twice), 6).alias("rate"))


@query("e12_optimisation_precision", """WITH t AS (SELECT doc_id, [x for x in ['balance leastconn', 'timeout client 30s', 'option forwardfor', 'maxconn ' || doc_id] if (doc_id >> (list_position(['balance leastconn', 'timeout client 30s', 'option forwardfor', 'maxconn ' || doc_id], x) - 1)::INT) & 1 = 1] AS want,
 [x for x in ['balance leastconn', 'timeout client 30s', 'option forwardfor', 'maxconn ' || doc_id] if (doc_id >> (list_position(['balance leastconn', 'timeout client 30s', 'option forwardfor', 'maxconn ' || doc_id], x) + 1)::INT) & 1 = 1] AS got FROM documents)
SELECT doc_id, round(CASE WHEN len(want) > 0 THEN len(list_intersect(want, got)) / len(want)::DOUBLE WHEN len(got) = 0 THEN 1 ELSE 0 END, 6) AS share FROM t""")
def optimisation_precision(spark, sf):
    """Lines added to a configuration, chosen by bits of doc_id; some of the base are repeated."""
    lines = [F.lit("balance leastconn"), F.lit("timeout client 30s"), F.lit("option forwardfor"), F.concat(F.lit("maxconn "), F.col("doc_id").cast("string"))]
    base = F.lit("frontend web\n  bind *:80\n")
    made = lambda shift: F.concat(base, F.array_join(F.array_compact(F.array(*[F.when(F.expr(f"shiftright(doc_id, {i + shift}) & 1") == 1, F.concat(F.lit("  "), x)) for i, x in enumerate(lines)])), "\n"), F.lit("\n  bind *:80"))
    return table(spark, sf, "documents").select("doc_id", F.round(E.optimisation_precision(base, made(2), made(0)), 6).alias("share"))


@query("e13_hallucination", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')) AS l FROM documents)
SELECT doc_id, round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: NOT list_contains(['The', 'Of', 'De', 'En'], string_split(x, ' ')[1]))) / len(l)::DOUBLE ELSE 0 END, 6) AS rate FROM l""")
def hallucination(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(E.hallucination_rate(F.col("text"), F.array(*[F.lit(x) for x in ("The", "Of", "De", "En")])), 6).alias("rate"))


@query("e14_global_score", "SELECT doc_id, round(0.3 * quality + 0.3 * quality + 0.2 * (1 - toxic) + 0.2 * (1 - toxic), 6)::DOUBLE AS score FROM labels")
def global_score(spark, sf):
    q, t = F.col("quality").cast("double"), F.col("toxic").cast("double")
    return table(spark, sf, "labels").select("doc_id", F.round(E.global_score(q, q, 1 - t, t), 6).alias("score"))


@query("e15_prf", "WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE AS fn FROM labels) SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS p, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS r, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def prf(spark, sf):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    c = table(spark, sf, "labels").agg(F.count_if(q & t).alias("tp"), F.count_if(q & ~t).alias("fp"), F.count_if(~q & t).alias("fn"))
    p, r, f = E.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select(F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"))


@query("e17_best_of", "SELECT doc_id, CASE WHEN toxic > quality THEN 'second' ELSE 'first' END AS chosen FROM labels")
def best_of(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") > F.col("quality"), "second").otherwise("first").alias("chosen"))


@query("e18_speed", "SELECT source, round(sum(len(string_split(text, ' '))) / sum(n_chars / 100.0), 4)::DOUBLE AS per_second, round(avg(n_chars / 100.0), 4)::DOUBLE AS mean_seconds FROM documents GROUP BY source")
def speed(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.round(F.sum(F.size(F.split("text", " "))) / F.sum(F.col("n_chars") / 100.0), 4).alias("per_second"), F.round(F.avg(F.col("n_chars") / 100.0), 4).alias("mean_seconds"))


@query("e21_levels", "SELECT lang, count(*)::BIGINT AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def levels(spark, sf):
    return table(spark, sf, "documents").filter(F.col("lang").isin("en", "de")).groupBy("lang").agg(F.count("*").alias("n"))


@query("a11_failures", f"WITH q AS (SELECT source, {_KW} AS k FROM documents), c AS (SELECT CASE WHEN source LIKE 'src1%' THEN 'one' WHEN source LIKE 'src2%' THEN 'two' ELSE 'rest' END AS kind, k FROM q WHERE k < 0.6) SELECT kind, count(*)::BIGINT AS n FROM c GROUP BY kind")
def failures(spark, sf):
    kind = F.when(F.col("source").startswith("src1"), "one").when(F.col("source").startswith("src2"), "two").otherwise("rest")
    return _answers(spark, sf).filter(E.keyword_share(F.col("answer"), F.col("keywords")) < 0.6).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("a12_bench_stats", f"SELECT round(avg(q), 6) AS mean, count(*) FILTER (WHERE q > 0.7)::BIGINT AS resolved, round(100.0::DOUBLE * count(*) FILTER (WHERE q > 0.7) / count(*), 4) AS success FROM (SELECT round({_Q}, 6) AS q FROM documents)")
def bench_stats(spark, sf):
    good = F.count_if(F.col("quality") > 0.7)
    return _quality(spark, sf).agg(F.round(F.avg("quality"), 6).alias("mean"), good.alias("resolved"), F.round(100.0 * good / F.count("*"), 4).alias("success"))


@query("a13_model_ranking", f"SELECT source, round(avg(q), 4) AS quality, row_number() OVER (ORDER BY round(avg(q), 4) DESC, source)::INT AS place FROM (SELECT source, round({_Q}, 6) AS q FROM documents) GROUP BY source")
def model_ranking(spark, sf):
    from pyspark.sql import Window

    g = _quality(spark, sf).groupBy("source").agg(F.round(F.avg("quality"), 4).alias("quality"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("quality"), "source")))


@query("a14_model_score", f"SELECT source, round(0.5::DOUBLE * 100 * avg(q) + 0.3::DOUBLE * (100 - least(avg(n_chars / 100.0::DOUBLE), 60)) + 0.2::DOUBLE * 100 * avg(CASE WHEN q > 0.7 THEN 1.0::DOUBLE ELSE 0 END), 4) AS score FROM (SELECT source, n_chars, round({_Q}, 6) AS q FROM documents) GROUP BY source")
def model_score(spark, sf):
    g = _quality(spark, sf).groupBy("source").agg(F.avg("quality").alias("q"), F.avg("seconds").alias("t"), F.avg(F.when(F.col("quality") > 0.7, 1.0).otherwise(0.0)).alias("s"))
    return g.select("source", F.round(E.model_score(100 * F.col("q"), F.col("t"), 100 * F.col("s")), 4).alias("score"))


@query("a15_by_arm", f"SELECT lang, source, round(avg(q), 6) AS quality, count(*)::BIGINT AS n FROM (SELECT lang, source, round({_Q}, 6) AS q FROM documents) GROUP BY ROLLUP (lang, source)")
def by_arm(spark, sf):
    return _quality(spark, sf).rollup("lang", "source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.count("*").alias("n"))


@query("a16_comparison", f"SELECT round(avg(q) FILTER (WHERE lang = 'en') - avg(q) FILTER (WHERE lang <> 'en'), 6) AS gain FROM (SELECT lang, round({_Q}, 6) AS q FROM documents)")
def comparison(spark, sf):
    return _quality(spark, sf).agg(F.round(F.avg(F.when(F.col("lang") == "en", F.col("quality"))) - F.avg(F.when(F.col("lang") != "en", F.col("quality"))), 6).alias("gain"))
