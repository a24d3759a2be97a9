"""The rules whose driver rows are all alike, over rows derived from the tables on which every outcome occurs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docengine.functions import dictionaries as D
from docengine.functions import text as X
from docengine.operators import evaluate as E
from docengine.operators import fusion, providers
from docengine.plans import retrieve as R
from docengine.queries.aggregates import _KW, _Q
from docengine.queries.search import _BM25, _BOOST, _KNN, _RRF, _hybrid_inputs
from docengine.queries.text import _TAGS
from docengine.registry import query, table
from docengine.sources import files
from docengine.sources import html as H

_ASKED = "CASE doc_id % 7 WHEN 0 THEN '<b>' || text || '</b>' WHEN 1 THEN 'a <script x>1</script> b' WHEN 2 THEN 'go JavaScript:' || doc_id WHEN 3 THEN 'x {{ y }} ' || doc_id WHEN 4 THEN '  ' WHEN 5 THEN chr(1) ELSE 'plain ' || doc_id || chr(2) END"
_CUT = "left(trim(asked, E' \\n\\t\\r'), 2000)"
_ERROR = f"CASE WHEN {_CUT} = '' THEN 'empty' {' '.join(f'''WHEN regexp_matches({_CUT}, '{p}') THEN '{n}' ''' for n, p in D.QUERY_PATTERNS)} WHEN {_CUT} = chr(1) THEN 'empty after cleaning' END"
_ASKED_ROWS = f"WITH a AS (SELECT doc_id, {_ASKED} AS asked FROM documents)"


@query("f1_validate_varied", rf"{_ASKED_ROWS} SELECT doc_id, {_ERROR} AS error, CASE WHEN {_ERROR} IS NULL THEN regexp_replace({_CUT}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') END AS cleaned FROM a")
def validate_varied(spark, sf):
    asked = F.expr(_ASKED)
    return table(spark, sf, "documents").select("doc_id", X.query_error(asked).alias("error"), X.clean_query(asked).alias("cleaned"))


_SCRUBBED = "asked"
for _, _p in D.QUERY_PATTERNS:
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '{_p}', '', 'g')"


@query("f2_scrub_varied", rf"{_ASKED_ROWS} SELECT doc_id, trim(left(trim(regexp_replace(regexp_replace({_SCRUBBED}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^\s+|\s+$', '', 'g'), E' \n\t\r'), 2000), '') AS scrubbed FROM a WHERE doc_id % 7 <> 0")
def scrub_varied(spark, sf):
    return table(spark, sf, "documents").filter("doc_id % 7 != 0").select("doc_id", X.scrub_input(F.expr(_ASKED)).alias("scrubbed"))


_URL = "'http://h/' || CASE doc_id % 4 WHEN 0 THEN 'intro.html' WHEN 1 THEN 'configuration.html#' || doc_id WHEN 2 THEN 'management-intro.html' ELSE 'other/management' END"


@query("f9_detect_source_varied", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'intro' WHEN 1 THEN 'configuration' WHEN 2 THEN 'intro' ELSE 'management' END AS kind FROM documents")
def detect_source_varied(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.detect_source(F.expr(_URL)).alias("kind"))


_CODED = "CASE doc_id % 3 WHEN 0 THEN text || chr(10) || '```' WHEN 1 THEN 'see' || chr(10) || '    acl x' ELSE 'no `` code' END"


@query("f10_has_code_varied", "SELECT doc_id, doc_id % 3 = 0 AS has_code, doc_id % 3 <> 2 AS looks_like_code FROM documents")
def has_code_varied(spark, sf):
    coded = F.expr(_CODED)
    return table(spark, sf, "documents").select("doc_id", X.has_code(coded).alias("has_code"), (X.has_code(coded) | coded.rlike(r"(?m)^\s{4,}\S")).alias("looks_like_code"))


_DIRECTED = "lower(text || CASE doc_id % 4 WHEN 0 THEN ' HTTP-request deny if x' WHEN 1 THEN ' sc0_conn_rate and table_gpc0, sc1_x' WHEN 2 THEN ' http-request auth' ELSE '' END)"
_DIRECTIVES = ", ".join(f"CASE WHEN contains(x, '{a}') THEN 'directive:{a.replace(' ', '_')}' END" for a in D.HTTP_REQUEST_ACTIONS)
_ALL_TAGS = f"list_sort(list_distinct(list_filter([{_TAGS.replace('lower(text)', 'x')}, {_DIRECTIVES}], lambda t: t IS NOT NULL) || list_transform(list_slice(regexp_extract_all(x, '\\b(sc\\d+_[a-z_]+|table_[a-z_]+)\\b'), 1, 5), lambda t: 'sample_fetch:' || t)))"


@query("f12_tags_varied", f"SELECT doc_id, array_to_string({_ALL_TAGS}, ',') AS tags FROM (SELECT doc_id, {_DIRECTED} AS x FROM documents)")
def tags_varied(spark, sf):
    """Categories, http-request directives and sample fetches."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.tags(F.expr(_DIRECTED)), ",").alias("tags"))


@query("f13_chunk_keywords_varied", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_append(list_transform({_ALL_TAGS}, lambda t: string_split(t, ':')[-1]), lower(source)))), ',') AS keywords FROM (SELECT doc_id, source, {_DIRECTED} AS x FROM documents)")
def chunk_keywords_varied(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.chunk_keywords(X.tags(F.expr(_DIRECTED)), F.array("source")), ",").alias("keywords"))


_JSON = """CASE event_id % 4 WHEN 0 THEN 'x ```json {"page": "' || event_type || event_id || '"} ```' WHEN 1 THEN '{"page": null}' WHEN 2 THEN 'none' ELSE '{"page": "p' || user_id || '", "n": {"m": 1}} thanks' END"""


@query("f22_salvage_varied", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || event_id WHEN 3 THEN 'p' || user_id END AS page FROM events")
def salvage_varied(spark, sf):
    return table(spark, sf, "events").select("event_id", X.salvage_json(F.expr(_JSON), "page string")["page"].alias("page"))


_ANSWER = "CASE doc_id % 4 WHEN 0 THEN 'the thing ' || source || ' ' || text WHEN 1 THEN 'Désolé, the thing ' || source || repeat(' x', 120) WHEN 2 THEN 'the thing ' || source ELSE text END"
_K2 = _KW.replace("text", "a")
_RESPONSE = f"0.7::DOUBLE * {_K2} + 0.3::DOUBLE * least(1, length(a) / 200.0::DOUBLE)"
_APOLOGY = " OR ".join(f"contains(lower(a), '{p.replace(chr(39), chr(39) * 2)}')" for p in D.FALLBACK_PHRASES)
_SCORED = f"SELECT doc_id, lang, source, {_K2} AS k, n_chars / 100.0 AS s, {_RESPONSE} AS q, ({_APOLOGY}) AS is_fallback, ({_RESPONSE} >= 0.8 AND length(a) >= 200 AND NOT ({_APOLOGY})) AS passed FROM (SELECT *, {_ANSWER} AS a FROM documents)"


def _answered(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.expr(_ANSWER).alias("answer"), F.array(F.lit("the"), F.lit("thing"), F.col("source")).alias("keywords"), (F.col("n_chars") / 100.0).alias("seconds"))
    return E.response(d).withColumn("k", E.keyword_share(F.col("answer"), F.col("keywords")))


@query("e4_response_varied", f"SELECT doc_id, round(q, 2) AS quality_score, is_fallback, passed, NOT passed AS needs_fallback FROM ({_SCORED})")
def response_varied(spark, sf):
    """Good, apologetic, short and off-topic answers."""
    return _answered(spark, sf).select("doc_id", "quality_score", "is_fallback", "passed", "needs_fallback")


@query("e6_pass_at_08", f"SELECT doc_id, (k >= 0.8 AND s < 45) AS passed, CASE WHEN k >= 0.8 AND s < 45 THEN 'none' WHEN k < 0.8 THEN 'quality' ELSE 'time' END AS failure FROM ({_SCORED})")
def pass_at_08(spark, sf):
    return _answered(spark, sf).select("doc_id", E.passes(F.col("k"), F.col("seconds")).alias("passed"), E.failure_kind(F.col("k"), F.col("seconds")).alias("failure"))


@query("e7_pass_at_08", f"SELECT lang, count(*) FILTER (WHERE k >= 0.8 AND s < 30)::BIGINT AS passed, count(*) FILTER (WHERE NOT passed)::BIGINT AS fallbacks, count(*)::BIGINT AS n FROM ({_SCORED}) GROUP BY lang")
def pass_count(spark, sf):
    """Within 30 seconds, and how many answers went to the fallback."""
    good = E.passes(F.col("k"), F.col("seconds"), 0.8, 30.0)
    return _answered(spark, sf).groupBy("lang").agg(F.count_if(good).alias("passed"), F.count_if("needs_fallback").alias("fallbacks"), F.count("*").alias("n"))


@query("e11_compliance_varied", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS compliance FROM documents WHERE text <> ''")
def compliance_varied(spark, sf):
    produced = F.expr("CASE doc_id % 3 WHEN 0 THEN E' \\n\\t' ELSE text || '.' END".replace("E'", "'"))
    return table(spark, sf, "documents").filter("text != ''").select("doc_id", F.when(X.strip(produced) != "", 1.0).otherwise(0.0).alias("compliance"))


_MODELS = f"SELECT source, round(avg(q), 4) AS quality, round(avg(n_chars / 100.0::DOUBLE), 4) AS seconds FROM (SELECT source, n_chars, round({_Q}, 6) AS q FROM documents) GROUP BY source"


@query("a13_best_compromise", f"WITH m AS ({_MODELS}) SELECT source, quality, seconds, rank() OVER (ORDER BY quality DESC)::INT AS by_quality, rank() OVER (ORDER BY seconds)::INT AS by_speed, round(quality / (1 + seconds), 6) = max(round(quality / (1 + seconds), 6)) OVER () AS compromise FROM m")
def best_compromise(spark, sf):
    """Models by quality, by speed, and the one of most quality for its time."""
    d = table(spark, sf, "documents")
    kw = F.array(F.lit("the"), F.lit("thing"), F.col("source"))
    scored = d.select("source", (F.col("n_chars") / 100.0).alias("seconds"), F.round(E.answer_quality(F.col("text"), kw, F.lit(200)), 6).alias("q"))
    return E.ranking(scored.groupBy("source").agg(F.round(F.avg("q"), 4).alias("quality"), F.round(F.avg("seconds"), 4).alias("seconds")))


@query("e19_required_keys", "SELECT id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'content' END, CASE WHEN lang IS NULL THEN 'title' END, CASE WHEN doc_id % 7 = 0 THEN 'source' END], lambda x: x IS NOT NULL), ',') AS missing, vec_id IS NULL AS orphan FROM (SELECT 'c' || doc_id AS id, * FROM documents LEFT JOIN embeddings ON vec_id = doc_id) WHERE doc_id % 5 = 0 OR lang IS NULL OR doc_id % 7 = 0 OR vec_id IS NULL")
def required_keys(spark, sf):
    """Chunks that lack a required key, or whose parent is unknown."""
    d = table(spark, sf, "documents")
    chunks = d.select(F.concat(F.lit("c"), "doc_id").alias("id"), F.col("doc_id").alias("parent_id"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("content"), F.col("lang").alias("title"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"))
    return E.chunk_faults(chunks, table(spark, sf, "embeddings").select(F.col("vec_id").alias("parent_id")), ["content", "title", "source"])


_FIRST = _Q.replace("text", "a")


@query("e20_two_arms", f"WITH p AS (SELECT doc_id, lang, round({_FIRST}, 6) AS q FROM (SELECT doc_id, lang, source, left(text, 120) AS a FROM documents)), f AS (SELECT doc_id, round({_Q}, 6) AS q FROM documents) SELECT lang, round(avg(p.q), 6) AS quality_without, round(avg(f.q), 6) AS quality_with, count(*) FILTER (WHERE f.q > p.q)::BIGINT AS improved FROM p JOIN f USING (doc_id) GROUP BY lang")
def two_arms(spark, sf):
    """Each case run without and with its whole context, scored alike."""
    d = table(spark, sf, "documents")
    kw = F.array(F.lit("the"), F.lit("thing"), F.col("source"))
    arm = lambda text: F.round(E.answer_quality(text, kw, F.lit(200)), 6)
    both = d.select("lang", arm(F.left("text", F.lit(120))).alias("without"), arm(F.col("text")).alias("with"))
    return both.groupBy("lang").agg(F.round(F.avg("without"), 6).alias("quality_without"), F.round(F.avg("with"), 6).alias("quality_with"), F.count_if(F.col("with") > F.col("without")).alias("improved"))


_HINT = " ".join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in D.CATEGORY_HINTS.items())
_WEIGHT = "CASE WHEN hint = category THEN 1.5 " + " ".join(f"WHEN hint = '{a}' AND category = '{b}' THEN {w}" for a, b, w in D.RELATED) + f" WHEN hint = '{D.GENERAL_CATEGORY}' AND category IS NOT NULL THEN 0.6 ELSE 0.0 END"


@query("i17_category_pairs", f"WITH h AS (SELECT doc_id, CASE {_HINT} END AS hint FROM documents), p AS (SELECT doc_id, hint, lag(hint) OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) AS category FROM h) SELECT doc_id, hint, category, ({_WEIGHT})::DOUBLE AS weight FROM p")
def category_pairs(spark, sf):
    """The hints of texts against the categories of the texts before them."""
    w = Window.partitionBy(F.expr("doc_id div 64")).orderBy("doc_id")
    h = table(spark, sf, "documents").select("doc_id", X.category_hint(F.col("text")).alias("hint"))
    return h.withColumn("category", F.lag("hint").over(w)).withColumn("weight", fusion.category_weight(F.col("hint"), F.col("category")).cast("double"))


@query("i27_answers", f"WITH {_BM25}, {_KNN}, {_RRF}, {_BOOST} SELECT query_id, count(*)::BIGINT AS passages, 'answer of ' || sum(length(d.text)) || ' characters' AS answer FROM rt JOIN documents d ON d.doc_id = rt.id WHERE score >= 0.05 GROUP BY query_id")
def answers(spark, sf):
    """Retrieve, filter, generate: in one call."""
    found = R.retrieve(*_hybrid_inputs(spark, sf)).filter("score >= 0.05").groupBy("query_id").agg(F.count("*").alias("passages"), F.sum(F.length("content")).cast("string").alias("prompt"))
    told = providers.generate(found, lambda prompts: [f"answer of {p} characters" for p in prompts])
    return told.select("query_id", "passages", "answer")


@query("f32_titles", r"SELECT DISTINCT lower(trim(coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN ' ' || left(text, 5) || ' ' ELSE '' END), ''), nullif(lang, ''), source))) AS title FROM documents")
def titles(spark, sf):
    """The set of normal titles, from the first field that has one (F32)."""
    own = F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN ' ' || left(text, 5) || ' ' ELSE '' END")
    return table(spark, sf, "documents").select(X.normal_title(X.trim_spaces(own), F.col("lang"), F.col("source")).alias("title")).distinct()


@query("s5_tolerant_lines", "SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 0")
def tolerant_lines(spark, sf):
    """JSON lines of which every fifth is cut short."""
    path = files.scratch(spark, "tolerant")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    line = F.to_json(F.struct("doc_id", "lang"))
    d.select(F.when(F.col("doc_id") % 5 == 0, F.substring(line, 1, 7)).otherwise(line).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "doc_id long, lang string", tolerant=True)


@query("s6_json_arrays", "SELECT doc_id, text FROM documents")
def json_arrays(spark, sf):
    path = f"{files.scratch(spark, 'arrays')}.json"
    files.write_json_array(table(spark, sf, "documents").select("doc_id", "text"), path)
    return files.read_any_json(spark, path, "doc_id long, text string")


@query("s14_read_or_empty", "SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0")
def read_or_empty(spark, sf):
    """Of two files one is missing: nothing comes from it."""
    path = files.scratch(spark, "there")
    files.write_jsonl(table(spark, sf, "documents").filter("doc_id % 2 = 0").select("doc_id", "lang"), path)
    there, missing = (files.read_or_empty(spark, p, "doc_id long, lang string") for p in (path, f"{path}-missing"))
    return there.unionByName(missing)


@query("i3_embed_batched", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND regexp_matches(coalesce(text, ''), '\\S') THEN 1 ELSE 0 END::DOUBLE AS norm FROM documents")
def embed_batched(spark, sf):
    """Vectors in batches of 32; an absent text has a zero vector."""
    rows = providers.embed(table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("text")), "text", providers.hashing_embedder(16, " \n\t\r\f"))
    return rows.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 5).alias("norm"))


_DEEP = "url || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/a/b.html#x.1' WHEN 2 THEN '/c/?q=1/2' ELSE '/d//e/' END"


@query("x21_url_parts_varied", rf"SELECT page_id, regexp_replace(regexp_replace(u, '[?#].*$', ''), '/[^/]*/?$', '') AS parent_url, len(list_filter(string_split(regexp_replace(regexp_replace(u, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/'), lambda x: x <> ''))::INT AS depth, CASE WHEN contains(u, '#') THEN split_part(u, '#', 2) END AS anchor FROM (SELECT page_id, {_DEEP} AS u FROM pages)")
def url_parts_varied(spark, sf):
    """Parents, depths and anchors of urls of several depths."""
    u = F.expr(_DEEP)
    return table(spark, sf, "pages").select("page_id", H.parent_url(u).alias("parent_url"), H.url_depth(u).alias("depth"), H.anchor_of(u).alias("anchor"))


_HEADED = "html || '<h2 id=q>Two ' || page_id || '</h2><h4><b>Deep</b>  er</h4>' || CASE WHEN page_id % 2 = 0 THEN '<h6>six</h6>' ELSE '' END"
_HEADS = "|".join(rf"<h{i}\b[^>]*>.*?</h{i}>" for i in range(1, 7))


@query("x17_outline_varied", rf"WITH h AS (SELECT page_id, regexp_extract_all({_HEADED}, '(?is){_HEADS}') AS t FROM pages) SELECT page_id, (i - 1)::INT AS pos, substr(t[i], 3, 1)::INT AS level, trim(regexp_replace(regexp_replace(t[i], '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM h)")
def outline_varied(spark, sf):
    """Headings of four levels."""
    return H.outline(table(spark, sf, "pages").select("page_id", F.expr(_HEADED).alias("html")))


_BODY = """'<body><h2 id="a' || page_id || '">One</h2><p>' || repeat('word ', CAST(page_id % 90 + 1 AS INT)) || '</p></body>'"""


@query("x13_page_documents", "SELECT page_id, 'a' || page_id AS anchor, length(content) AS n, length(content) < 200 AS short FROM (SELECT page_id, 'One' || chr(10) || trim(repeat('word ', CAST(page_id % 90 + 1 AS INT))) AS content FROM pages) WHERE length(content) >= 50")
def page_documents(spark, sf):
    """Documents of anchors: those under 50 characters go, those under 200 are short."""
    rows = H.anchor_rows(table(spark, sf, "pages").select("page_id", F.expr(_BODY).alias("html")), 50)
    return rows.select("page_id", "anchor", F.length("content").cast("long").alias("n"), (F.length("content") < 200).alias("short"))
