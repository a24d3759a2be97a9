"""Scalar functions over `documents` and `benchmark`."""

from pyspark.sql import functions as F

from docengine.functions import dictionaries as D
from docengine.functions import text as X
from docengine.registry import query, table

_STOP = ", ".join(f"'{w}'" for w in D.STOPWORDS)
_TOK = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9\-\.]*[a-z0-9]|[a-z0-9]'), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"
_JS = "lambda x: x"


@query("f15_tokens", f"SELECT doc_id, array_to_string({_TOK}, ' ') AS tokens, len({_TOK})::BIGINT AS n FROM documents")
def tokens(spark, sf):
    t = X.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


@query("f16_blank_tokens", r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> ''))::BIGINT AS n FROM documents")
def blank_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.blank_tokens(F.col("text"))).cast("long").alias("n"))


@query("f1_validate_query", r"""SELECT item_id, CASE WHEN regexp_matches(text, '(?is)<[^>]*>') THEN 'HTML tags' END AS error,
CASE WHEN NOT regexp_matches(text, '(?is)<[^>]*>') THEN regexp_replace(left(trim(text), 2000), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') END AS cleaned FROM benchmark""")
def validate_query(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.query_error(F.col("text")).alias("error"), X.clean_query(F.col("text")).alias("cleaned"))


@query("f2_scrub_input", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)javascript:', '', 'g'), '(?is)<[^>]*>', '', 'g'), E' \t\n\r')) > 0 AS any_text FROM pages")
def scrub(spark, sf):
    return table(spark, sf, "pages").select("page_id", (F.length(X.scrub_input(F.col("html"), 1 << 30)) > 0).alias("any_text"))


_RAW = "CASE doc_id % 8 WHEN 0 THEN '  ' || source || ' ' WHEN 1 THEN source || ' $where' WHEN 2 THEN ' ' WHEN 3 THEN '__proto__' WHEN 4 THEN 'eval(' || source || ')' WHEN 5 THEN '<script src=x>' WHEN 6 THEN 'no such source' ELSE source END"


@query("f3_source_filter", f"""WITH r AS (SELECT doc_id, trim({_RAW}) AS raw FROM documents), a AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
SELECT doc_id, CASE WHEN raw = '' OR contains(raw, '$where') OR contains(raw, '__proto__') OR contains(raw, 'eval(') OR contains(raw, '<script') THEN NULL ELSE raw END AS safe, CASE WHEN raw IN (SELECT source FROM a) THEN raw END AS allowed FROM r""")
def source_filter(spark, sf):
    """Injections, blanks and unknown sources are refused; the allowed set is a table, joined."""
    d = table(spark, sf, "documents").select("doc_id", X.source_filter(F.expr(_RAW)).alias("safe"))
    known = table(spark, sf, "documents").filter("source is not null").select(F.col("source").alias("allowed")).distinct()
    return d.join(known, F.col("safe") == F.col("allowed"), "left").select("doc_id", "safe", "allowed")


@query("f4_sanitize", r"SELECT doc_id, left(trim(text, E' \t\n\r'), 500) AS clean FROM documents")
def sanitize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sanitize(F.col("text")).alias("clean"))


@query("f5_sanitize_list", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ' ')[1:20], lambda x: left(trim(x, E' \t\n\r'), 5)), lambda x: x <> ''), '|') AS items FROM documents")
def sanitize_list(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.sanitize_list(F.split("text", " "), 20, 5), "|").alias("items"))


@query("f6_scalarise", "SELECT doc_id, array_to_string(string_split(text, ' '), ', ') AS joined FROM documents")
def scalarise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.split("text", " "), ", ").alias("joined"))


@query("f7_clean_title", r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 200) AS title FROM documents")
def clean_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_title(F.col("text")).alias("title"))


@query("f8_clean_content", r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n') AS content FROM documents")
def clean_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_content(F.col("text")).alias("content"))


@query("f9_detect_source", "SELECT page_id, CASE WHEN contains(url, 'intro') THEN 'intro' WHEN contains(url, 'configuration') THEN 'configuration' WHEN contains(url, 'management') THEN 'management' ELSE 'unknown' END AS kind FROM pages")
def detect_source(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.detect_source(F.col("url")).alias("kind"))


@query("f10_has_code", "SELECT doc_id, contains(text, '```') AS has_code FROM documents")
def has_code(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.has_code(F.col("text")).alias("has_code"))


_TITLE = "CASE doc_id % 5 WHEN 0 THEN '5.' || doc_id || '. Server' WHEN 1 THEN '5.2.' || doc_id || ' Deep ' || lang WHEN 2 THEN 'Plain ' || lang WHEN 3 THEN '' ELSE '12.7' END"


@query("f11_section_levels", f"""WITH t AS (SELECT doc_id, {_TITLE} AS title FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '5' WHEN 1 THEN '5.2' WHEN 4 THEN '12' END AS parent, CASE doc_id % 5 WHEN 0 THEN '5.' || doc_id WHEN 1 THEN '5.2.' || doc_id WHEN 2 THEN title WHEN 4 THEN '12.7' END AS current FROM t""")
def section_levels(spark, sf):
    parent, current = X.section_levels(F.expr(_TITLE))
    return table(spark, sf, "documents").select("doc_id", parent.alias("parent"), current.alias("current"))


_TAGS = ", ".join(f"CASE WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in ws)} THEN '{k}' END" for k, ws in D.TAG_KEYWORDS.items())


@query("f12_tags", f"SELECT doc_id, array_to_string(list_sort(list_filter([{_TAGS}], lambda x: x IS NOT NULL)), ',') AS tags FROM documents")
def tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.tags(F.col("text")), ",").alias("tags"))


@query("f13_chunk_keywords", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_append(list_filter([{_TAGS}], lambda x: x IS NOT NULL), lower(source)))), ',') AS keywords FROM documents")
def chunk_keywords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.chunk_keywords(X.tags(F.col("text")), F.array("source")), ",").alias("keywords"))


@query("f14_embed_text", r"SELECT doc_id, 'Section ' || source || ' | ' || lang || E'\n\n' || text AS embed_text FROM documents")
def embed_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.embed_text(F.col("source"), F.col("lang"), F.col("text")).alias("embed_text"))


_EXPANSIONS = {"thing": ["item", "object"], "tion": ["action"], "zu": ["to"]}
_EXP = " ".join(f"|| CASE WHEN contains(lower(text), '{k}') THEN {v!r} ELSE [] END" for k, v in _EXPANSIONS.items())


@query("f17_expand", f"SELECT item_id, array_to_string(list_sort(list_distinct({_TOK} {_EXP})), ' ') AS terms FROM benchmark")
def expand(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.expand(X.tokens(F.col("text")), F.col("text"), _EXPANSIONS), " ").alias("terms"))


_EXP_ALL = " ".join(f"|| CASE WHEN contains(lower(text), '{k}') THEN {list(v)!r} ELSE [] END" for k, v in {**D.QUERY_EXPANSIONS, "http": D.HTTP_EXPANSIONS}.items())


@query("f17_expand_all", f"SELECT item_id, array_to_string(list_sort(list_distinct({_TOK} {_EXP_ALL})), ' ') AS terms FROM benchmark")
def expand_all(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.expand(X.tokens(F.col("text")), F.col("text")), " ").alias("terms"))


_SEC = " || ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {v!r} ELSE []::VARCHAR[] END" for k, v in D.SECTION_HINTS.items())


@query("f18_section_hints", f"SELECT doc_id, array_to_string(list_sort(list_distinct({_SEC})), ',') AS hints FROM documents")
def section_hints(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.array_join(X.section_hints(F.col("text")), ","), F.lit("")).alias("hints"))


@query("f18_explicit_sections", f"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'see Section 5.' || (doc_id % 9) || ' ' WHEN 1 THEN 'chapitre ' || (doc_id % 9) || ' ' WHEN 2 THEN 'the section of ' ELSE '' END || text AS text FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '5.' || (doc_id % 9) WHEN 1 THEN (doc_id % 9) || '.0' ELSE array_to_string(list_sort(list_distinct({_SEC})), ',') END AS hints FROM t""")
def explicit_sections(spark, sf):
    """A number in the text wins over contained keywords."""
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN 'see Section 5.' || (doc_id % 9) || ' ' WHEN 1 THEN 'chapitre ' || (doc_id % 9) || ' ' WHEN 2 THEN 'the section of ' ELSE '' END || text")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.array_join(X.section_hints(text), ","), F.lit("")).alias("hints"))


_CAT = "CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in D.CATEGORY_HINTS.items()) + " END"


@query("f19_category_hint", f"SELECT doc_id, {_CAT} AS category FROM documents")
def category_hint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.category_hint(F.col("text")).alias("category"))


@query("f20_target_sections", f"SELECT doc_id, array_to_string({_SEC}, ',') AS sections FROM documents")
def target_sections(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.target_sections(F.col("text")), ",").alias("sections"))


@query("f21_head_tail", r"SELECT doc_id, CASE WHEN length(text) > 5000 THEN left(text, 2500) || E'\n[...]\n' || right(text, 2500) ELSE text END AS cut FROM documents")
def head_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.head_tail(F.col("text")).alias("cut"))


@query("f22_salvage_json", "SELECT event_id, (props::JSON ->> 'page') AS page FROM events")
def salvage_json(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", X.salvage_json(F.concat(F.lit("answer: ```json "), "props", F.lit(" ```")), "page string")["page"].alias("page"))


@query("f23_code_block", r"SELECT doc_id, nullif(trim(text, E' \n\t\r'), '') AS code FROM documents WHERE NOT contains(text, '`')")
def code_block(spark, sf):
    d = table(spark, sf, "documents").filter("not contains(text, '`')")
    return d.select("doc_id", X.code_block(F.concat(F.lit("see:\n```cfg\n"), "text", F.lit("\n```\nend"))).alias("code"))


@query("f23_code_block_all", r"SELECT doc_id, nullif(trim(CASE WHEN contains(text, '```') THEN left(text, strpos(text, '```') - 1) ELSE text END, E' \n\t\r'), '') AS code FROM documents")
def code_block_all(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.code_block(F.concat(F.lit("see:\n```cfg\n"), "text", F.lit("\n```\nend"))).alias("code"))


#: Lines of answers: the text, and the type it is to be given (null: no error line).
_CLAIMS = (("Error: bad syntax here", "syntax"), ("all fine", None), ("  WARNING: a security hole", "security"), ("", None), ("invalid logic of the check", "logic"), ("error: undefined backend", "reference"), ("erreur de référence", "reference"), ("some other Error", "other"))
_CLAIM_ROWS = ", ".join(f"({i}, '{text}', {'NULL' if kind is None else repr(kind)})" for i, (text, kind) in enumerate(_CLAIMS))


@query("f24_claimed_errors", f"""WITH k(i, line, kind) AS (VALUES {_CLAIM_ROWS}), p AS (SELECT doc_id, i, line, kind, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS line_no FROM documents, k WHERE (doc_id >> i) & 1 = 1)
SELECT doc_id, line_no, kind AS error_type, trim(line) AS message FROM p WHERE kind IS NOT NULL""")
def claimed_errors(spark, sf):
    """An answer has the lines that the bits of doc_id choose."""
    chosen = F.array_compact(F.array(*[F.when(F.expr(f"shiftright(doc_id, {i}) & 1") == 1, F.lit(text)) for i, (text, _) in enumerate(_CLAIMS)]))
    d = table(spark, sf, "documents").select("doc_id", F.array_join(chosen, "\n").alias("answer"))
    return X.claimed_errors(d).select("doc_id", "line_no", "error_type", "message")


@query("f25_truncate_context", r"""WITH p AS (SELECT doc_id, string_split(text, E'\n') AS p, text FROM documents),
u AS (SELECT doc_id, text, p, list_transform(range(1, len(p) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))) AS s FROM p),
k AS (SELECT doc_id, text, p, len(list_filter(s, lambda x: x <= 600)) AS k FROM u)
SELECT doc_id, CASE WHEN length(text) <= 600 THEN text WHEN k > 0 THEN array_to_string(p[1:k], E'\n') || E'\n\n[...]' ELSE left(p[1], 600) || E'\n\n[...]' END AS context FROM k""")
def truncate_context(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate_context(F.col("text"), 600, "\n").alias("context"))


@query("f27_model_filter", "SELECT source, NOT contains(source, 'src1') AS kept FROM (SELECT DISTINCT source FROM documents)")
def model_filter(spark, sf):
    return table(spark, sf, "documents").select("source").distinct().select("source", X.model_kept(F.col("source"), ("src1",), ()).alias("kept"))


_MODEL = "source || CASE doc_id % 4 WHEN 0 THEN '-Q4_K.GGUF' WHEN 1 THEN ':7b' WHEN 2 THEN '/x.gguf' ELSE '-embed' END"


@query("f28_model_kind", f"SELECT DISTINCT {_MODEL} AS model, doc_id % 4 IN (0, 2) AS gguf FROM documents WHERE source IS NOT NULL")
def model_kind(spark, sf):
    names = table(spark, sf, "documents").filter("source is not null").select(F.expr(_MODEL).alias("model")).distinct()
    return names.select("model", X.is_gguf(F.col("model")).alias("gguf"))


@query("f30_prompt", r"SELECT doc_id, E'Context:\n' || lang || E'\n\nConfiguration:\n' || text AS prompt FROM documents")
def prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.prompt(F.col("text"), F.col("lang")).alias("prompt"))


@query("f31_allowed_sources", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def allowed_sources(spark, sf):
    return table(spark, sf, "documents").filter("source is not null").select("source").distinct()


@query("f32_normal_urls", "SELECT DISTINCT split_part(url, '#', 1) AS url FROM pages WHERE url <> ''")
def normal_urls(spark, sf):
    return table(spark, sf, "pages").filter("url != ''").select(X.normal_url(F.col("url")).alias("url")).distinct()


@query("f33_title_contains", "SELECT count(*)::BIGINT AS n FROM documents WHERE contains(lower(text), 'thing')")
def title_contains(spark, sf):
    return table(spark, sf, "documents").filter(F.lower("text").contains("thing")).agg(F.count("*").alias("n"))
