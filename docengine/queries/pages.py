"""HTML structuring, links and hierarchy over `pages`."""

from pyspark.sql import functions as F

from docengine.operators import hierarchy as H
from docengine.registry import ORACLES, query, table
from docengine.sources import html as X

_H = "coalesce(html, '')"


def _pages(spark, sf):
    return table(spark, sf, "pages")


@query("x1_markdown")
def to_markdown(spark, sf):
    return X.to_markdown(_pages(spark, sf))


@query("x3_sections")
def sections(spark, sf):
    return X.sections(_pages(spark, sf))


@query("x4_h1_sections")
def h1_sections(spark, sf):
    return X.sections(_pages(spark, sf), ("h1",))


@query("x11_anchors")
def anchor_rows(spark, sf):
    return X.anchor_rows(_pages(spark, sf), 50)


_ANCHORED = r"""'<body><h2 id="a' || page_id || '">One <i>' || page_id || '</i></h2><p>' || repeat('word ', CAST(page_id % 20 + 1 AS INT)) || '</p><div id="tab-1">hidden tab</div><p id="b">Two</p> tail ' || url || '<section id="c"><h3>Three</h3> in it</section></body>'"""


@query("x12_anchor_content", r"""WITH r AS (SELECT page_id, 0 AS pos, 'a' || page_id AS anchor, 'One ' || page_id AS title, 'One ' || page_id || chr(10) || trim(repeat('word ', CAST(page_id % 20 + 1 AS INT))) || chr(10) || 'hidden tab' AS content FROM pages
UNION ALL SELECT page_id, 1, 'b', 'Two', 'Two' || chr(10) || 'tail ' || regexp_replace(url, '\s+', ' ', 'g') FROM pages UNION ALL SELECT page_id, 2, 'c', 'Three', 'Three in it' FROM pages),
k AS (SELECT * FROM r WHERE length(content) >= 30)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INT AS pos, anchor, title, content, length(content) < 200 AS short FROM k""")
def anchor_content(spark, sf):
    """Documents of a page's anchors: ids but tab-..., first heading, the text up to the next id, length bounds."""
    rows = X.anchor_rows(_pages(spark, sf).select("page_id", F.expr(_ANCHORED).alias("html")), 30)
    return rows.withColumn("short", F.length("content") < 200)


_NUMBERED = r"""'<body><p>Head of ' || page_id || '</p><a class="anchor" id="1"></a><h1><small>1.</small> First ' || page_id || '</h1><p>' || url || '</p><a class="anchor" id="toc"></a><a class="anchor" id="2.1"></a><div class="page-header"><h1>2.1. Second</h1></div><a class="anchor" id="3"></a><p>no heading</p>' || CASE WHEN page_id % 2 = 0 THEN '<a class="anchor" id="4"></a>' ELSE '' END || '</body>'"""


@query("x2_numbered_sections", r"""SELECT page_id, 0 AS pos, '' AS title, 'Head of ' || page_id AS content FROM pages UNION ALL SELECT page_id, 1, '1. First ' || page_id, '# 1. First ' || page_id || chr(10) || chr(10) || url || chr(10) || '[]()' FROM pages
UNION ALL SELECT page_id, 2, '2.1. Second', '# 2.1. Second' FROM pages UNION ALL SELECT page_id, 3, '3', 'no heading' FROM pages UNION ALL SELECT page_id, 4, '4', '' FROM pages WHERE page_id % 2 = 0""")
def numbered_sections(spark, sf):
    """Sections at numbered anchors, with the text before the first."""
    return X.numbered_sections(_pages(spark, sf).select("page_id", F.expr(_NUMBERED).alias("html")))


@query("x3_numbered_sections", r"""SELECT page_id, 0 AS pos, '' AS title, 'Head of ' || page_id AS content FROM pages UNION ALL SELECT page_id, 1, '1. First ' || page_id, '# 1. First ' || page_id || chr(10) || chr(10) || url || chr(10) || '[]()' FROM pages
UNION ALL SELECT page_id, 2, '2.1. Second', '# 2.1. Second' FROM pages UNION ALL SELECT page_id, 3, '3', 'no heading' FROM pages""")
def numbered_sections_filled(spark, sf):
    """The same without empty sections, at headings of any level."""
    return X.numbered_sections(_pages(spark, sf).select("page_id", F.expr(_NUMBERED).alias("html")), filled=True)


@query("x5_h2_fallback", r"""SELECT page_id, 0 AS pos, CASE WHEN page_id % 3 = 0 THEN 'Top ' || page_id ELSE 'Documentation' END AS title, CASE WHEN page_id % 3 = 0 THEN '# Top ' || page_id || chr(10) || chr(10) ELSE '' END || 'only text ' || page_id AS content FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 0, 'Introduction', CASE WHEN page_id % 3 = 0 THEN '# Top ' || page_id || chr(10) || chr(10) ELSE '' END || 'only text ' || page_id FROM pages WHERE page_id % 2 = 1
UNION ALL SELECT page_id, 1, 'Part', 'of it' FROM pages WHERE page_id % 2 = 1""")
def h2_fallback(spark, sf):
    """Sections at h2; without one the whole body, named by its h1 or by default."""
    html = F.expr("CASE WHEN page_id % 3 = 0 THEN '<h1>Top ' || page_id || '</h1>' ELSE '' END || '<p>only text ' || page_id || '</p>' || CASE WHEN page_id % 2 = 1 THEN '<h2>Part</h2><p>of it</p><h2>Empty</h2>' ELSE '' END")
    return X.sections(_pages(spark, sf).select("page_id", html.alias("html")), ("h2",))


_T = r"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '')"


@query("x14_title", f"SELECT page_id, coalesce({_T.format(t='h1')}, {_T.format(t='title')}, '') AS title FROM pages")
def title(spark, sf):
    return _pages(spark, sf).select("page_id", X.title(F.col("html")).alias("title"))


def _plain(names: list[str]) -> str:
    inner = _H
    pattern = "|".join(rf"<{n}\b[^>]*>.*?</{n}>" for n in names)
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({inner}, '(?is)({pattern})', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("x16_plain_text", f"SELECT page_id, {_plain(['script', 'style'])} AS text FROM pages")
def plain_text(spark, sf):
    return _pages(spark, sf).select("page_id", X.plain_text(F.col("html")).alias("text"))


@query("x15_main_text", f"SELECT page_id, {_plain(['script', 'style', 'nav', 'footer'])} AS text FROM pages")
def main_text(spark, sf):
    return _pages(spark, sf).select("page_id", X.plain_text(F.col("html"), "script|style|nav|footer").alias("text"))


@query("x17_outline", r"WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1) AS t FROM pages) SELECT page_id, (i - 1)::INT AS pos, 1 AS level, trim(regexp_replace(regexp_replace(t[i], '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM h)")
def outline(spark, sf):
    return X.outline(_pages(spark, sf)).filter("level = 1")


_HEADS = "|".join(rf"<h{i}\b[^>]*>.*?</h{i}>" for i in range(1, 7))


@query("x17_outline_all", rf"WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is){_HEADS}') AS t FROM pages) SELECT page_id, (i - 1)::INT AS pos, substr(t[i], 3, 1)::INT AS level, trim(regexp_replace(regexp_replace(t[i], '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM h)")
def outline_all(spark, sf):
    return X.outline(_pages(spark, sf))


_LINKS = r"""list_filter(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1), lambda u: trim(u)), lambda u: u <> '' AND NOT regexp_matches(u, '(?i)^(#|https?:|mailto:|ftp:|javascript:)'))"""


@query("x18_links", f"SELECT DISTINCT page_id, unnest({_LINKS}) AS link FROM pages")
def links(spark, sf):
    return _pages(spark, sf).select("page_id", F.explode(X.links(F.col("html"))).alias("link"))


@query("x19_resolve", f"SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || link AS target FROM (SELECT page_id, url, unnest({_LINKS}) AS link FROM pages) WHERE starts_with(link, '/')")
def resolve(spark, sf):
    rows = _pages(spark, sf).select("page_id", "url", F.explode(X.links(F.col("html"))).alias("link")).filter("startswith(link, '/')")
    return rows.select("page_id", X.resolve(F.col("url"), F.col("link")).alias("target")).distinct()


#: A link, and what it is under http://h/a/b/c.html.
_RELATIVE = (("x.html", "http://h/a/b/x.html"), ("./x.html#y", "http://h/a/b/x.html#y"), ("../x.html", "http://h/a/x.html"), ("../../x.html", "http://h/x.html"), ("../../../x.html", "http://h/x.html"), ("/x/y.html", "http://h/x/y.html"), ("../z/x.html?q=1", "http://h/a/z/x.html?q=1"))
_TARGETS = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{t.replace('x', 'p')}'" for i, (_, t) in enumerate(_RELATIVE)) + " END"
_RELATIVES = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{t.replace('x', 'p')}'" for i, (t, _) in enumerate(_RELATIVE)) + " END"


@query("x19_resolve_relative", f"SELECT page_id, replace({_TARGETS}, 'http://h/', 'http://h' || page_id || '/') AS target FROM pages")
def resolve_relative(spark, sf):
    """Links with ./ and ../, also above the root."""
    base = F.expr("'http://h' || page_id || '/a/b/c.html' || CASE WHEN page_id % 2 = 0 THEN '#frag' ELSE '?q=/z/' END")
    return _pages(spark, sf).select("page_id", X.resolve(base, F.expr(_RELATIVES)).alias("target"))


@query("x20_normal_url", "SELECT page_id, split_part(url, '#', 1) AS url FROM pages")
def normal_url(spark, sf):
    return _pages(spark, sf).select("page_id", F.split_part("url", F.lit("#"), F.lit(1)).alias("url"))


@query("x21_url_parts", r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*/?$', '') AS parent_url, len(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/'), lambda x: x <> ''))::INT AS depth FROM pages")
def url_parts(spark, sf):
    return _pages(spark, sf).select("page_id", X.parent_url(F.col("url")).alias("parent_url"), X.url_depth(F.col("url")).alias("depth"))


@query("x9_anchor_depth", r"SELECT page_id, greatest(1, len(regexp_extract_all(url, '\d+')))::INT AS depth FROM pages")
def anchor_depth(spark, sf):
    return _pages(spark, sf).select("page_id", X.anchor_depth(F.col("url")).alias("depth"))


_ANCHOR = "CASE page_id % 4 WHEN 0 THEN '5.' || page_id WHEN 1 THEN '5.' || page_id || '.2' WHEN 2 THEN '7' ELSE 'intro' END"


@query("x10_section_path", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Doc > Section 5 > 5.' || page_id WHEN 1 THEN 'Doc > Section 5 > 5.' || page_id || ' > 5.' || page_id || '.2' WHEN 2 THEN 'Doc > Section 7' ELSE 'Doc' END AS path, CASE page_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END::INT AS depth FROM pages")
def section_path(spark, sf):
    anchor = F.expr(_ANCHOR)
    return _pages(spark, sf).select("page_id", F.array_join(X.section_path(anchor, F.lit("Doc")), " > ").alias("path"), X.anchor_depth(anchor).alias("depth"))


_INTRO = "CASE WHEN doc_id % 3 = 0 THEN '# Title ' || doc_id || chr(10) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'before' END"
_MD = _INTRO + " || chr(10) || '## [5.' || doc_id || '.](http://x/the-page.html#5.' || doc_id || ') Head ' || lang || chr(10) || 'body ' || source || chr(10) || '### [6.](http://x/y.html#6) Empty' || chr(10) || '## [7.1.](p#7.1) Last' || chr(10) || text"


@query("x6_markdown_sections", f"""WITH d AS (SELECT *, {_INTRO} AS intro FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, 0 AS pos, NULL AS anchor, NULL AS number, 'Introduction' AS title, trim(intro, E' \\n') AS content FROM d WHERE trim(intro, E' \\n') <> ''
UNION ALL SELECT doc_id, 1, '5.' || doc_id, '5.' || doc_id || '.', 'Head ' || lang, 'body ' || source FROM d
UNION ALL SELECT doc_id, 3, '7.1', '7.1.', 'Last', trim(text, E' \\n\\t\\r') FROM d WHERE trim(text, E' \\n\\t\\r') <> ''""")
def markdown_sections(spark, sf):
    return X.markdown_sections(_md_rows(spark, sf), "doc_id", "md").select("doc_id", "pos", "anchor", "number", "title", "content")


def _md_rows(spark, sf):
    d = table(spark, sf, "documents").filter("lang is not null and source is not null and text is not null")
    return d.select("doc_id", F.lit("http://x/the-page.html").alias("url"), F.expr(_MD).alias("md"))


@query("x7_verified_sections", """WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id ELSE 'The Page' END AS page_title FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL),
r AS (SELECT doc_id, 0 AS pos, page_title, NULL AS anchor FROM d WHERE doc_id % 3 = 0 OR doc_id % 4 <> 0 UNION ALL SELECT doc_id, 1, page_title, '5.' || doc_id FROM d UNION ALL SELECT doc_id, 3, page_title, '7.1' FROM d WHERE trim(text, E' \\n\\t\\r') <> '')
SELECT doc_id, pos, CASE WHEN anchor IS NULL THEN 'http://x/the-page.html' ELSE 'http://x/the-page.html#' || anchor END AS url, 'http://x/the-page.html' AS parent_url, page_title AS parent_title,
 CASE pos WHEN 0 THEN 1 ELSE 2 END::INT AS depth, CASE pos WHEN 0 THEN page_title WHEN 1 THEN page_title || ' > Section 5 > ' || anchor ELSE page_title || ' > Section 7 > 7.1' END AS section_path, anchor FROM r""")
def verified_sections(spark, sf):
    """Sections with the fields of a page's hierarchy."""
    out = X.verified_sections(_md_rows(spark, sf), "doc_id", "md", "url")
    return out.select("doc_id", "pos", "url", "parent_url", "parent_title", "depth", F.array_join("section_path", " > ").alias("section_path"), "anchor")


@query("x8_page_title", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Head ' || page_id WHEN 1 THEN 'My Page' WHEN 2 THEN 'Documentation' ELSE 'Two' END AS title FROM pages")
def page_title(spark, sf):
    md = F.expr("CASE page_id % 4 WHEN 0 THEN 'x\\n#  Head ' || page_id || ' \\n# Second' WHEN 3 THEN '## no\\n# Two' ELSE 'plain\\n## Lower' END")
    url = F.expr("CASE page_id % 4 WHEN 1 THEN 'http://h/a/my-page.html' WHEN 0 THEN 'http://h/other.html' ELSE 'http://h/no-page' END")
    return _pages(spark, sf).select("page_id", X.page_title(md, url).alias("title"))


_INNER = r"regexp_extract(html, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1)"
_BLANKED = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({x}, '(?is)<(script|style|nav|footer)\b[^>]*>.*?</(script|style|nav|footer)>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>'), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '')"


@query("x15_main_lines", rf"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(replace(html, '<article', '<main'), '</article', '</main') WHEN 1 THEN html ELSE replace(replace(html, '<article', '<div'), '</article', '</div') END AS html FROM pages),
m AS (SELECT page_id, CASE WHEN html ILIKE '%<main%' THEN {_INNER.format(t='main')} WHEN html ILIKE '%<article%' THEN {_INNER.format(t='article')} WHEN html ILIKE '%<body%' THEN {_INNER.format(t='body')} ELSE html END AS x FROM p)
SELECT page_id, sha256(array_to_string({_BLANKED.format(x='x')}, E'\n')) AS text_sha256 FROM m""")
def main_lines(spark, sf):
    """The text of main, else article, else body, a line per piece of text; compared before entities are resolved."""
    html = F.expr("CASE page_id % 3 WHEN 0 THEN replace(replace(html, '<article', '<main'), '</article', '</main') WHEN 1 THEN html ELSE replace(replace(html, '<article', '<div'), '</article', '</div') END")
    return _pages(spark, sf).select("page_id", F.sha2(X.main_lines(html), 256).alias("text_sha256"))


def _tree(spark, sf):
    p = _pages(spark, sf)
    return p.select("url", X.parent_url(F.col("url")).alias("parent_url"))


_TREE = r"t AS (SELECT url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*/?$', '') AS parent_url FROM pages), o AS (SELECT DISTINCT url FROM t), e AS (SELECT DISTINCT url, parent_url FROM t WHERE parent_url <> '' AND parent_url <> url)"


@query("h1_nodes", f"WITH {_TREE}, k AS (SELECT parent_url AS url, count(*) AS c FROM e GROUP BY 1) SELECT coalesce(o.url, k.url) AS url, coalesce(c, 0)::BIGINT AS children, o.url IS NULL AS implied FROM o FULL JOIN k ON o.url = k.url")
def nodes(spark, sf):
    return H.nodes(_tree(spark, sf))


@query("h2_orphans", f"WITH {_TREE} SELECT url, parent_url FROM t WHERE parent_url <> '' AND parent_url <> url AND parent_url NOT IN (SELECT url FROM o)")
def orphans(spark, sf):
    return H.orphans(_tree(spark, sf))


@query("h3_depths", "SELECT 'p' || doc_id::VARCHAR AS url, length(bin(doc_id + 1))::INT AS depth FROM documents")
def depths(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    up = F.when(F.col("doc_id") > 0, F.concat(F.lit("p"), F.floor((F.col("doc_id") - 1) / 2).cast("string")))
    return H.depths(d.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("url"), up.alias("parent_url")))


@query("h3_depth_jumps", ORACLES["h3_depths"])
def depth_jumps(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    up = F.when(F.col("doc_id") > 0, F.concat(F.lit("p"), F.floor((F.col("doc_id") - 1) / 2).cast("string")))
    return H.depths_by_jumps(d.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("url"), up.alias("parent_url")))


@query("h3_chain_depths", "SELECT 'p' || doc_id::VARCHAR AS url, (doc_id - min(doc_id) OVER (PARTITION BY doc_id - n) + 1)::INT AS depth FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)")
def chain_depths(spark, sf):
    """Every document under the one before it: as deep as there are documents, in steps of a logarithm."""
    d = table(spark, sf, "documents").select("doc_id")
    return H.depths_by_jumps(d.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("p"), (F.col("doc_id") - 1).cast("string")).alias("parent_url")))
