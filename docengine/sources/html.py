"""HTML and markdown structuring: a small tree over the standard parser, and JVM expressions where regexes are exact."""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style nav footer header".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def walk(node: Node):
    """Nodes in document order; iterative, so depth has no limit."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


def text_of(node: Node, drop=DROPPED, glue: str = " ") -> str:
    parts, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if n.strip():
                parts.append(" ".join(n.split()))
        elif n.tag not in drop:
            stack.extend(reversed(n.children))
    return glue.join(parts)


def _stripped(parts: deque[str]) -> deque[str]:
    while parts and not (first := parts[0].lstrip()):
        parts.popleft()
    if parts:
        parts[0] = first
    while parts and not (last := parts[-1].rstrip()):
        parts.pop()
    if parts:
        parts[-1] = last
    return parts


def _wrapped(parts: deque[str], before: str, after: str) -> deque[str]:
    parts = _stripped(parts)
    parts.appendleft(before)
    parts.append(after)
    return parts


def _joined(a: deque[str], b: deque[str]) -> deque[str]:
    """The shorter one is moved, so that deep nesting copies no text again and again."""
    if len(a) < len(b):
        b.extendleft(reversed(a))
        return b
    a.extend(b)
    return a


def _marked(node: Node, inner: deque[str]) -> deque[str]:
    t = node.tag
    if t in HEADINGS:
        return _wrapped(inner, f"\n{'#' * int(t[1])} ", "\n")
    if t == "p":
        return _wrapped(inner, "\n", "\n")
    if t == "code":
        return _wrapped(inner, "`", "`")
    if t in ("strong", "b"):
        return _wrapped(inner, "**", "**")
    if t in ("em", "i"):
        return _wrapped(inner, "*", "*")
    if t == "a":
        return _wrapped(inner, "[", f"]({node.attrs.get('href') or ''})")
    if t in ("ul", "ol"):
        inner.appendleft("\n")
        return inner
    return deque(["\n"]) if t == "br" else inner


def markdown(node: Node | str) -> str:
    """Paragraphs, headings, code, links, lists and emphasis; other elements pass through (X1). Iterative, so depth has no limit."""
    root = Node("#root")
    root.children.append(node)
    # Open elements: node, children to come, parts so far, list items so far.
    stack = [[root, iter(root.children), deque(), 0]]
    while True:
        frame = stack[-1]
        child = next(frame[1], None)
        if isinstance(child, str):
            parts = deque([re.sub(r"\s+", " ", child)])
        elif child is None:
            stack.pop()
            parts = _marked(frame[0], frame[2])
            if not stack:
                return "".join(parts)
            frame = stack[-1]
            if frame[0].tag in ("ul", "ol"):
                frame[3] += 1
                parts = _wrapped(parts, "- " if frame[0].tag == "ul" else f"{frame[3]}. ", "\n")
        elif child.tag in DROPPED:
            continue
        elif child.tag == "pre":
            parts = deque([f"\n```\n{_raw(child).strip(chr(10))}\n```\n"])
        else:
            inside = child.children
            if child.tag in ("ul", "ol"):
                inside = [c for c in inside if isinstance(c, Node) and c.tag == "li"]
            stack.append([child, iter(inside), deque(), 0])
            continue
        frame[2] = _joined(frame[2], parts)


def _raw(node: Node) -> str:
    parts, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
        else:
            stack.extend(reversed(n.children))
    return "".join(parts)


def anchors(root: Node) -> list[dict]:
    """Elements with an id (not tab-...), their heading text and the text up to the next id."""
    marks, order = [], list(walk(root))
    for n in order:
        ident = n.attrs.get("id")
        if ident and not ident.startswith("tab-"):
            head = next((c for c in walk(n) if c.tag in HEADINGS), None)
            title = text_of(head or n)
            if title:
                marks.append((n, ident, title))
    wanted = {id(n) for n, _, _ in marks}
    parent = {id(c): n for n in order for c in n.children if isinstance(c, Node)}
    out = []
    for n, ident, title in marks:
        parts = [text_of(n)]
        up = parent.get(id(n))
        after = False
        for sibling in up.children if up else ():
            if sibling is n:
                after = True
            elif after:
                if isinstance(sibling, Node) and any(id(x) in wanted for x in walk(sibling)):
                    break
                parts.append(sibling.strip() if isinstance(sibling, str) else text_of(sibling))
        out.append({"anchor": ident, "title": title, "content": "\n".join(p for p in parts if p)})
    return out


def split_at(html: str | None, levels: tuple[str, ...]) -> list[dict]:
    """Sections at headings of the given levels; the text before the first is 'Introduction'; whole body if there is none."""
    md = markdown(parse(html))
    marks = "|".join("#" * int(h[1]) for h in levels)
    cut = list(re.finditer(rf"(?m)^({marks}) (.*)$", md))
    if not cut:
        title = re.search(r"(?m)^# (.*)$", md)
        return [{"title": title.group(1) if title else "Documentation", "content": md.strip()}] if md.strip() else []
    rows = [{"title": "Introduction", "content": md[: cut[0].start()].strip()}]
    ends = [m.start() for m in cut[1:]] + [len(md)]
    rows += [{"title": m.group(2).strip(), "content": md[m.end() : e].strip()} for m, e in zip(cut, ends, strict=True)]
    return [r for r in rows if r["content"]]


def apply(pages: DataFrame, fields: list[str], f, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row (key, pos, fields) per dict that f(html) returns; parsing runs in Arrow batches."""

    def run(batches):
        for batch in batches:
            keys, pos, out = [], [], {c: [] for c in fields}
            for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, row in enumerate(f(h)):
                    keys.append(k)
                    pos.append(i)
                    for c in fields:
                        out[c].append(row[c])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(pos, pa.int32()), *(pa.array(out[c], pa.string()) for c in fields)], names=[key, "pos", *fields])

    declared = ", ".join(f"`{c}` string" for c in fields)
    return pages.select(key, html).mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, pos int, {declared}")


def to_markdown(pages: DataFrame) -> DataFrame:
    return apply(pages, ["markdown"], lambda h: [{"markdown": markdown(parse(h)).strip()}])


def anchor_rows(pages: DataFrame, least: int = 0) -> DataFrame:
    return apply(pages, ["anchor", "title", "content"], lambda h: [r for r in anchors(parse(h)) if len(r["content"]) >= least])


def sections(pages: DataFrame, levels: tuple[str, ...] = HEADINGS) -> DataFrame:
    return apply(pages, ["title", "content"], lambda h: split_at(h, levels))


def _numbered(node: Node) -> bool:
    parts = (node.attrs.get("id") or "").split(".")
    return node.tag == "a" and "anchor" in (node.attrs.get("class") or "").split() and all(p.isdigit() for p in parts)


def numbered_split(html: str | None, filled: bool = False) -> list[dict]:
    """Sections between numbered anchors, each named by its number and the next heading; the text before them first.

    The heading is an h1 among the anchor's later siblings, or inside a page header there; what stands in a
    <small> before its text is left out.  ``filled``: sections without content are left out, and a heading of
    any level counts.
    """
    root = parse(html)
    wanted = HEADINGS if filled else ("h1",)
    body = next((n for n in walk(root) if n.tag == "body"), root)
    order = [n for n in walk(body) if _numbered(n)]
    parent = {id(c): n for n in walk(body) for c in n.children if isinstance(c, Node)}
    marks = {id(n) for n in order}
    out = []
    text = lambda nodes: "".join(markdown(n) for n in nodes).strip()
    if order and parent[id(order[0])] is body:
        before = body.children[: body.children.index(order[0])]
        if text(before):
            out.append({"title": "", "content": text(before)})
    for n in order:
        siblings = parent[id(n)].children
        after = siblings[next(i for i, c in enumerate(siblings) if c is n) + 1 :]
        own = []
        for c in after:
            if id(c) in marks:
                break
            own.append(c)
        head = None
        for c in after if not filled else own:
            if isinstance(c, Node) and head is None:
                if c.tag in wanted:
                    head = c
                elif c.tag == "div" and ("page-header" in (c.attrs.get("class") or "").split() or filled):
                    head = next((x for x in walk(c) if x.tag in wanted), None)
            if id(c) in marks and head is None:
                break
            if head is not None:
                break
        name, title = n.attrs["id"], ""
        if head is not None:
            small = next((i for i, c in enumerate(head.children) if isinstance(c, Node) and c.tag == "small"), None)
            rest = Node("#part")
            rest.children = head.children if small is None else head.children[small + 1 :]
            title = text_of(rest)
            if small is None and title.startswith(name):
                title = title[len(name) :].lstrip().removeprefix(".").strip()
        row = {"title": f"{name}. {title}" if title else name, "content": text(own)}
        if row["content"] or not filled:
            out.append(row)
    return out


def numbered_sections(pages: DataFrame, filled: bool = False) -> DataFrame:
    return apply(pages, ["title", "content"], lambda h: numbered_split(h, filled))


# ---- expressions


def first_text(html: Column, tag: str) -> Column:
    inner = F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)<[^>]*>", "")
    return F.nullif(F.trim(F.regexp_replace(inner, r"\s+", " ")), F.lit(""))


def title(html: Column) -> Column:
    """The h1, else the title, else '' (X14)."""
    return F.coalesce(first_text(html, "h1"), first_text(html, "title"), F.lit(""))


def plain_text(html: Column, drop: str = "script|style") -> Column:
    """Text without the dropped elements and tags, blanks collapsed."""
    kept = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<({drop})\b[^>]*>.*?</\1>", " ")
    kept = F.regexp_replace(F.regexp_replace(kept, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def main_lines(html: Column) -> Column:
    """The text inside main, else article, else body, without scripts, styles, navigation and footers; a line per piece."""
    h = F.coalesce(html, F.lit(""))
    inner = lambda t: F.regexp_extract(h, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1)
    part = h
    for t in ("body", "article", "main"):
        part = F.when(h.rlike(rf"(?i)<{t}\b"), inner(t)).otherwise(part)
    kept = F.regexp_replace(F.regexp_replace(part, r"(?is)<(script|style|nav|footer)\b[^>]*>.*?</\1>", " "), r"(?s)<!--.*?-->", "")
    pieces = F.transform(F.split(kept, r"(?s)<[^>]*>"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(pieces, lambda x: x != ""), "\n")


def page_title(md: Column, url: Column) -> Column:
    """The first level-1 heading, else the file's name in the address with capitals, else "Documentation" (X8)."""
    stem = F.initcap(F.replace(F.regexp_extract(url, r"/([^/]+)\.html$", 1), F.lit("-"), F.lit(" ")))
    head = F.trim(F.regexp_extract(md, r"(?m)^#\s+(.+)$", 1))
    return F.coalesce(F.nullif(head, F.lit("")), F.nullif(stem, F.lit("")), F.lit("Documentation"))


def outline(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, title of every heading."""
    p = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(p), F.lit(1)).alias("level"), F.regexp_extract_all("html", F.lit(p), F.lit(2)).alias("raw"))
    rows = pages.select("page_id", F.posexplode(both).alias("pos", "h"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("h.raw", r"(?s)<[^>]*>", ""), r"\s+", " "))
    return rows.select("page_id", "pos", F.col("h.level").cast("int").alias("level"), clean.alias("title"))


def links(html: Column) -> Column:
    """Distinct relative links, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda u: (u != "") & ~u.rlike(r"(?i)^(#|https?:|mailto:|ftp:|javascript:)")))


def resolve(base: Column, link: Column) -> Column:
    """A relative link against a page's address: leading slash, ./ and ../."""
    host = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    folder = F.split(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", ""), "/")
    ups = F.regexp_count(link, F.lit(r"\.\./"))
    rest = F.regexp_replace(link, r"^(\./|\.\./)+", "")
    kept = F.slice(folder, F.lit(1), F.greatest(F.lit(3), F.size(folder) - ups))
    return F.when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(F.array_join(kept, "/"), F.lit("/"), rest))


def anchor_of(url: Column) -> Column:
    return F.when(url.contains("#"), F.split_part(url, F.lit("#"), F.lit(2)))


def parent_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/[^/]*/?$", "")


def url_depth(url: Column) -> Column:
    return F.greatest(F.size(F.filter(F.split(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]+", ""), r"[?#].*$", ""), "/"), lambda x: x != "")), F.lit(0))


def anchor_depth(anchor: Column) -> Column:
    """How many numbers the anchor text has, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(anchor, F.lit(r"\d+")))


def section_path(anchor: Column, parent: Column) -> Column:
    """parent, 'Section n', 'n.m', ...: cumulative."""
    n = F.regexp_extract_all(anchor, F.lit(r"\d+"), F.lit(0))
    steps = F.transform(F.sequence(F.lit(1), F.size(n)), lambda i: F.when(i == 1, F.concat(F.lit("Section "), F.element_at(n, 1))).otherwise(F.array_join(F.slice(n, F.lit(1), i), ".")))
    return F.when(F.size(n) > 0, F.concat(F.array(parent), steps)).otherwise(F.array(parent))


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, anchor, number, title, content of headings '# [n.](url#anchor) Title'; the intro has pos 0."""
    pattern = r"(?m)^#+ \s*\[(.*?)\]\(.*?#(.*?)\)\s*(.*?)$"
    mark = "\u0001"
    cut = F.split(F.regexp_replace(text, pattern, f"{mark}$1\u0002$2\u0002$3\u0002"), mark)
    rows = df.select(key, F.posexplode(cut).alias("pos", "part"))
    head = F.col("pos") > 0
    field = lambda i: F.trim(F.split_part("part", F.lit("\u0002"), F.lit(i)))
    content = F.regexp_replace(F.when(head, field(4)).otherwise(F.col("part")), r"^\s+|\s+$", "")
    out = rows.select(key, "pos", F.when(head, field(2)).alias("anchor"), F.when(head, field(1)).alias("number"), F.when(head, field(3)).otherwise("Introduction").alias("title"), content.alias("content"))
    return out.filter("content != ''")


def verified_sections(df: DataFrame, key: str, text: str, url: str) -> DataFrame:
    """Markdown sections with url#anchor, parent_url, parent_title, depth and section_path."""
    heads = df.select(key, F.col(url).alias("parent_url"), page_title(F.col(text), F.col(url)).alias("parent_title"))
    rows = markdown_sections(df, key, text).join(heads, key)
    anchor = F.coalesce("anchor", F.lit(""))
    return rows.select(
        key,
        "pos",
        F.when(F.col("anchor").isNull(), F.col("parent_url")).otherwise(F.concat_ws("#", "parent_url", "anchor")).alias("url"),
        "parent_url",
        "parent_title",
        "title",
        "content",
        anchor_depth(anchor).alias("depth"),
        section_path(anchor, F.col("parent_title")).alias("section_path"),
        "anchor",
    )
