"""Queries that SQL does not express, against plain versions written for this test."""

import html.parser
import math
import re

import pytest

from docengine.functions import dictionaries as D
from docengine.operators import providers
from docengine.registry import ORACLES, QUERIES, table


def rows_of(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def documents(spark, sf):
    return {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}


# ---- chunks


def plain_pieces(text, size=300):
    """Cut at the first separator that occurs, which stays at the head of what follows; longer parts go on with the rest."""
    seps = ["\n\n", "\n    ", "\n  ", "\n", ". ", ", ", "; ", " "]

    def cut(s, level):
        if len(s) <= size:
            return [s] if s else []
        while level < len(seps) and seps[level] not in s:
            level += 1
        if level == len(seps):
            return [s[i : i + size] for i in range(0, len(s), size)]
        out, start = [], 0
        at = s.find(seps[level], 0)
        while at >= 0:
            out += cut(s[start:at], level + 1)
            start = at
            at = s.find(seps[level], at + len(seps[level]))
        return out + cut(s[start:], level + 1)

    return cut(text or "", 0)


def plain_recursive(text, size=300, overlap=150):
    out, window = [], []
    for piece in plain_pieces(text, size):
        length = sum(len(w) for w in window)
        if window and length + len(piece) > size:
            out.append("".join(window).strip())
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window[0])
                window = window[1:]
        window = [*window, piece]
    out.append("".join(window).strip())
    return [x for x in out if x]


def test_recursive_split(spark, sf):
    got = {(r["doc_id"], r["chunk_index"]): r["chunk"] for r in rows_of(spark, sf, "c4_recursive_split")}
    want = {(d, i): p for d, r in documents(spark, sf).items() for i, p in enumerate(plain_recursive(r["text"]))}
    assert got == want and all(len(p) <= 300 for p in want.values())


def test_children_and_coverage(spark, sf):
    parents = {r["seq"]: r["parent_id"] for r in rows_of(spark, sf, "c5_parents")}
    docs, want, shares = documents(spark, sf), set(), {}
    for d, parent in parents.items():
        kept = [p for p in plain_recursive(docs[d]["text"]) if len(p) >= 30][:30]
        want |= {(f"child_{parent}_{i}", parent, p) for i, p in enumerate(kept, 1)}
        share = round(sum(map(len, kept)) / len(docs[d]["text"]), 6)
        verdict = "low" if share < 0.8 else "high" if share > 1.5 else "valid"
        shares[verdict] = shares.get(verdict, 0) + 1
    assert {(r["child_id"], r["parent_id"], r["content"]) for r in rows_of(spark, sf, "c6_children")} == want
    assert {r["verdict"]: r["count"] for r in rows_of(spark, sf, "c7_coverage")} == shares


def test_paragraph_packer(spark, sf):
    def pack(text, size=600):
        units = [(u, glue) for p in re.split("\n\n", text or "") for u, glue in ([(p.strip(), "\n\n")] if len(p.strip()) <= size else [(w, " ") for w in p.split()]) if u]
        out = []
        for u, glue in units:
            if out and len(out[-1]) + len(glue) + len(u) <= size:
                out[-1] += glue + u
            else:
                out.append(u)
        return out

    got = {(r["doc_id"], r["chunk_index"]): r["chunk"] for r in rows_of(spark, sf, "c9_pack_paragraphs")}
    assert got == {(d, i): p for d, r in documents(spark, sf).items() for i, p in enumerate(pack(r["text"]))}


def plain_semantic(text):
    out, rest = [], text
    if len(rest) <= 800:
        return [rest]
    while len(rest) > 800:
        end = 800
        for sep in ("\n\n###", "\n\n##", "\n\n", ". "):
            starts = [i for i in range(300, 801 - len(sep)) if rest.startswith(sep, i)]
            if starts and starts[-1] > 300 and rest.count("```", 0, starts[-1]) % 2 == 0:
                end = starts[-1] + len(sep)
                break
        if rest[:end].strip():
            out.append(rest[:end].strip())
        rest = rest[max(0, end - 150) :]
    return [*out, rest.strip()] if rest.strip() else out


def test_build_chunks(spark, sf):
    merged = []
    by_url = {}
    for d, r in sorted(documents(spark, sf).items()):
        last = by_url.get(r["source"])
        if last and last["seq"] == d - 1 and len(last["content"]) < 300:
            last["content"] += (f"\n\n## {r['lang']}" if r["lang"] != last["title"] else "") + "\n\n" + r["text"]
            last["seq"] = d
        else:
            by_url[r["source"]] = {"first": d, "seq": d, "title": r["lang"], "content": r["text"]}
            merged.append(by_url[r["source"]])
    want, number = {}, 0
    for m in sorted(merged, key=lambda m: m["first"]):
        if not m["content"].strip():
            continue
        pieces = plain_semantic(m["content"])
        for i, p in enumerate(pieces):
            low = p.lower()
            tags = {k for k, words in D.TAG_KEYWORDS.items() if any(w in low for w in words)}
            tags |= {"directive:" + a.replace(" ", "_") for a in D.HTTP_REQUEST_ACTIONS if a in low}
            tags |= {"sample_fetch:" + x for x in re.findall(r"\b(sc\d+_[a-z_]+|table_[a-z_]+)\b", low)[:5]}
            want[number] = (m["first"], i, len(pieces), len(p), "```" in p, ",".join(sorted(tags)))
            number += 1
    got = {r["id"]: (r["seq"], r["chunk_index"], r["total_chunks"], r["char_len"], r["has_code"], r["tags"]) for r in rows_of(spark, sf, "c3_build_chunks")}
    assert got == want


# ---- search


def test_knn_by_text(spark, sf):
    embed = providers.hashing_embedder()
    corpus = [(d, embed([r["text"] or ""])[0]) for d, r in documents(spark, sf).items()]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / ((math.sqrt(sum(x * x for x in a)) or 1e-300) * (math.sqrt(sum(y * y for y in b)) or 1e-300))
    got = {}
    for r in rows_of(spark, sf, "i9_knn_by_text"):
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    vectors = dict(corpus)
    for q in table(spark, sf, "benchmark").collect():
        v = embed([q["text"] or ""])[0]
        sims = sorted((cosine(v, x) for _, x in corpus), reverse=True)[:5]
        own = [cosine(v, vectors[got[q["item_id"]][k]]) for k in range(1, 6)]
        # Vectors are stored as 32-bit floats: the same similarities, in the same order.
        assert all(abs(a - b) < 1e-5 for a, b in zip(own, sims, strict=True))


def test_mmr(spark, sf):
    near = {}
    for r in rows_of(spark, sf, "i7_knn"):
        near.setdefault(r["query_id"], []).append(r)
    picks = {}
    for r in rows_of(spark, sf, "i14_mmr"):
        picks.setdefault(r["query_id"], {})[r["pick"]] = r["id"]
    from pyspark.sql import functions as F

    from docengine.queries.search import _knn

    candidates = {}
    for r in _knn(spark, sf, 30).select("query_id", "id", (1 - F.col("similarity")).alias("d")).collect():
        candidates.setdefault(r["query_id"], []).append((r["d"], r["id"]))
    for q, rows in candidates.items():
        rows = sorted(rows)
        chosen = [rows.pop(0)]
        while rows and len(chosen) < 10:
            scores = [0.5 * (1 - d) - 0.5 * max(0.0, *(1 - abs(d - c) for c, _ in chosen)) for d, _ in rows]
            chosen.append(rows.pop(scores.index(max(scores))))
        assert [picks[q][i] for i in range(1, len(chosen) + 1)] == [i for _, i in chosen]
        assert picks[q][1] == near[q][0]["id"] or near[q][0]["rank"] != 1


# ---- pages


class Converter(html.parser.HTMLParser):
    """Markdown by frames of open elements, closed from the inside out."""

    void = set("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.frames = [["", {}, [], 0]]

    def handle_starttag(self, tag, attrs):
        self.frames.append([tag, dict(attrs), [], 0])
        if tag in self.void:
            self.shut()

    def handle_startendtag(self, tag, attrs):
        self.frames.append([tag, dict(attrs), [], 0])
        self.shut()

    def handle_endtag(self, tag):
        if tag in [f[0] for f in self.frames[1:]]:
            while self.frames[-1][0] != tag:
                self.shut()
            self.shut()

    def handle_data(self, data):
        self.frames[-1][2].append(("", data))

    def shut(self):
        tag, attrs, parts, _ = self.frames.pop()
        self.frames[-1][2].append((tag, attrs, parts))

    def done(self):
        self.close()
        while len(self.frames) > 1:
            self.shut()
        return "".join(map(self.text, self.frames[0][2])).strip()

    def raw(self, part):
        return part[1] if part[0] == "" else "".join(map(self.raw, part[2]))

    def text(self, part):
        if part[0] == "":
            return re.sub(r"\s+", " ", part[1])
        tag, attrs, parts = part
        if tag in ("script", "style", "nav", "footer", "header"):
            return ""
        if tag == "pre":
            return "\n```\n" + "".join(map(self.raw, parts)).strip("\n") + "\n```\n"
        if tag in ("ul", "ol"):
            items = [p for p in parts if p[0] == "li"]
            return "\n" + "".join(("- " if tag == "ul" else f"{i}. ") + self.text(p).strip() + "\n" for i, p in enumerate(items, 1))
        inner = "".join(map(self.text, parts))
        if re.fullmatch("h[1-6]", tag):
            return "\n" + "#" * int(tag[1]) + " " + inner.strip() + "\n"
        wraps = {"p": ("\n", "\n"), "code": ("`", "`"), "strong": ("**", "**"), "b": ("**", "**"), "em": ("*", "*"), "i": ("*", "*"), "a": ("[", f"]({attrs.get('href') or ''})")}
        if tag in wraps:
            return wraps[tag][0] + inner.strip() + wraps[tag][1]
        return "\n" if tag == "br" else inner


def plain_markdown(page):
    c = Converter()
    c.feed(page or "")
    return c.done()


@pytest.fixture(scope="module")
def pages(spark, sf):
    import sys

    sys.setrecursionlimit(20_000)
    return {r["page_id"]: plain_markdown(r["html"]) for r in table(spark, sf, "pages").collect()}


@pytest.mark.parametrize("name", ["x1_markdown", "p2_sql_markdown"])
def test_markdown(spark, sf, pages, name):
    assert {r["page_id"]: r["markdown"] for r in rows_of(spark, sf, name)} == pages


@pytest.mark.parametrize(("name", "levels"), [("x3_sections", range(1, 7)), ("x4_h1_sections", [1])])
def test_sections(spark, sf, pages, name, levels):
    want = set()
    for page, md in pages.items():
        found = [["Introduction", []]]
        for line in md.split("\n"):
            m = re.fullmatch(r"(#{1,6}) (.*)", line)
            if m and len(m[1]) in levels:
                found.append([m[2].strip(), []])
            else:
                found[-1][1].append(line)
        if len(found) == 1:
            title = re.search(r"(?m)^# (.*)$", md)
            found[0][0] = title[1] if title else "Documentation"
        rows = [(t, "\n".join(lines).strip()) for t, lines in found]
        want |= {(page, i, t, c) for i, (t, c) in enumerate(r for r in rows if r[1])}
    assert {(r["page_id"], r["pos"], r["title"], r["content"]) for r in rows_of(spark, sf, name)} == want


def test_what_has_no_sql():
    """Every query without SQL is tested here, in test_indexes.py, or (x11_anchors: no driver page has ids) by one with SQL beside it."""
    assert set(QUERIES) - set(ORACLES) == {"c3_build_chunks", "c4_recursive_split", "c6_children", "c7_coverage", "c9_pack_paragraphs", "i7_vector_index", "i7_vector_recall", "i9_knn_by_text", "i10_block_postings", "i14_mmr", "p2_sql_markdown", "x1_markdown", "x11_anchors", "x3_sections", "x4_h1_sections"}
