"""Shapes the driver's tables lack: fences, ids, cycles, quirks, ties."""

import pathlib
import random
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docengine.functions import text as X
from docengine.operators import chunking as C
from docengine.operators import evaluate as E
from docengine.operators import fusion, hierarchy, lint, providers, vectors
from docengine.sources import files, html
from docengine.streaming import sessions


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@given(st.text(alphabet="ab .\n`#", min_size=0, max_size=2500))
@settings(max_examples=60, deadline=None)
def test_semantic_split_covers(text):
    out = C.semantic_split(text)
    assert all(len(p) <= 803 for p in out)
    assert len(text) > 800 or out == [text]
    for p in out:
        assert p in text


def test_semantic_split_keeps_fences():
    text = "a" * 350 + ". " + "```\n" + "x\n\n" * 200 + "\n```\n" + "b" * 300
    first = C.semantic_split(text)[0]
    assert first.count("```") % 2 == 0 and first.endswith("a.")


@given(st.text(alphabet="ab ,.;\n", max_size=3000))
@settings(max_examples=60, deadline=None)
def test_recursive_split_is_bounded(text):
    out = C.recursive_split(text)
    assert all(0 < len(p) <= 300 for p in out)
    assert set("".join(out)) >= set(text.strip()) - set(" \n")


def test_merge_short(spark):
    rows = [(0, "u", "t", "a"), (1, "u", "t", "b" * 300), (2, "u", "s", "c"), (3, "v", "s", "d"), (4, "u", "s", "e")]
    got = {r["seq"]: r for r in C.merge_short(spark.createDataFrame(rows, "seq long, url string, title string, content string")).collect()}
    assert sorted(got) == [0, 2, 3, 4]
    assert got[0]["content"] == "a\n\n" + "b" * 300
    assert got[2]["content"] == "c" and got[4]["content"] == "e"


def test_sequence_is_dense(spark):
    got = C.with_sequence(spark.range(1000).withColumn("k", F.col("id") % 7).drop("id").withColumn("r", F.rand(1)), ["k", "r"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1000))
    assert [(r["k"], r["r"]) for r in got] == sorted((r["k"], r["r"]) for r in got)


def test_query_validation(spark):
    c = F.col("q")
    assert one(spark, X.query_error(c), q="  ") == "empty"
    assert one(spark, X.query_error(c), q="x <script>a</script>") == "script tags"
    assert one(spark, X.query_error(c), q="{{a\nb}}") == "template injection"
    assert one(spark, X.clean_query(c), q=" a\x01b\n ") == "ab"
    assert one(spark, X.scrub_input(c), q="<b>hi</b> javascript:x") == "hi x"
    assert one(spark, X.source_filter(c), q="$ne") is None


def test_text_functions(spark):
    parent, current = X.section_levels(F.col("t"))
    assert one(spark, F.concat_ws("|", parent, current), t="5.2.1. Options") == "5.2|5.2.1"
    assert one(spark, current, t="Intro") == "Intro"
    assert one(spark, X.code_block(F.col("t")), t="x ```\na = 1\n``` y") == "a = 1"
    assert one(spark, X.tags(F.col("t")), t="ACL with sc0_conn_rate and TLS") == ["acl", "rate_limit", "sample_fetch:sc0_conn_rate", "ssl", "stick-table"]
    assert one(spark, X.section_hints(F.col("t")), t="see section 7") == ["7.0"]
    assert one(spark, X.category_hint(F.col("t")), t="an expert") == "stick-table"
    assert one(spark, X.salvage_json(F.col("t"), "a int")["a"], t='so: {"a": 3} ok') == 3
    assert one(spark, X.salvage_json(F.col("t"), "a int"), t="none") is None
    assert one(spark, X.truncate_context(F.col("t"), 5, "-"), t="abc-def-gh") == "abc\n\n[...]"
    assert one(spark, X.truncate_context(F.col("t"), 2, "-"), t="abc-def") == "ab\n\n[...]"


def test_html(spark):
    page = '<html><body><nav id="n">no</nav><h1 id="top">Title <small>x</small></h1><p>One <b>two</b></p><ul><li>a</li><li>b</li></ul><pre>x  y</pre><h2 id="tab-1">T</h2><h2 id="s">Sec</h2><p>body</p></body></html>'
    md = html.markdown(html.parse(page))
    assert "# Title x" in md and "One **two**" in md and "- a\n- b" in md and "```\nx  y\n```" in md and "no" not in md.split()
    got = {a["anchor"]: a for a in html.anchors(html.parse(page))}
    assert set(got) == {"top", "s"} and "body" in got["s"]["content"] and "body" not in got["top"]["content"]
    assert [s["title"] for s in html.split_at(page, ("h2",))] == ["Introduction", "T", "Sec"] or [s["title"] for s in html.split_at(page, ("h2",))] == ["Introduction", "Sec"]
    assert html.split_at("plain", ("h2",)) == [{"title": "Documentation", "content": "plain"}]
    assert html.split_at(None, ("h2",)) == []
    base, link = F.col("b"), F.col("l")
    assert one(spark, html.resolve(base, link), b="http://h/a/b/c.html", l="../x.html") == "http://h/a/x.html"
    assert one(spark, html.resolve(base, link), b="http://h/a.html", l="./x.html") == "http://h/x.html"


def test_hierarchy(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("s", "s"), ("o", "gone"), ("x", "y"), ("y", "x")]
    p = spark.createDataFrame(rows, "url string, parent_url string")
    assert {r["url"]: r["depth"] for r in hierarchy.depths(p).collect()} == {"a": 1, "b": 2, "c": 3, "s": 1, "o": 1}
    assert [r["url"] for r in hierarchy.orphans(p).collect()] == ["o"]
    assert {r["url"] for r in hierarchy.nodes(p).filter("implied").collect()} == {"gone"}
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "url string, target string")
    assert [(r["url"], r["hops"]) for r in hierarchy.crawl(links, "a").collect()] == [("a", 0), ("b", 1), ("c", 2)]


CONFIG = "global\nfrontend f\n bind :70000\n bind *:443 ssl verify none\n option httplog\n mode fast\n use_backend x if bad\nlisten x\n server a 254.1.1.1:80\n server a 1.1.1.1:0\n timeout connect 2h\n timeout foo 1s\n timeout connect -5"


def test_lint(spark):
    df = spark.createDataFrame([(1, CONFIG), (2, None)], "config_id long, config string")
    rules = lambda mode: sorted(r["rule"] for r in lint.findings(df, mode).collect())
    ref = rules("reference")
    assert ref.count("section") == 2 and "option_typo" in ref and "ip" in ref and "backend_undefined" in ref and "mode" not in ref and "server_repeated" in ref
    strict = rules("strict")
    assert strict.count("section") == 3 and "option_typo" not in strict and "ip" not in strict and "backend_undefined" not in strict and "mode" in strict and "acl_undefined" in strict
    s = {r["config_id"]: r for r in lint.summary(df, lint.findings(df)).collect()}
    assert s[2]["compliance"] == 1.0 and s[2]["label"] == "excellent" and s[1]["compliance"] < 0.7


def test_threshold_filter_equals_the_loop(spark):
    r = random.Random(5)
    rows = [(q, p, r.choice([0.0, 0.04, 0.06, 0.1, 0.14, 0.16, 0.3])) for q in range(60) for p in range(r.randint(1, 15))]
    got = {(x["query_id"], x["pos"]) for x in fusion.threshold_filter(spark.createDataFrame(rows, "query_id long, pos long, score double"), 3).collect()}
    want = set()
    for q in range(60):
        own, seen, kept = [x for x in rows if x[0] == q], 0, []
        for _, p, s in own:
            if s >= 0.15 or (s >= 0.05 and seen < 3):
                kept.append(p)
            seen += s >= 0.05
        want |= {(q, p) for p in (kept or [x[1] for x in own][:3])}
    assert got == want


def test_fusion_ties(spark):
    a = spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5), (1, 9, 0.1)], "query_id long, id long, score double")
    assert [r["id"] for r in fusion.top(a, 2).orderBy("rank").collect()] == [3, 5]
    picks = fusion.mmr(spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.1), (1, 3, 0.6)], "query_id long, id long, distance double"), 2, 0.3)
    assert [r["id"] for r in picks.orderBy("pick").collect()] == [1, 3]


def test_nearest_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = df.filter("id < 5").select(F.col("id").alias("query_id"), "embedding")
    for metric in ("cosine", "ip", "l2"):
        got = vectors.nearest(df, q, 4, metric).collect()
        assert len(got) == 20 and all(x["id"] == x["query_id"] for x in got if x["rank"] == 1 and metric != "ip")
    assert vectors.nearest(df, q.filter("false"), 4).count() == 0


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in providers.embed(df, "text", providers.hashing_embedder(8)).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and set(got[2]) == {0.0} == set(got[3])
    assert [r["answer"] for r in providers.generate(df.select("id", F.col("text").alias("prompt")), lambda p: [x.upper() for x in p]).orderBy("id").collect()] == ["A B", "", ""]


def test_evaluation(spark):
    assert E.wilcoxon_p([]) == 1.0 and E.wilcoxon_p([1, 2, 3, 4, 5, 6, 7, 8]) < 0.05 < E.wilcoxon_p([1, -1, 2, -2])
    df = spark.createDataFrame([("Sorry, not available " + "x" * 300, ["x"])], "answer string, keywords array<string>")
    r = E.response(df).first()
    assert r["is_fallback"] and not r["passed"] and r["quality_score"] == 1.0
    assert one(spark, E.detection_rate(F.col("a"), F.col("b")), a=["x"], b=[]) == 1.0


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int", tolerant=True).collect()) == [1, 2]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_any_json(spark, str(tmp_path / "b.json"), "a int").count() == 2
    assert files.read_or_empty(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.md").write_text("# Head\nbody")
    (tmp_path / "t" / "y.txt").write_text("body")
    assert {r["title"] for r in files.read_texts(spark, str(tmp_path / "t")).collect()} == {"Head", "y"}
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, v long, x string")
    assert files.write_collection(df, str(tmp_path / "c")) == 2
    files.upsert(spark, str(tmp_path / "c"), spark.createDataFrame([(1, 2, "z")], df.schema), "k", "v", str(tmp_path / "d"))
    assert {(r["k"], r["x"]) for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {(1, "z"), (2, "b")}
    assert files.without(spark, str(tmp_path / "d"), df.filter("k = 1"), "k").count() == 1


def test_session_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-03 00:00:00"), (2, "2024-02-01 00:00:00")], "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(src))
    out = sessions.session_stream(spark.readStream.schema("user_id long, ts timestamp").parquet(str(src)))
    q = out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("closed").collect()
    assert sorted(r["messages"] for r in rows if r["user_id"] == 1) == [1, 2]


def test_chunks_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.split(empty, "text", C.semantic_split).count() == 0
    assert C.split(spark.createDataFrame([(1, None)], empty.schema), "text", C.recursive_split).count() == 0


def test_sql_chunks_of_all_documents(spark, sf):
    from docengine.registry import QUERIES

    got = QUERIES["p1_sql_chunks_all"](spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in got} == set(docs)
    assert sorted((r["doc_id"], r["chunk_index"], r["chunk"]) for r in got) == sorted((k, i, c) for k, t in docs.items() for i, c in enumerate(C.semantic_split(t)))
    assert max(r["chunk_index"] for r in got) > 0


def test_crawl_of_all_documents_stops_at_its_limit(spark, tmp_path):
    from docengine.registry import QUERIES

    spark.range(3000).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["hops"], r["url"]) for r in QUERIES["x22_crawl_all"](spark, str(tmp_path)).collect()]
    assert got == sorted(((i + 1).bit_length() - 1, f"p{i}") for i in range(3000))[:1000]


def test_outline_of_all_levels(spark, tmp_path):
    from docengine.registry import ORACLES, QUERIES

    from .oracle import TABLES, same

    page = "<h2 id='a'>Two <b>b</b></h2><p>x</p><H1>One</H1><h6>Six\n six</h6><h3>Three</h3>"
    pages = spark.createDataFrame([(1, "u", page), (2, "v", "<p>none</p>")], "page_id long, url string, html string")
    for t in TABLES:
        (pages if t == "pages" else spark.range(1)).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = QUERIES["x17_outline_all"](spark, str(tmp_path))
    assert [(r["pos"], r["level"], r["title"]) for r in got.orderBy("pos").collect()] == [(0, 2, "Two b"), (1, 1, "One"), (2, 6, "Six six"), (3, 3, "Three")]
    same(got, ORACLES["x17_outline_all"], str(tmp_path))


@pytest.mark.parametrize("tag", ["p", "b", "li", "div", "ul><li", "pre"])
def test_markdown_of_unclosed_tags_keeps_all_text(tag):
    page = "<h1>Top</h1>" + "".join(f"<{tag}>word{i} " for i in range(1000)) + "<h2>End</h2>last"
    md = html.markdown(html.parse(page))
    assert [w for w in md.replace("*", " ").split() if w.startswith("word")] == [f"word{i}" for i in range(1000)]
    assert "last" in md and "last" in html.split_at(page, ("h1", "h2"))[-1]["content"]


def test_full_dictionaries(spark):
    c = F.col("t")
    assert one(spark, X.tokens(c), t="Le serveur et les ports are from the list and more") == ["serveur", "ports", "list", "and", "more"]
    assert one(spark, X.tags(c), t="uses http_req_cnt; http-request set-header X") == ["directive:http-request_set-header", "stick-table", "timeout"]
    for text, hint in (("Désactiver x", "backend"), ("leastconn", "loadbalancing"), ("délai", "timeout"), ("surveillance", "stats"), ("uppercase", "advanced"), ("ciphers", "ssl"), ("zzz", None)):
        assert one(spark, X.category_hint(c), t=text) == hint
    assert one(spark, X.expand(X.tokens(c), c), t="TLS over http") == ["HTTP", "cafile", "certificate", "crt", "http", "http-request", "http-response", "httpchk", "over", "ssl", "tls", "verify"]
    assert one(spark, X.code_block(c), t="Voici. Configuration corrigée :\nbind *:80\nmode tcp\n\nFin") == "bind *:80\nmode tcp"
    assert one(spark, X.code_block(c), t="So:\nglobal\n  # note\n  daemon\n\ndefaults\n mode http\nThis is all the text\nnever") == "global\ndaemon\ndefaults\nmode http\nThis is all the text"
    assert one(spark, X.code_block(c), t="no code") is None and one(spark, X.code_block(c), t="```cfg\n\n```") is None


def test_code_block_of_texts_with_backticks(spark, tmp_path):
    from docengine.registry import QUERIES

    spark.createDataFrame([(1, "use `a` here"), (2, "x\n```y"), (3, "plain")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["code"] for r in QUERIES["f23_code_block_all"](spark, str(tmp_path)).collect()} == {1: "use `a` here", 2: "x", 3: "plain"}


def test_retrieval_with_expansion(spark):
    from docengine.plans import retrieve as R

    chunks = spark.createDataFrame([(1, "cafile and crt lines", "a", "x", ["pem"], ["TLS"])] + [(i, f"other words {i}", "b", "x", [], []) for i in range(2, 9)], "id long, text string, title string, category string, keywords array<string>, synonyms array<string>")
    vectors_ = spark.createDataFrame([(8, [1.0, 0.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "tls")], "query_id long, text string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(R.hybrid(chunks, vectors_, queries, asked)) == {8}
    assert ids(R.hybrid(chunks, vectors_, queries, asked, expand=True)) == {1, 8}
    score = lambda c: next(r["score"] for r in R.retrieve(c, vectors_, queries, asked, expand=True).collect() if r["id"] == 1)
    plain = score(chunks.drop("keywords", "synonyms"))
    assert score(chunks) == pytest.approx(plain + 0.16 / 61, abs=1e-8)
    assert plain == pytest.approx((1 + 0.5 * 2 / 6) / 61, abs=1e-8)


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; from pyspark.sql import SparkSession as S; assert len(e.queries()) >= len(e.oracle_sql()) > 100; assert S.getActiveSession() is None"
    root = pathlib.Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.parametrize("name", sorted(p.stem for p in pathlib.Path(__file__).parents[1].glob("docengine/queries/[a-z]*.py")))
def test_query_module_first(name):
    """Executors import the module of a shipped function before any other of the library."""
    code = f"import docengine.queries.{name}; from docengine.registry import ORACLES, QUERIES; print(len(QUERIES), len(ORACLES))"
    root = pathlib.Path(__file__).parents[1]
    found = [subprocess.run([sys.executable, "-c", c], cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout for c in (code, code.replace(f"queries.{name}", "registry"))]
    assert found[0] == found[1]
