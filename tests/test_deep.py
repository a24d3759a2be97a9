"""Scans, jumps, statistics, keyword tables, stores, encodings, rates and stateful sessions at their edges."""

import random
import time

import pytest
from pyspark.sql import functions as F

import docengine.registry as registry
from docengine.operators import chunking, hierarchy, keywords, providers, statistics
from docengine.operators.evaluate import wilcoxon_p
from docengine.plans import agent
from docengine.sources import files, keyed
from docengine.streaming import stateful


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_of_one_hot_url(spark, seed):
    r = random.Random(seed)
    rows, seq = [], 0
    for _ in range(900):
        seq += r.choice([1, 1, 1, 1, 1, 1, 2, 40])
        rows.append((seq, r.choice(["hot"] * 20 + ["cold", None]), r.choice(["a", "bb", None]), "x" * r.choice([0, 0, 1, 3, 9, 25])))
    df = spark.createDataFrame(rows, "seq long, url string, title string, content string").repartition(4)
    plain = sorted(map(tuple, chunking.merge_short(df, 20).filter("url is not null").collect()), key=str)
    assert plain == sorted(map(tuple, chunking.merge_short_split(df, 20, block=16).filter("url is not null").collect()), key=str)
    assert len({p[0] for p in plain}) < 880
    with pytest.raises(ValueError):
        chunking.merge_short_split(df, 300, block=100)


def test_chain_of_pages(spark):
    pages = spark.range(100_000).select(F.concat(F.lit("p"), "id").alias("url"), F.when(F.col("id") > 0, F.concat(F.lit("p"), (F.col("id") - 1).cast("string"))).alias("parent_url"))
    got = hierarchy.depths_by_jumps(pages).agg(F.count("*"), F.max("depth"), F.count_if(F.col("depth") == F.substring("url", 2, 9).cast("int") + 1)).first()
    assert tuple(got) == (100_000,) * 3


def test_jumps_over_cycles_and_many_parents(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("c", "x"), ("d", "c"), ("e", "f"), ("f", "e"), ("g", "g"), ("h", "e"), ("h", "d"), ("i", "nowhere"), ("j", "")]
    df = spark.createDataFrame(rows, "url string, parent_url string")
    want = {(r.url, r.depth) for r in hierarchy.depths(df).collect()}
    assert {(r.url, r.depth) for r in hierarchy.depths_by_jumps(df).collect()} == want == {("a", 1), ("b", 2), ("c", 1), ("d", 2), ("g", 1), ("h", 3), ("i", 1), ("j", 1)}
    assert hierarchy.depths_by_jumps(df.limit(0)).count() == 0


def test_paired_statistics(spark):
    r = random.Random(4)
    rows = [(float(r.randint(0, 9)), float(r.randint(1, 10))) for _ in range(300)] + [(None, 1.0)]
    got = statistics.paired(spark.createDataFrame(rows, "a double, b double").repartition(5), "a", "b").first()
    d = [b - a for a, b in rows if a is not None]
    assert got.n == 300 and got.improved == sum(x > 0 for x in d) and abs(got.p - wilcoxon_p(d)) < 1e-12
    # Student's 97.5 % quantiles as printed in tables.
    for freedom, q in ((1, 12.7062), (2, 4.3027), (5, 2.5706), (30, 2.0423), (1000, 1.9623)):
        assert abs(statistics.student_quantile(0.975, freedom) - q) < 1e-4
    none = statistics.paired(spark.createDataFrame([], "a double, b double"), "a", "b").first()
    assert none.n == 0 and none.p is None and none.low is None
    same = statistics.paired(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double"), "a", "b").first()
    assert same.p == 1.0 and same.low == same.high == 0.0


def test_keywords_in_blocks(spark, monkeypatch):
    words = [f"k{i}" for i in range(3000)] + ["", None, "a b", "é"]
    texts = [(i, f"x k{i} a b é") for i in range(50)] + [(90, None), (91, "")]
    want = {(i, w) for i, t in texts if t for w in words if w and w in t}
    for chars in (1 << 20, 4000):
        monkeypatch.setattr(keywords, "AUTOMATON_CHARS", chars)
        got = keywords.containing(spark.createDataFrame(texts, "i long, t string"), "i", "t", spark.createDataFrame([(w,) for w in words], "keyword string"))
        assert {tuple(r) for r in got.collect()} == want
    assert keywords.containing(spark.createDataFrame(texts, "i long, t string"), "i", "t", spark.createDataFrame([], "keyword string")).count() == 0


def listed(path):
    import pathlib

    return {str(f): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("*.parquet")}


def test_upsert_leaves_other_parts_alone(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    keyed.create(spark.range(200).select(F.col("id").alias("k"), F.lit(0).alias("v"), F.lit("old").alias("x")), path, "k", 32)
    before = listed(tmp_path)
    new = spark.createDataFrame([(5, 1, "new"), (900, 1, "new"), (6, -1, "older")], "k long, v int, x string")
    keyed.upsert(spark, path, new, "v")
    after = {r.k: r.x for r in keyed.read(spark, path).collect()}
    assert len(after) == 201 and after[5] == after[900] == "new" and after[6] == "old"
    made = listed(tmp_path)
    assert before.items() <= made.items() and len(made) - len(before) <= 3
    bad = new.withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        keyed.upsert(spark, path, bad, "v")
    assert {r.k: r.x for r in keyed.read(spark, path).collect()} == after
    keyed.delete(spark, path, spark.range(10).withColumnRenamed("id", "k"))
    assert keyed.read(spark, path).count() == 191 and keyed.manifest(spark, path)["version"] == 3
    # Of two changes from one version the second finds its number taken.
    state = keyed.manifest(spark, path)
    with pytest.raises(RuntimeError):
        keyed._publish(spark, path, state)


def test_each_file_in_its_own_encoding(spark, tmp_path):
    for i, encoding in enumerate(("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-32-le")):
        (tmp_path / f"{i}.json").write_bytes(f'{{"i": {i}, "t": "é{i}"}}\n{{"i": {i + 10}, "t": "ß"}}\n'.encode(encoding))
    (tmp_path / "none.json").write_bytes(b"")
    got = {(r.i, r.t) for r in files.read_detected(spark, f"file://{tmp_path}", "i long, t string").collect()}
    assert got == {(i, f"é{i}") for i in range(7)} | {(i + 10, "ß") for i in range(7)}


def test_one_rate_for_all_tasks(spark):
    rows = spark.range(40).select("id", F.concat(F.lit("text "), "id").alias("t")).repartition(7)
    began = time.time()
    got = providers.embed_at_rate(rows, "t", providers.hashing_embedder(8), gap=0.05, lanes=4).collect()
    stamps = sorted(r.called_at for r in got)
    assert len(got) == 40 and time.time() - began > 39 * 0.05
    # Calls fall into slots of their own; waking takes less than half a slot.
    assert min(b - a for a, b in zip(stamps, stamps[1:], strict=False)) > 0.02


def test_session_comes_back_after_it_expired(spark, tmp_path):
    base = f"file://{tmp_path}"
    feeds = [[(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 01:00:00", 2)], [(3, "2024-01-03 00:00:00", 3), (None, "2024-01-03 00:00:00", 4)], [(1, "2024-01-03 12:00:00", 5), (1, "2024-01-01 00:30:00", 6)]]
    schema = "key long, ts timestamp, number long"
    for feed in feeds:
        spark.createDataFrame([(k, t, n) for k, t, n in feed], "key long, ts string, number long").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        stateful.advance(stateful.session_updates(stream, cap=2), f"{base}/out", f"{base}/checkpoint")
    got = {r.key: (r.messages, r.kept, r.expired) for r in stateful.latest(spark, f"{base}/out").collect()}
    # Session 1 starts anew after its timer; the late row is left out.
    assert got == {1: (1, [5], False), 2: (1, [2], True), 3: (1, [3], False)}


def test_cap_of_a_session(spark):
    rows = spark.range(500).select(F.lit(7).cast("long").alias("key"), F.timestamp_seconds(F.col("id") + 86400).alias("ts"), F.col("id").alias("number"))
    got = stateful.replay(rows, feeds=3).first()
    assert got.messages == 500 and got.kept == list(range(450, 500)) and not got.expired


def test_new_queries_are_registered():
    assert {"z1_stateful", "c1_merge_split", "h3_depth_jumps", "a16_signed_rank", "j5_keyword_table", "k6_upsert_parts", "s7_mixed_encodings"} <= set(registry.ORACLES)


def test_agent_without_work_and_with_nulls(spark):
    schema = "conv_id long, turn long, role string, text string"
    keep = lambda texts: [f"tool: {t}" for t in texts]
    tool = lambda calls: calls.select("conv_id", F.lit(None).cast("string").alias("result"))
    done = spark.createDataFrame([(1, 0, "assistant", "bye"), (None, 0, "user", "x")], schema)
    assert agent.run(done, keep, tool, keep).count() == 0
    asks = spark.createDataFrame([(1, 0, "user", None), (2, 3, None, "q"), (2, 1, "assistant", "x")], schema)
    got = sorted((r.conv_id, r.step, r.role) for r in agent.run(asks, keep, tool, lambda t: ["end"] * len(t), budget=2).collect())
    assert got == [(c, i + 1, role) for c in (1, 2) for i, role in enumerate(["assistant", "tool", "assistant", "tool", "assistant"])]


def test_streamed_answers_are_cut_off(spark):
    def slow(prompt):
        for i in range(4):
            time.sleep(0.3 if prompt == "slow" else 0)
            yield f"{i} "

    rows = spark.createDataFrame([("slow",), ("quick",), (None,)], "prompt string").coalesce(1)
    got = {r.prompt: (r.answer, r.timed_out) for r in agent.streamed(rows, slow, seconds=0.7).collect()}
    assert got["quick"] == got[None] == ("0 1 2 3 ", False) and got["slow"][1] and got["slow"][0].startswith("0 ")
