"""Operators 11 to 13 against brute force, their SQL on planted tables, and awkward tables."""

import heapq
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import conversation_repair, embedding_dedup, queries, spelling

from ..oracle import same

# ---- 11


def plain_near(rows, threshold=0.93):
    """vec_id -> (links, component) by all pairs; vec_ids are unique here."""
    good = {k: (label, np.array(v, float)) for k, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    to = {k: k for k, _, _ in rows}
    links = dict.fromkeys(to, 0)

    def top(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in itertools.combinations(good, 2):
        (la, x), (lb, y) = good[a], good[b]
        if la == lb and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
            links[a] += 1
            links[b] += 1
            p, q = sorted((top(a), top(b)))
            to[q] = p
    return {k: (links[k], top(k)) for k in to}


def planted_vectors(seed, n=900, width=24):
    r = np.random.default_rng(seed)
    rows = []
    centres = r.normal(size=(12, width))
    for i in range(n):
        kind = i % 6
        c = centres[i % 12]
        # Chains, near copies around the threshold, exact copies, and scaled copies.
        v = c + r.normal(size=width) * (0.05, 0.25, 0.28, 0.31, 0.0, 1.0)[kind]
        rows.append((i, [float(x) for x in (v * (1 if i % 5 else 1000)).astype(np.float32)], int(i % 12 // 6)))
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_vectors_against_all_pairs(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rows = planted_vectors(7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = embedding_dedup.near_duplicates(df).cache()
    want = plain_near(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())
    assert len({c for _, c in want.values()}) > 20 and max(n for n, _ in want.values()) > 20
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("region nation customer supplier part orders lineitem events documents pages benchmark labels conversations").split():
        df.limit(1).write.parquet(f"{tmp_path}/{name}.parquet")
    same(got, embedding_dedup.ORACLE, str(tmp_path))


def test_error_bound_holds():
    r = np.random.default_rng(3)
    for width in (1, 2, 64, 3000):
        a = embedding_dedup.Block(np.arange(40), np.ones(40, int), r.normal(size=(40, width)) * 10.0 ** r.integers(-30, 30, size=(40, 1)))
        near = embedding_dedup.code_products(a.codes, a.codes) * (a.scale[:, None] * a.scale)
        true = (a.raw / a.length[:, None]) @ (a.raw / a.length[:, None]).T
        e, f = a.left[:, None], a.left
        assert (np.abs(near - true) <= e + f + e * f + embedding_dedup.SLACK).all()


def test_steps_of_a_tile(monkeypatch):
    rows = planted_vectors(8, 300)
    one = embedding_dedup.Block(np.arange(300), np.ones(300, int), np.array([v for _, v, _ in rows]))
    want = embedding_dedup.tile_links(one, None, 0.93)
    monkeypatch.setattr(embedding_dedup, "STEP", 64)
    got = embedding_dedup.tile_links(one, None, 0.93)
    assert dict(zip(got[0], got[1], strict=True)) == dict(zip(want[0], want[1], strict=True)) and len(got[2]) == len(want[2]) < len(got[0])


def test_threshold_is_met_exactly(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.93, (1 - 0.93**2) ** 0.5], 0), (3, [0.0, 1.0], 0), (4, [0.0, -1.0], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == plain_near(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, -0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 0)]
    rows += [(8, [1.0, 0.0], 0), (9, [1.0, -0.0], 0), (10, [1e300, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.0], 1), (13, [5e-324, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("node", "rep", "key", "side", "n", "width", "blocks", "own", "other", "component"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {**{k: (0, k, True) for k in (1, 2, 3, 4, 5, 6, 7, 11, 12)}, None: (0, None, False), 8: (3, 8, True), 9: (3, 8, False), 10: (3, 8, False), 13: (3, 8, False)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    # Labels of other types; a vec_id of two vectors ties their groups.
    twice = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [0.0, 2.0], "a"), (3, [1.0, 0.0], "a"), (3, [1.0, 0.0], "a")]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(twice, "vec_id long, embedding array<double>, label string")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]


# ---- 12


def plain_damage(rows):
    """The contract's damage, row by row."""
    out = {}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    return out


def plain_repair(rows):
    """Dijkstra over (row, state) with the letters in the key: the first to arrive is cheapest, then ASCII-least."""
    import hashlib

    out = {}
    for conv, damaged in plain_damage(rows).items():
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in damaged:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
            seen.add((role, text))
        turns = {t for t, _, _ in damaged if t is not None}
        initials = [r[1][:1] for r in damaged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        ways = {"": "su", "s": "u", "u": "a", "a": "u"}
        heap, done = [(0, "", 0, "", ())], set()
        while heap:
            cost, audit, i, last, lines = heapq.heappop(heap)
            if i == len(damaged) and last in ("", "a"):
                break
            if (i, last) in done:
                continue
            done.add((i, last))
            for x in ways[last].replace("s", ""):
                heapq.heappush(heap, (cost + 5, audit + "I", i, x, (*lines, {"u": "user", "a": "assistant"}[x] + ":")))
            if i < len(damaged):
                _, role, text = damaged[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
                if faults[i] not in "bd":
                    more = 5 if faults[i] == "t" else 0
                    if role[:1] and role[:1] in ways[last]:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                    for x in ways[last].replace("s", ""):
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, x, (*lines, {"u": "user", "a": "assistant"}[x] + f":{text}")))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def random_conversations(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n", None, "é. ", "Yes.\t", "x.y"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys", "unknown"]
    return [(c if r.random() < 0.99 else None, r.choice([*range(10), None]), r.choice(roles), r.choice(texts)) for c in range(n) for _ in range(r.randint(1, 9))]


def repaired_rows(df):
    return {r[0]: tuple(r)[1:] for r in conversation_repair.repair(df).collect()}


def test_conversations_against_search(spark):
    rows = random_conversations(5, 700)
    got = repaired_rows(spark.createDataFrame(rows, CONVERSATIONS).repartition(7))
    assert got == plain_repair(rows)
    # To insert costs more than to delete what lacks a partner, so no cheapest repair does.
    assert {x for r in got.values() for x in r[6]} == set("DKR")


def plain_audit(signature, insert):
    """As in plain_repair, of a signature: cost and letters."""
    ways, heap, done = {"": "su", "s": "u", "u": "a", "a": "u"}, [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(signature) and last in ("", "a"):
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))
        to = ways[last].replace("s", "")
        heapq.heappush(heap, (cost + insert, audit + "I", i, to))
        if i < len(signature):
            sign = signature[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
            if sign != "x":
                more = 5 * sign.isupper()
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, to))
                if sign.lower() in ways[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, sign.lower()))


@pytest.mark.parametrize("insert", [1, 2, 5])
def test_signatures_against_search(monkeypatch, insert):
    monkeypatch.setattr(conversation_repair, "_INSERTS", [(*w[:3], insert) for w in conversation_repair._INSERTS])
    trie, r = conversation_repair.Trie(), random.Random(insert)
    signatures = sorted({"".join(r.choices("xsuaoSUAO", k=r.randint(0, 9))) for _ in range(1500)})
    answers = {s: trie.answer(s) for s in signatures}
    assert answers == {s: plain_audit(s, insert) for s in signatures}
    assert any("I" in a for _, a in answers.values()) == (insert < 5)


def test_conversations_query(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, sf).collect()}
    assert got == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_shared_prefixes_are_computed_once():
    signatures = sorted({"".join(s) for n in range(6) for s in itertools.product("sua", repeat=n)})
    trie = conversation_repair.Trie()
    answers = {s: trie.answer(s) for s in signatures}
    assert trie.computed == sum(3**n for n in range(1, 6))
    assert answers == {s: conversation_repair.Trie().answer(s) for s in signatures}


def test_long_and_awkward_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(20_000)]
    rows += [(2, None, None, None), (None, None, None, None), (None, 3, "user", "a."), (3, 5, "user", "a b " * 40_000)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    for c in ("h", "gone", "digest", "seen", "fault", "signature", "kind", "audit", "copy", "initial"):
        df = df.withColumn(c, F.lit("clash"))
    got = repaired_rows(df.repartition(3))
    small = plain_repair([r for r in rows if r[0] != 1])
    assert {k: v for k, v in got.items() if k != 1} == small
    assert got[1][0] > 0 and len(got[1][6]) > 19_000 and set(got[1][6]) <= set("DIKR")
    assert conversation_repair.repair(df.limit(0)).count() == 0


def test_dropped_conversations_are_reported(spark):
    alone = [(c, 0, "user", "Hello there.") for c in range(400)]
    got = repaired_rows(spark.createDataFrame(alone, CONVERSATIONS))
    assert got == plain_repair(alone) | {c: (0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855") for c, rows in plain_damage(alone).items() if not rows}
    assert len(got) == 400 and sum(v[6] == "" for v in got.values()) >= 10


# ---- 13


def plain_words(rows):
    import re

    counts = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def plain_variants(rows):
    words, out, form = plain_words(rows), {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = (n, len(near))
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, *out[w], words[form[w]] if form[w] else None)
    return out


def variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}


def spelled(seed):
    r = random.Random(seed)
    stems = ["banana", "aaaaaa", "stream", "strëam", "Élevage", "lantern", "abcdef" * 9, "zzzzzzzz"]
    words = []
    for s in stems:
        words += [s] * 700
        for _ in range(60):
            t = list(s)
            for _ in range(r.randint(1, 2)):
                i = r.randrange(len(t))
                t[i : i + r.randint(0, 1)] = r.choice(["", r.choice("abstreé"), t[i]])
            words += ["".join(t)] * r.randint(1, 150)
    r.shuffle(words)
    return [(i, " ".join(words[i::97])) for i in range(97)]


def test_variants_against_all_pairs(spark):
    rows = spelled(4)
    got = variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got == plain_variants(rows)
    assert any(v[1] != (v[0] or k) for k, v in got.items()) and sum(v[0] is not None for v in got.values()) > 50


def full_filter(*_):
    return np.full(spelling.FILTER_BITS // 64, ~np.uint64(0))


def test_variants_beyond_the_filter(spark, monkeypatch):
    """A filter that rules nothing out changes no row."""
    rows = spelled(9)[:30]
    monkeypatch.setattr(spelling, "word_filter", full_filter)
    assert variants(spark.createDataFrame(rows, "doc_id long, text string")) == plain_variants(rows)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_candidates_are_the_distinct_neighbourhood(monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    letters, every = np.array([ord(c) for c in "abé"], np.uint32), full_filter()
    for word in ("a", "ab", "aab", "éaaé", "bbbb", "abéab"):
        found = []
        for _, codes in spelling._by_length([word]):
            for edit, rows, places, new in spelling._edits(codes, letters, every):
                found += spelling._spelled(codes, edit, rows, places, new).tolist() if len(rows) else []
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[j:] for i in range(len(word) + 1) for c in "abé" for j in (i, i + 1)}
        assert len(found) == len(set(found)) and set(found) == want - {"", word}


def test_awkward_words(spark):
    long = "abcdefghij" * 3_000
    rows = [(1, None), (2, ""), (3, "!!! 123"), (None, "nullid nullid nullid nullid nullid"), (4, f"{long} " * 6), (5, f"{long}x " * 40), (6, "×÷×÷×÷ " * 5), (6, "×÷×÷×÷ " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("word", "n", "run", "id", "key", "at", "form", "root", "near"):
        df = df.withColumn(c, F.lit("clash"))
    got = variants(df.repartition(2))
    assert got == plain_variants(rows)
    assert got[long][0] == f"{long}x"
    assert spelling.variants(df.limit(0)).count() == 0


def test_variants_write_few_files(spark, monkeypatch):
    """Tables of words fill files of their own number, however many partitions counting shuffles."""
    rows, written = spelled(4), {}

    def counted(df, name, keep=spelling.materialise):
        out = keep(df, name)
        written[name] = max(len(out.inputFiles()), written.get(name, 0))
        return out

    monkeypatch.setattr(spelling, "materialise", counted)
    settings = {"spark.sql.shuffle.partitions": "160", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert variants(spark.createDataFrame(rows, "doc_id long, text string")) == plain_variants(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(written) == {"words", "variants", "roots"} and max(written.values()) <= 10
