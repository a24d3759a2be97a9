"""Each operator against brute force, exact round trips or held-out accuracy, and on awkward tables."""

import collections
import gzip
import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docengine.llm import common, decontaminate, jaccard_join, language_rank, license_dice, media_ts, packing, pii_crf, quality_knn, queries, token_store, tokens, warc
from docengine.llm.components import components

from ..oracle import TABLES, same
from . import pii_lines

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
AWKWARD = [
    (1, None, "en", "s", 0),
    (2, "", None, "s", 0),
    (3, "  \n\t ", "en", None, 3),
    (4, LONG, "en", "s", len(LONG)),
    (5, "one two three", "en", "s", None),
    (6, "one two three", "en", "s", 13),
    (6, "one two three", "en", "s", 13),
    (7, "Été à 12:30, mail a.b@c.io or +1 (234) 555-6789.\nReleased under the MIT License.", "fr", "s", 80),
    (8, "!!! ??? 12", "en", "s", 10),
    (9, "x" * 70_000, "en", "s", 70_000),
    (None, "no id here at all", "en", "s", 17),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    for c in ("digest", "rep", "n", "place", "n_words", "ranges", "component", "sequence_id", "_row", "_place", "label", "score", "block", "batch"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, sf):
    return common.table(spark, sf, "documents")


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in docs(spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


# ---- 1


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and pii_crf.luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15)
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans():
    r = random.Random(2)
    bits = ["a", "Z9", "@", ".", "-", "+", "_", " ", "1", "4111", "1111 1111", "255", "256", "0.0", "(", ")", "é", "\n", "+1", "x@y.z", "10.0.0.1", "007"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert pii_crf.base_spans(t) == plain_base(t), t
    assert pii_crf.base_spans("a" * 300_000 + " " + "1" * 300_000) == []


def test_pii_spans_merge():
    r = random.Random(6)
    kinds = ["email", "ip", "card", "phone"]
    for _ in range(300):
        span = lambda: (r.choice(kinds), a := r.randrange(60), a + r.randint(1, 9))
        base, found = sorted(span() for _ in range(r.randint(0, 6))), [span() for _ in range(r.randint(0, 6))]
        base.sort(key=lambda s: (pii_crf.KINDS.index(s[0]), s[1]))
        want = sorted(base + [m for m in found if not any(m[1] < b[2] and b[1] < m[2] for b in base)], key=lambda s: (pii_crf.KINDS.index(s[0]), s[1]))
        assert pii_crf.all_spans("x" * 70, base, found) == want
    many = [("phone", 40 * i, 40 * i + 12) for i in range(40_000)]
    began = time.monotonic()
    assert len(pii_crf.all_spans("x" * 1_700_000, many, [("name", a + 15, a + 25) for _, a, _ in many])) == 80_000
    assert time.monotonic() - began < 5


def test_pii_query(spark, sf):
    want = texts(spark, sf)
    rows = queries.op1_pii_crf(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        base = plain_base(want[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii_crf.joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii_crf.BASE] == [sum(s[0] == k for s in base) for k in pii_crf.BASE]
        assert set(pii_crf.joined(base).split(",")) - {""} <= set(r["spans"].split(","))


def plain_viterbi(field, e):
    n, t = len(e), field.moves
    score, back = t[0] + e[0], []
    for i in range(1, n):
        via = score[:, None] + t
        back.append(via.argmax(0))
        score = via.max(0) + e[i]
    last = int((score + t[:, 0]).argmax())
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float((score + t[:, 0]).max())


def path_score(field, e, path):
    t = field.moves
    return t[0, path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)) + t[path[-1], 0]


def test_pii_viterbi_is_exact():
    field = pii_crf.model()
    rng = np.random.default_rng(1)
    sizes = [1, 2, 3, 7, 30, 1, 12]
    line = np.repeat(np.arange(len(sizes)), sizes)
    for scale in (1, 4, 12):
        e = rng.normal(0, scale, (len(line), len(pii_crf.LABELS)))
        got = field.decode(e, line)
        for k in range(len(sizes)):
            own = line == k
            _, best = plain_viterbi(field, e[own])
            assert abs(path_score(field, e[own], got[own].tolist()) - best) < 1e-6


def test_pii_held_out_accuracy():
    field, right, total, found, gold = pii_crf.model(), 0, 0, 0, 0
    for words, labels in pii_crf.labelled_rows(200, 77):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        s, e, _ = common.word_spans(data, np.array([0, len(data)]), common.lut("space"))
        line = np.zeros(len(s), int)
        got = [pii_crf.LABELS[i] for i in field.decode(field.emissions(field.numbers(*pii_crf.raw_features(data, s, e)), line), line)]
        total += len(labels)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        gold += sum(x != "O" for x in labels)
        found += sum(a == b != "O" for a, b in zip(got, labels, strict=True))
    assert right / total > 0.97 and found / gold > 0.9


def test_pii_on_lines_written_by_hand(spark):
    """Precision and recall of whole spans on lines that no generator made."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pii_lines.LINES)], "doc_id long, text string")
    found, gold, right = {}, {}, {}
    for r in pii_crf.find(df).collect():
        text, want = pii_lines.LINES[r["doc_id"]]
        got = {(k, text[int(a) : int(b)]) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)}
        for table, spans in ((found, got), (gold, set(want)), (right, got & set(want))):
            for k, _ in spans:
                table[k] = table.get(k, 0) + 1
    figures = {k: (right.get(k, 0), found.get(k, 0), gold[k]) for k in gold}
    print(figures)
    assert sum(right.values()) >= 0.85 * sum(found.values()) and sum(right.values()) >= 0.85 * sum(gold.values()), figures


def test_pii_learns_from_a_table(spark):
    rows = [*pii_crf.labelled_rows(300, 5), ([], []), (None, ["O"]), (["a b"], ["O"]), (["x", None], ["O", "O"]), (["x"], ["O", "O"]), (["odd"], ["unknown"])]
    field = pii_crf.learn(spark.createDataFrame(rows, "words array<string>, labels array<string>"))
    t = "please write to jane.doe [at] host [dot] org today"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert pii_crf.find(df, field).first()["spans"] == f"email:{t.index('jane')}:{t.index(' today')}"
    assert pii_crf.labelled_table(spark).count() == len(pii_crf.labelled_rows())


def test_pii_finds_written_out_addresses(spark):
    t = "write to jane.doe [at] host [dot] org today\ncall (555) 123-4567 now\nplain words only here"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    spans = [s.split(":") for s in pii_crf.find(df).first()["spans"].split(",")]
    assert [(k, t[int(a) : int(b)]) for k, a, b in spans] == [("email", "jane.doe [at] host [dot] org"), ("phone", "(555) 123-4567")]
    assert pii_crf.mask(df).first()["text"] == "write to [EMAIL] today\ncall [PHONE] now\nplain words only here"


# ---- 2


@pytest.mark.parametrize("broadcast", [100, 0])
def test_warc_edges(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    big, huge = "<p>é</p>" * 300, "<b>x</b>\r\n\r\n" * 300_000
    rows = [(1, "u\r\nx", big), (2, "u", big), (3, None, None), (4, "", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (2, "u", big), (7, "é", huge)]
    rows += [(None, "n", "z" * 1000)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("target", F.lit("x"))
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    whole = warc.write_archives(warc.plan_records(pages), one, limit=6000)
    names = warc.normalise(whole, one, two)
    assert sum(r["records"] for r in whole.collect()) == len(rows) == sum(r["records"] for r in names.collect())
    for r in names.collect():
        data = (tmp_path / "two" / r["name"]).read_bytes()
        index = [json.loads(x) for x in (tmp_path / "two" / (r["name"] + ".idx")).read_text().splitlines()]
        assert [x["offset"] for x in index] == [sum(y["length"] for y in index[:i]) for i in range(len(index))] and sum(x["length"] for x in index) == len(data)
        # Any reader of gzip sees the records one after another.
        plain = gzip.decompress(data)
        assert plain.count(b"WARC/1.1\r\nWARC-Type") == len(index) and plain.endswith(b"\r\n\r\n")
        assert b"".join(gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index) == plain
        assert len(list(warc.records(warc.inflate(pa.BufferReader(data), 7 if len(data) < 5000 else 4096)))) == len(index)
    read = warc.read_archives(names, two).collect()
    assert len({r["record_id"] for r in read}) == len(read) == len(rows)
    kinds = sorted({(r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in read if r["payload_bytes"] != 1000}, key=str)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)]
    assert [r["record_type"] for r in read if r["payload_bytes"] == 1000] == ["response"] * 2
    assert {r["payload"].decode() for r in read if r["page_id"] == 2} == {big} and [r["payload"].decode() for r in read if r["page_id"] == 7] == [huge]
    assert all(r["payload"] is None and r["url"] is None or r["page_id"] not in (3, 4) or r["payload"] == b"" for r in read)
    assert all(r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and r["payload_bytes"] == len(big.encode()) for r in read if r["page_id"] in (1, 2))
    assert warc.round_trip(pages.filter("false")).count() == 0
    assert warc.round_trip(pages).count() == len(rows)


def test_warc_damage(spark, tmp_path):
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    pages = spark.createDataFrame([(1, "u", "abc" * 400), (2, "v", "abc" * 400)], "page_id long, url string, html string").coalesce(1)
    names = warc.normalise(warc.write_archives(warc.plan_records(pages), one), one, two)
    read = warc.read_archives(names, two)
    warc.check_revisits(read)
    with pytest.raises(ValueError, match="no response"):
        warc.check_revisits(read.withColumn("payload_digest", F.when(F.col("record_type") == "revisit", "00").otherwise(F.col("payload_digest"))))
    for r in names.collect():
        f = tmp_path / "two" / r["name"]
        f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"abcabc", b"abcabd", 1)))
    with pytest.raises(Exception, match="damaged|does not match|cut short|Error"):
        read.collect()


# ---- 3


def test_quality(spark, sf):
    want = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    rows = queries.op3_quality_knn(spark, sf).collect()
    assert len(rows) == docs(spark, sf).count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], want[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in want]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_quality_edges(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1), (7, 0), (7, None), (77, 1), (9, 0)], "doc_id long, quality int")
    model = quality_knn.train(awkward, labels)
    got = quality_knn.score(awkward, model).collect()
    assert len(got) == len(AWKWARD)
    assert all(r["score"] == quality_knn.EMPTY_SCORE for r in got if r["doc_id"] in (1, 2, 3))
    assert quality_knn.score(empty, model).count() == 0
    none = quality_knn.train(awkward, labels.filter("false"))
    assert {r["score"] for r in quality_knn.score(awkward, none).collect()} == {quality_knn.EMPTY_SCORE}


def plain_terms(text):
    """Words, their shapes and repetition marks of a text, counted."""
    out = {}

    def add(term):
        out[term] = out.get(term, 0) + 1

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words]
    for i, w in enumerate(words):
        add(("word", low[i]))
        kinds = "".join("U" if "A" <= c <= "Z" else "L" if "a" <= c <= "z" or c >= "\x80" else "D" if "0" <= c <= "9" else c for c in w)
        add(("shape", re.sub(r"(.)\1+", r"\1", kinds, flags=re.S)))
        if i and low[i] == low[i - 1]:
            add(("again",))
            if i > 1 and low[i] == low[i - 2]:
                add(("and again",))
    return out


def plain_quality(texts, labelled, vocabulary, rank, neighbours):
    """The same votes from dictionaries and numpy's full singular value decomposition."""
    rows = [(y, plain_terms(t)) for _, y, t in labelled]
    df = {}
    for _, terms in rows:
        for t in terms:
            df[t] = df.get(t, 0) + 1
    known = sorted((t for t in df if df[t] >= 2), key=str)
    assert len(known) <= vocabulary
    n = len(rows)
    idf = np.array([np.log((1 + n) / (1 + df[t])) + 0.05 for t in known])
    vector = lambda terms: np.array([np.log1p(terms.get(t, 0)) for t in known]) * idf
    x = np.array([vector(terms) for _, terms in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    right = np.linalg.svd(x, full_matrices=False)[2][:rank]
    near = x @ right.T
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    out = {}
    for d, t in texts.items():
        v = right @ vector(plain_terms(t))
        if not np.linalg.norm(v):
            out[d] = quality_knn.EMPTY_SCORE
            continue
        sims = near @ (v / np.linalg.norm(v))
        best = sorted(range(n), key=lambda i: (-sims[i], i))[:neighbours]
        w = [max(0.0, sims[i]) for i in best]
        out[d] = sum(a * rows[i][0] for a, i in zip(w, best, strict=True)) / sum(w) if sum(w) else quality_knn.EMPTY_SCORE
    return out


def test_quality_query_equals_brute_force(spark, monkeypatch, tmp_path):
    """The registered query on a small fixture, against dictionaries and a full decomposition of full rank."""
    r = random.Random(12)
    word = lambda good: (r.choice(["river", "stone", "garden", "winter", "letter", "Paris", "open"]) if good else r.choice(["WIN!!", "cash", "click", "$$$", "now", "now", "free"]))
    rows, labels = [], []
    for d in range(60):
        good = d % 2
        rows.append((d, " ".join(word(good if r.random() < 0.8 else not good) for _ in range(r.randint(4, 25)))))
        if d % 5:
            labels.append((d, good if r.random() < 0.9 else 1 - good))
    rows += [(100, None), (101, ""), (102, "unseen ~words~"), (103, rows[3][1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x["doc_id"]: x["score"] for x in queries.op3_quality_knn(spark, str(tmp_path)).collect()}
    texts = dict(rows)
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    order = {x["doc_id"]: x["h"] for x in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    learned = sorted(((order[d], d), y, texts[d]) for d, y in labels if not held(d))
    want = plain_quality(texts, learned, quality_knn.VOCABULARY, quality_knn.RANK, quality_knn.NEIGHBOURS)
    assert set(got) == set(want)
    assert max(abs(got[d] - want[d]) for d in want) < 2e-3


def test_quality_ties_go_to_the_lower_row():
    sims = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2], [0.9, 0.8, 0.7, 0.6, 0.5]], np.float32)
    assert quality_knn.nearest(sims, 2).tolist() == [[0, 1], [0, 1], [0, 1]]
    assert quality_knn.nearest(sims, 3).tolist() == [[0, 1, 2], [0, 1, 2], [0, 1, 2]]


def test_quality_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    v = quality_knn.unit(rng.normal(size=(40, 6)).astype(np.float32))
    y = rng.integers(0, 2, 40).astype(float)
    q = quality_knn.unit(rng.normal(size=(700, 6)).astype(np.float32))
    m = quality_knn.Model(np.zeros(0, np.uint64), np.zeros((0, 6), np.float32), v, y, 5)
    for got, x in zip(m.score(q), q, strict=True):
        near = sorted(range(40), key=lambda i: -float(x @ v[i]))[:5]
        w = [max(0.0, float(x @ v[i])) for i in near]
        assert abs(got - sum(a * y[i] for a, i in zip(w, near, strict=True)) / sum(w)) < 1e-5


# ---- 4


def plain_sets(rows):
    out = {}
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def plain_classes(rows):
    sets = plain_sets(rows)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {(d, len(sets[d]), find(d)) for d in ids}


def near_copies(seed, n=220):
    """Groups of edited copies around the threshold, shared passages, copies in other case, short texts."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + str(r.randint(0, 400))
    passage = [word() for _ in range(40)]
    rows, base = [], []
    for i in range(n):
        k = r.random()
        if k < 0.35 or not base:
            words = [word() for _ in range(r.choice([3, 5, 8, 30, 80, 300]))]
            if r.random() < 0.4:
                words[len(words) // 2 : len(words) // 2] = passage
            base.append(words)
        else:
            words = list(r.choice(base))
            for _ in range(int(len(words) * r.choice([0, 0, 0.005, 0.01, 0.02, 0.03, 0.05]) + r.choice([0, 0, 1]))):
                words[r.randrange(len(words))] = word()
            if r.random() < 0.2:
                words = [w.upper() for w in words]
        rows.append((i, r.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, seed):
    rows = near_copies(seed)
    got = {tuple(r) for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == plain_classes(rows)


def test_jaccard_slices_and_hot_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 800)
    monkeypatch.setattr(jaccard_join, "SLICE_SHINGLES", 500)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    r = random.Random(9)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        w[r.randrange(60)] = f"z{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(30)]
    got = {tuple(x) for x in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_divide_skip():
    r = random.Random(4)
    for _ in range(400):
        lists = [np.array(sorted(r.sample(range(40), r.randint(0, 40)))) for _ in range(r.randint(1, 12))]
        t = r.randint(1, 12)
        ids, counts = jaccard_join.divide_skip(lists, t)
        want = {x: sum(x in set(v.tolist()) for v in lists) for x in range(40)}
        assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == {x: n for x, n in want.items() if n >= t}


def plain_classes_of_rows(rows):
    """Rows of one doc_id are one document with the links of each of its rows; an own size per row."""
    sets = [(d, next(iter(plain_sets([(d, t)]).values()))) for d, t in rows]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x & y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d)) for d, s in sets)


@pytest.mark.parametrize("seed", [0, 3])
def test_jaccard_repeated_ids(spark, seed):
    rows = [(1, "a b c"), (2, "a b c"), (2, "x y z w v u"), (3, "x y z w v u"), (4, "X y z w v  u"), (5, ""), (5, "q r"), (6, None), (6, "Q  R"), (7, " ")]
    if seed:
        r = random.Random(seed)
        rows = [(r.choice([d, d, d, d // 3, 200 + d // 20]), r.choice([t, t, t, "", "same text"])) for d, t in near_copies(seed, 120)]
    got = sorted(tuple(x) for x in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == plain_classes_of_rows(rows)


@pytest.mark.parametrize("seed", [5])
def test_jaccard_blocks_in_slices(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 150)
    monkeypatch.setattr(jaccard_join, "SLICE_SHINGLES", 100)
    monkeypatch.setattr(jaccard_join, "FLUSH_SHINGLES", 2000)
    # One block of all: chained over boilerplate, with several components.
    monkeypatch.setattr(jaccard_join, "_near", lambda p, u, others: np.ones(len(others), bool))
    rows = near_copies(seed, 160)
    got = {tuple(x) for x in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain_classes(rows)


def test_jaccard_search_with_labels():
    r = random.Random(2)
    for _ in range(60):
        sets = [np.array(sorted(r.sample(range(14), r.randint(6, 12))), np.uint64) for _ in range(r.randint(2, 25))]
        labels = [r.choice([i, i, 0]) for i in range(len(sets))]
        links = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(set(a.tolist()) & set(b.tolist())) * 5 >= 4 * len(set(a.tolist()) | set(b.tolist()))}
        same = {(i, j) for i in range(len(sets)) for j in range(i) if labels[i] == labels[j]}

        def parts(edges, n=len(sets)):
            forest = jaccard_join.Forest(n)
            for a, b in edges:
                forest.join(a, b)
            return [forest.find(i) for i in range(n)]

        assert parts({*jaccard_join.search(sets, labels), *same}) == parts(links | same)
        assert parts(jaccard_join.search(sets)) == parts(links)


def test_jaccard_edges(spark, awkward, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(awkward).collect()}
    sizes = {d: len(s) for d, s in plain_sets([(r[0], r[1]) for r in AWKWARD if r[0] is not None]).items()}
    assert {x for x in got if x[0] is not None} == {(d, n, 5 if d == 6 else d) for d, n in sizes.items()}
    assert [x[2] for x in got if x[0] is None] == [None]
    assert jaccard_join.classes(empty).count() == 0
    twice = jaccard_join.keep_first(awkward.filter("doc_id in (6, 7)").unionByName(awkward.filter("doc_id = 7")))
    assert twice.columns == awkward.columns and sorted(r["doc_id"] for r in twice.collect()) == [6, 7]
    kept = jaccard_join.keep_first(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 1), (5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {(x["node"], x["component"]) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in up}


# ---- 5 and 7


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_encoder_equals_the_library():
    r = random.Random(4)
    bits = ["a", "B", "É", "É", "İ", "Σ", "ΑΣ", "ß", "3", "3.", "it's", "'S", "x,y", "...", ",,", ".a", "a.", "a.,", "<|endoftext|>", "<|EndOfText|>", "\t", "\x1c", "\x85", "\xa0", "　", "#$", "한글", "日本.", "á.", "1,000.", "\U0001f600", "‍", " ", "\n", "\r\n", "THE!!", "***", "%%%.", "é", "×", "÷", "...,!", "'", "~^", "e\u0301", "ç", "x|", "<|"]
    rows = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 30))) for _ in range(4000)] + [None, "", "y" * 5000]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())})
    lib = library()
    for i, ids in tokens.encoded(batch, tokens.vocabulary_path()):
        assert ids.tolist() == lib.encode(rows[i] or "", add_special_tokens=False).ids, rows[i]


@pytest.mark.parametrize("bits", [0, 3])
def test_encoder_notices_equal_hashes(monkeypatch, bits):
    real = tokens.span_hashes
    monkeypatch.setattr(tokens, "span_hashes", lambda *a: real(*a) & np.uint64((1 << bits) - 1))
    own, lib = tokens.Encoder(tokens.vocabulary_path()), library()
    for t in ("one", "two", "one two three four. five, one", "one one"):
        data = np.frombuffer(t.encode(), np.uint8)
        ids, bounds = own.encode(data, np.array([0, 0, len(data)]))
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids and bounds.tolist() == [0, 0, len(ids)]


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 3)
    own, lib = tokens.Encoder(tokens.vocabulary_path()), library()
    for t in ("one two three four five", "six seven one", "two two two"):
        data = np.frombuffer(t.encode(), np.uint8)
        ids, _ = own.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def stored(rows):
    lib, out, start = library(), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_store(spark, sf):
    got = {tuple(r) for r in queries.op5_token_store(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    assert got == set(stored(list(texts(spark, sf).items())))


def test_token_store_edges(spark, awkward, empty, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(awkward, path)
    got = sorted((tuple(r) for r in token_store.read_store(spark, path).collect()), key=lambda r: r[1])
    assert got == stored([(r[0], r[1]) for r in AWKWARD])
    ids = {r["doc_id"]: r["ids"] for r in token_store.read_ids(spark, path).collect()}
    lib = library()
    assert ids[4] == [*lib.encode(LONG, add_special_tokens=False).ids, 2]
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("name").distinct().count()
    token_store.write_store(empty, f"file://{tmp_path}/none")
    assert token_store.read_store(spark, f"file://{tmp_path}/none").count() == 0


def test_token_store_notices_damage(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), path)
    c = spark.read.parquet(f"{path}/chunks").collect()[0]
    spark.createDataFrame([(c["name"], bytes(c["ids"])[::-1], c["width"])], "name binary, ids binary, width int").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_store(spark, path).collect()


def test_token_store_refuses_wide_ids(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit two bytes"):
        token_store.write_store(rows, f"file://{tmp_path}/narrow", end_id=70_000)
    path = f"file://{tmp_path}/wide"
    token_store.write_store(rows, path, end_id=70_000, width=4)
    want = [*library().encode("a b c", add_special_tokens=False).ids, 70_000]
    assert token_store.read_ids(spark, path).first()["ids"] == want
    assert token_store.read_store(spark, path).first()["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())


def test_chunks_realign():
    ids = np.random.default_rng(3).integers(0, 49_000, 20_000).astype(np.uint32)
    moved = np.concatenate([ids[:50], ids[20:]])

    def pieces(x):
        ends = token_store.cut_points(x)
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}

    assert len(pieces(ids) & pieces(moved)) > 0.7 * len(pieces(ids))
    assert max(np.diff([0, *token_store.cut_points(np.zeros(30_000, np.uint32))])) <= token_store.CHUNK_MOST


def check_packing(rows, want_pieces):
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want_pieces
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    return len(bins), sum(r["length"] for r in rows) / 2048


def plain_pieces(rows):
    lib, out = library(), set()
    for d, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out.add((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def test_packing(spark, sf):
    n, least = check_packing(queries.op7_vector_pack(spark, sf).collect(), plain_pieces(texts(spark, sf).items()))
    assert n <= 1.02 * least + 2


def test_packing_edges(spark, awkward, empty):
    rows = packing.pack_documents(awkward, shard_pieces=5).collect()
    check_packing(rows, plain_pieces([(r[0], r[1]) for r in AWKWARD]))
    assert len([r for r in rows if r["doc_id"] == 6]) == 2
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_packing_under_binding_capacities(spark, rule):
    """Each of the three capacities binds in some sequence, and both rules keep all of them."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["river", "stone", "sun"]) for _ in range(r.choice([0, 1, 1, 2, 30, 60, 140])))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack_documents(df, capacity=256, max_documents=12, max_attention=20_000, rule=rule).collect()
    assert sorted((x["doc_id"], x["start"], x["length"]) for x in packed) == sorted((x["doc_id"], x["start"], x["length"]) for x in packing.pieces(df, 256).collect())
    full = {}
    for x in packed:
        full.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    sums = [(sum(n for _, n in own), len(own), sum(n * n for _, n in own)) for own in full.values()]
    assert all(a <= 256 and b <= 12 and c <= 20_000 for a, b, c in sums)
    assert any(b == 12 and a < 200 for a, b, c in sums) and any(c > 19_000 and a < 200 for a, b, c in sums) and max(a for a, _, _ in sums) > (250 if rule == "residual_norm" else 200)
    for own in full.values():
        assert sorted(o for o, _ in own) == [sum(n for p, n in own if p < o) for o in sorted(o for o, _ in own)]


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_best_fit_keeps_every_constraint(rule):
    lengths = np.random.default_rng(8).integers(1, 400, 600)
    where, offset = packing.best_fit(lengths, 512, 3, 160_000, rule=rule)
    for b in range(where.max() + 1):
        own = lengths[where == b]
        assert 0 < len(own) <= 3 and own.sum() <= 512 and (own.astype(float) ** 2).sum() <= 160_000
        assert sorted(offset[where == b]) == [0, *np.cumsum(own[np.argsort(offset[where == b])])[:-1]]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([513]), 512)


# ---- 6


def test_language(spark, sf):
    rows = queries.op6_language_rank(spark, sf).collect()
    want = {r["doc_id"]: r["lang"] for r in docs(spark, sf).collect()}
    assert len(rows) == len(want)
    held = [r["lang_pred"] == want[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_gram_counts():
    rng = random.Random(3)
    rows = ["".join(rng.choice("ab éÀß1 .\n") for _ in range(rng.randint(0, 40))) for _ in range(60)]

    def plain(t):
        out = {}
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        for w in words:
            p = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(p) - n + 1):
                    g = p[i : i + n]
                    if g.strip() and not (n == 1 and g == " "):
                        out[g] = out.get(g, 0) + 1
        return out

    doc, _, n = language_rank.gram_counts(rows)
    for i, t in enumerate(rows):
        assert sorted(n[doc == i].tolist()) == sorted(plain(t).values()), t


def plain_grams(text):
    """n-grams (1 to 3) of the padded words of letters, in lower case."""
    out = {}
    for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        p = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                if p[i : i + n].strip():
                    out[p[i : i + n]] = out.get(p[i : i + n], 0) + 1
    return out


def test_language_equals_brute_force(spark, tmp_path):
    """The registered query against profiles and out-of-place distances of plain dictionaries."""
    r = random.Random(21)
    bits = {"aa": ["the", "and", "river", "with", "öl"], "bb": ["der", "und", "fluß", "mit", "öl"], "cc": ["le", "et", "rivière", "avec", "été"]}
    rows = [(d, " ".join(r.choice(bits[lang]) + r.choice(["", "", ".", "3"]) for _ in range(r.randint(1, 30))), lang) for d in range(90) for lang in [r.choice(sorted(bits))]]
    rows += [(200, None, "aa"), (201, "", "aa"), (202, "123 !!", "bb"), (203, "THE RIVER AND", None), (204, "zzz qqq", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in queries.op6_language_rank(spark, str(tmp_path)).collect()}
    # Ties of frequency go by the n-gram's code, as the docstring states.
    code = lambda g: int(language_rank.gram_code(g))
    size = language_rank.PROFILE

    def ranked(grams):
        return {g: i for i, g in enumerate(sorted(grams, key=lambda g: (-grams[g], code(g)))[:size])}

    sums = {}
    for d, t, lang in rows:
        if zlib.crc32(str(d).encode()) % 3 != 1 and lang and t is not None:
            for g, n in plain_grams(t).items():
                sums.setdefault(lang, {})[g] = sums.setdefault(lang, {}).get(g, 0) + n
    profiles = {lang: ranked(g) for lang, g in sums.items()}
    for d, t, _ in rows:
        own = ranked(plain_grams(t))
        if not own:
            assert got[d] == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else size for g, i in own.items()) for lang, p in profiles.items()}
        best = min(sorted(far), key=lambda x: far[x])
        assert got[d][0] == best and abs(got[d][1] - (1 - far[best] / (size * len(own)))) < 1e-9, d


def test_language_counts_in_bounded_memory(spark, sf, monkeypatch):
    rows = common.table(spark, sf, "documents").select("text", "lang").filter("lang is not null").limit(60).collect()
    batches = [pa.RecordBatch.from_pylist([{"lang": r["lang"], "text": r["text"]} for r in rows[i : i + 10]]) for i in range(0, 60, 10)]

    def counts():
        out = collections.Counter()
        parts = list(language_rank._sum_grams(iter(batches)))
        for part in parts:
            for x in part.to_pylist():
                out[x["lang"], x["code"]] += x["n"]
        return out, len(parts)

    whole, few = counts()
    monkeypatch.setattr(language_rank, "HELD_GRAMS", 500)
    split, many = counts()
    assert whole == split and many > few


def test_language_edges(spark, awkward, empty):
    profiles = language_rank.learn(language_rank.training_rows(awkward))
    got = language_rank.predict(awkward, profiles).collect()
    assert len(got) == len(AWKWARD)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1, 2, 3, 8))
    assert language_rank.predict(empty, profiles).count() == 0
    none = language_rank.learn(empty.select("text", "lang"))
    assert {r["lang_pred"] for r in language_rank.predict(awkward, none).collect()} == {"und"}
    kept = language_rank.keep_known(awkward, profiles)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 9, None}


# ---- 8


def test_license_passages(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU\nGeneral Public License, version 3."
    texts = [
        f"Some text about rivers. {mit} More text that goes on and on about boats and fish.",
        f"First words here\nand then. {gpl} After it\nthe text goes on",
        f"a b c. {mit} d e f g h i j k l m n o p. {mit} q r s t u v w x y z",
        "Title\n" + license_dice.BODIES["mit"].replace("Permission", "Copyright 2020 A. B.\n\nPermission") + "\nint main",
        license_dice.BODIES["bsd-3-clause"].replace(" ", "\n "),
        "x " * 50 + license_dice.BODIES["apache-2.0"],
        "The MIT crowd was released last year; under the bridge a license lay. All rights were sold.",
    ]
    got = {r["doc_id"]: r for r in license_dice.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["licenses"] for i in range(7)] == ["mit", "gpl-3.0", "mit", "mit", "bsd-2-clause,bsd-3-clause", "apache-2.0", ""]
    assert [got[i]["n_matches"] for i in range(4)] == [1, 1, 2, 1]
    assert [got[i]["best_dice"] for i in range(6)] == [1.0] * 6 and got[6]["best_dice"] is None


def licence_texts(seed, n):
    """Notices and bodies, whole, inline, wrapped, damaged and repeated, between other words."""
    r = random.Random(seed)
    pieces, out = [*license_dice.TEMPLATES.values(), *license_dice.BODIES.values()], []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 5)):
            w = r.choice(pieces).split()
            for _ in range(r.choice([0, 0, 1, len(w) // 8, len(w) // 4])):
                i = r.randrange(len(w))
                w[i : i + r.randint(0, 1)] = r.choice([[], ["other"], [w[i], w[i]]])
            parts.append(" ".join(x + r.choice([" ", "\n"] if r.random() < 0.1 else [""]) for x in w))
            parts.append(" ".join(r.choice(["the", "software", "river", "license", "of"]) for _ in range(r.choice([0, 2, 30]))))
        out.append(r.choice([" ", "\n", ". "]).join(parts))
    return out


def test_license_passages_against_sql(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(licence_texts(3, 24))), "doc_id long, text string")
    for name in TABLES:
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = license_dice.scan(df).cache()
    same(found, license_dice.ORACLE, str(tmp_path))
    assert found.filter("n_matches > 2").count() > 8 and found.filter("best_dice < 1").count() > 3


def test_license_many_notices(spark):
    """64 notices in one text: the passages are counted in time linear in the text."""
    text = ("\nint main() {}\n" + license_dice.BODIES["mit"]) * 64
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    license_dice.scan(df.limit(0)).collect()
    began = time.monotonic()
    got = license_dice.scan(df).first()
    assert (got["n_matches"], got["licenses"], got["best_dice"]) == (64, "mit", 1.0)
    assert time.monotonic() - began < 20


def test_license_edges(spark, awkward, empty):
    got = {r["doc_id"]: r for r in license_dice.scan(awkward).collect()}
    assert got[7]["licenses"] == "mit" and got[7]["best_dice"] == 1.0
    assert got[1]["n_matches"] == 0 and got[1]["best_license"] is None and got[4]["n_matches"] == 0
    assert license_dice.scan(empty).count() == 0
    t = "LICENSED under the Apache license -- version 2.0!\nThis work is licenced under the GNU General Public License, version 3."
    r = license_dice.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert r["licenses"] == "apache-2.0,gpl-3.0" and r["n_matches"] == 2


# ---- 9


def plain_contamination(text, items, size=13):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
    w, hit, found = split(text), set(), set()
    for k, (item, t) in enumerate(items):
        own = split(t)
        wins = {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add((k, item))
    ids = sorted(str(x) for _, x in found if x is not None)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [1 << 20, 500, 60])
def test_decontamination(spark, limit):
    r = random.Random(5)
    word = lambda: r.choice(["a", "B", "cé", "d1", "e"])
    items = [(i, r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.choice([0, 1, 3, 12, 13, 14, 20])))) for i in range(14)] + [(20, None), (None, "zz yy"), (30, "zz yy"), (30, "yy! zz"), (30, "ZZ yy")]
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 60))) + r.choice(["", " ", "! " + (r.choice(items)[1] or "")])) for i in range(60)] + [(90, None), (90, None), (91, "zz YY!")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in decontaminate.report(d, b, limit=limit).collect())
    want = sorted((i, *plain_contamination(t, items)) for i, t in rows)
    assert got == want
    clean = sorted(x["doc_id"] for x in decontaminate.clean(d, b, limit=limit).collect())
    assert clean == sorted(w[0] for w in want if not w[-1])


def test_decontamination_edges(spark, awkward, empty):
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = [(r["doc_id"], r["contaminated"]) for r in decontaminate.report(awkward, b).collect()]
    assert len(got) == len(AWKWARD) and {d for d, c in got if c} == {5, 6}
    assert decontaminate.report(awkward, b.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.report(empty, b).count() == 0
    for limit in (1 << 20, 14, 4):
        clean = decontaminate.clean(awkward, b.unionByName(spark.createDataFrame([(2, "zz zz")], b.schema)), limit=limit)
        assert clean.columns == awkward.columns and {r["doc_id"] for r in clean.collect()} == {1, 2, 3, 4, 7, 8, 9, None}
    machine, items = decontaminate.automaton([("one two", ((0, "7"),))])
    _, ranges, found = decontaminate.scan("é! One, two; x", machine, items)
    assert found == {(0, "7")}
    assert [("é! One, two; x")[a:b] for a, b in decontaminate.original_offsets("é! One, two; x", ranges)] == ["One, two"]


# ---- 10


def plain_stream(raw):
    """A packet-by-packet reader: (payload, unpadded length, [(time stamp, payload offset)], packets)."""
    payload, marks, length, counter, at = b"", [], None, None, 0
    while at < len(raw):
        p = raw[at : at + 188]
        at += 188
        assert p[0] == 0x47
        pid, starts, control = (p[1] & 31) << 8 | p[2], bool(p[1] & 0x40), p[3] >> 4 & 3
        body, access = 4, False
        if control & 2:
            access = p[4] > 0 and bool(p[5] & 0x40)
            body = 5 + p[4]
        if pid == 0x100:
            section = p[5 : 8 + ((p[6] & 15) << 8 | p[7])]
            assert media_ts.crc32_mpeg(section) == 0
            length = int.from_bytes(section[section.index(bytes([0x80, 8])) + 2 :][:8], "big")
        if pid != 0x101:
            continue
        assert counter is None or p[3] & 15 == (counter + 1) % 16
        counter, data = p[3] & 15, p[body:]
        if starts:
            assert data[:4] == bytes([0, 0, 1, 0xBD])
            t = data[9:14]
            stamp = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
            if access:
                marks.append((stamp, len(payload)))
            data = data[9 + data[8] :]
        payload += data
    return payload, length, marks, len(raw) // 188


def test_transport_stream(spark, sf):
    want = texts(spark, sf)
    stored = {r["doc_id"]: bytes(r["media"]) for r in media_ts.encode(docs(spark, sf)).collect()}
    for r in queries.op10_transport_stream(spark, sf).collect():
        data = want[r["doc_id"]].encode()
        whole = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-32:])
        payload, n, marks, packets = plain_stream(stored[r["doc_id"]])
        assert (payload, n) == (whole, len(data)) and marks == [(i * media_ts.TICKS, i * 9216) for i in range(-(-len(whole) // 9216))]
        assert (r["media_bytes"], r["media_sha256"]) == (188 * packets, hashlib.sha256(stored[r["doc_id"]]).hexdigest())
        assert r["points"] == ",".join(f"{t}@{o}" for t, o in marks)
        assert r["feature"] == f"type=6;packets={packets};elementary={len(marks)};pts=0..{marks[-1][0]};access={len(marks)};last_access={marks[-1][1]};breaks=0"


def test_transport_stream_edges(spark, awkward, empty):
    media = media_ts.encode(awkward)
    got = {r["doc_id"]: r for r in media_ts.features(media).collect()}
    assert got[1]["payload_bytes"] == 576 and got[1]["media_sha256"] == got[2]["media_sha256"] and got[5]["feature"] == got[6]["feature"]
    assert media_ts.features(media_ts.encode(empty)).count() == 0
    p = media_ts.points(media).filter("doc_id = 4").orderBy("number").collect()
    assert [r["pts"] for r in p] == [i * media_ts.TICKS for i in range(len(p))] and [r["payload_offset"] for r in p] == [i * 576 * media_ts.PACKET_UNITS for i in range(len(p))]
    stream = bytearray(media_ts.mux(media_ts.padded(b"abc" * 500), 1500))
    del stream[188 * 3 : 188 * 4]
    with pytest.raises(ValueError, match="stated length"):
        media_ts.demux(media_ts.mux(media_ts.padded(b"abc" * 500), 700))
    with pytest.raises(ValueError, match="continuity"):
        media_ts.demux(bytes(stream))


# ---- the pipeline


def test_pipeline(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    d = docs(spark, sf)
    profiles = language_rank.learn(language_rank.training_rows(d))
    kept = [(r["doc_id"], r["text"]) for r in d.collect() if profiles.predict([r["text"]])[1][0] >= language_rank.LEAST_SCORE]
    first = {x for x, _, c in plain_classes(kept) if x == c}
    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf, "benchmark").collect()]
    clean = [(x, t) for x, t in kept if x in first and not plain_contamination(t, items)[-1]]
    field = pii_crf.model()
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in clean], pa.string())})
    masked = [(clean[i][0], pii_crf.masked(t, spans)) for i, t, _, spans in pii_crf._texts(batch, field)]
    check_packing(rows, plain_pieces(masked))


def test_pipeline_stages(spark, awkward, tmp_path):
    b = spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = awkward
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == now.columns
            out.write.parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
        else:
            assert out.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.filter("false"), str(tmp_path)).count() == 0
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


@pytest.mark.parametrize("uri", ["file:/tmp/x", "file:///tmp/x", "/tmp/x"])
def test_shared_folder_names(uri):
    assert common.file_system(uri)[1] == "/tmp/x"
