"""Personal data: fixed patterns plus a linear-chain conditional random field (operator 1).

Base spans follow the four patterns exactly.  The field labels blank-separated words with O, or one of
KINDS, from word shapes (runs of letters, digits and each mark), digit counts and a short cue list, of the
word and its neighbours.  It is trained on the driver from a small labelled table (``learn``: at most MOST_LINES lines, in
order of a hash), by default ``labelled_table`` of a few hundred made-up lines, and decoded by Viterbi in
numpy batches.  A word whose score for O beats every other label under any
neighbours is O in the best path, so paths are decoded exactly between such words only.  Found runs are
checked (digit counts, Luhn, octets, an address's parts) and added where no base span overlaps.

Defined results: null and empty texts have no spans; base spans of different kinds may overlap, as their
patterns are independent; repeated rows give repeated rows; an empty table gives no rows; other columns
are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, lut, span_hashes, text_slices, tidy, word_spans
from .quality_knn import shape_hashes

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name")
LABELS = ("O", *KINDS)
#: Labelled lines that a field may be trained from, and words of one.
MOST_LINES, MOST_WORDS = 20_000, 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs are taken whole and never re-entered, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not text:
        return []
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---- the labelled table

CUES = ("at", "dot", "[at]", "(at)", "[dot]", "(dot)", "com", "org", "net", "email", "mail", "e-mail", "phone", "tel", "call", "mobile", "fax", "card", "visa", "number", "no", "mr", "mr.", "mrs", "mrs.", "ms.", "dr", "dr.", "tel.", "name", "is", "my", "contact", "ip", "host", "version", "token", "from")


def labelled_rows(n: int = 900, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of made-up lines: filler, look-alikes that are no personal data, and personal data."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuéß") for _ in range(r.randint(1, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    cap = lambda: word().capitalize()

    def filler():
        k = r.random()
        if k < 0.45:
            return [word()]
        if k < 0.55:
            return [cap()]
        if k < 0.70:
            return [word() + r.choice(".,;:!?")]
        if k < 0.78:
            return [word().upper() + r.choice(["", "!!", ".", ",!!"])]
        if k < 0.84:
            return [word() + r.choice(["###", "$$$", "%%%", "&&&", "***"])]
        if k < 0.87:
            return ["|"]
        if k < 0.90:
            return [num(r.randint(1, 4)) + r.choice(["", ".", ",", "%"])]
        if k < 0.92:
            return [f"{num(1)}.{num(1)}" + r.choice(["", "."])]
        if k < 0.935:
            return [f"{num(4)}-{num(2)}-{num(2)}"]
        if k < 0.95:
            return ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"']
        if k < 0.96:
            if r.random() < 0.4:
                return [cap() + r.choice(["", ".", ","])] * r.randint(3, 8)
            return [word(), "is" + r.choice([".", "", ":", ","]), cap() + r.choice(["", ".", ","]), cap()]
        if k < 0.97:
            return [r.choice(("at", "dot", "is", "from", "my", "no", "net", "name", "call", "mail", "number", "card", "contact"))]
        return [word() + "-" + word(), f"({word()})"][r.randint(0, 1) :][:1]

    def entity():
        kind = r.choice(KINDS)
        if kind == "email":
            who, host, top = word() + r.choice(["", "." + word(), num(2)]), word(), r.choice(("com", "org", "net"))
            return kind, r.choice([[f"{who}@{host}.{top}"], [who, "at", host, "dot", top], [who, "[at]", host, "[dot]", top], [who, "(at)", host, "(dot)", top], [who, "[at]", host + "." + top], [who, "(at)", host + "." + top]]), r.choice([[], ["email"], ["mail:"], ["E-mail:"], ["contact"]])
        if kind == "ip":
            return kind, [".".join(str(r.randint(0, 255)) for _ in range(4))], r.choice([[], ["host"], ["from"], ["IP"]])
        if kind == "card":
            g = [num(4) for _ in range(4)]
            return kind, r.choice([["-".join(g)], g, ["".join(g)], [".".join(g)]]), r.choice([[], ["card"], ["card", "number"], ["Visa"]])
        if kind == "phone":
            a, b, c = num(3), num(3), num(4)
            return kind, r.choice([[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"+{num(1)}", f"({a})", f"{b}-{c}"], [f"+{num(2)}", a, b, c]]), r.choice([[], ["call"], ["tel:"], ["phone"], ["Phone:"], ["mobile"]])
        return kind, [cap() for _ in range(r.randint(1, 3))], r.choice([["my", "name", "is"], ["Mr."], ["Mrs."], ["Dr."], ["Ms."], ["my", "name", "is"], ["My", "name", "is"], ["Name:"], ["Contact:"]])

    rows = []
    for i in range(n):
        words, labels = [], []
        for _ in range(r.randint(2, 12)):
            f = filler()
            words += f
            labels += ["O"] * len(f)
        if i % 3:
            kind, parts, cue = entity()
            more = [x for _ in range(r.randint(0, 5)) for x in filler()]
            if r.random() < 0.3:
                parts = [*parts[:-1], parts[-1] + r.choice(".,;")]
            words += cue + parts + more
            labels += ["O"] * len(cue) + [kind] * len(parts) + ["O"] * len(more)
        rows.append((words, labels))
    return rows


# ---- features: one number each for shape, digits and cue

_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def raw_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape hash, digits 0..7+, cue hash) of each word without one closing mark; a full stop stays part of a cue."""
    last = data[ends - 1]
    whole, ends = ends, ends - ((ends - starts > 1) & _MARKS[last])
    cue_ends = np.where(last == 0x2E, whole, ends)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    return shape_hashes(data, starts, ends), np.minimum(digits[ends] - digits[starts], 7), span_hashes(LOWER[data], starts, cue_ends)


_CUE_HASHES = None


def cue_numbers(hashes: np.ndarray) -> np.ndarray:
    global _CUE_HASHES
    if _CUE_HASHES is None:
        data = np.frombuffer(" ".join(CUES).encode(), np.uint8)
        s, e, _ = word_spans(data, np.array([0, len(data)]), lut("space"))
        _CUE_HASHES = np.sort(span_hashes(data, s, e))
    at = np.minimum(np.searchsorted(_CUE_HASHES, hashes), len(_CUE_HASHES) - 1)
    return np.where(_CUE_HASHES[at] == hashes, at + 1, 0)


class Field:
    """Score tables by feature, offset and label, and transitions. The rim of a line counts as label O."""

    OFFSETS = {"shape": (-1, 0, 1), "digits": (-1, 0, 1), "cue": (-2, -1, 0, 1)}

    def __init__(self, shapes: np.ndarray):
        self.shapes = shapes
        k = len(LABELS)
        sizes = {"shape": len(shapes) + 2, "digits": 9, "cue": len(CUES) + 2}
        self.tables = {(f, o): np.zeros((sizes[f], k)) for f, offsets in self.OFFSETS.items() for o in offsets}
        self.moves = np.zeros((k, k))

    def numbers(self, shape: np.ndarray, digits: np.ndarray, cue: np.ndarray) -> dict[str, np.ndarray]:
        """Feature numbers; 0 stands for what lies beyond the line, 1 for an unknown shape."""
        at = np.minimum(np.searchsorted(self.shapes, shape), len(self.shapes) - 1)
        return {"shape": np.where(self.shapes[at] == shape, at + 2, 1), "digits": digits + 1, "cue": cue_numbers(cue) + 1}

    def emissions(self, numbers: dict[str, np.ndarray], line: np.ndarray) -> np.ndarray:
        n = len(line)
        out = np.zeros((n, len(LABELS)))
        for (name, o), scores in self.tables.items():
            x = numbers[name]
            if o:
                moved = np.zeros(n, x.dtype)
                if n > abs(o):
                    a, b = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
                    moved[a] = np.where(line[a] == line[b], x[b], 0)
                x = moved
            out += scores[x]
        return out

    def decode(self, e: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best label of each word; lines are runs of equal numbers."""
        n = len(e)
        labels = np.zeros(n, np.int8)
        t = self.moves
        gain = np.array([(t[:, b][:, None] + t[b, :][None, :] - t[:, 0][:, None] - t[0, :][None, :]).max() for b in range(1, len(LABELS))])
        open_ = np.flatnonzero(e[:, 0] <= (e[:, 1:] + gain).max(axis=1))
        if not len(open_):
            return labels
        cut = np.concatenate([[True], (np.diff(open_) > 1) | (line[open_[1:]] != line[open_[:-1]])])
        first = open_[cut]
        size = np.diff(np.append(np.flatnonzero(cut), len(open_)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        score = t[0] + e[first]
        back = []
        final = np.empty((len(first), len(LABELS)))
        for step in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -step, "right"))  # runs longer than step - 1
            going = int(np.searchsorted(-size, -(step + 1), "right"))
            final[going:live] = score[going:live]
            if not going:
                break
            via = score[:going, :, None] + t
            back.append(via.argmax(axis=1).astype(np.int8))
            score = via.max(axis=1) + e[first[:going] + step]
        last = (final + t[:, 0]).argmax(axis=1)
        labels[first + size - 1] = last
        for step in range(int(size[0]) - 1, 0, -1):
            going = len(back[step - 1])
            labels[first[:going] + step - 1] = back[step - 1][np.arange(going), labels[first[:going] + step]]
        return labels


def train(rows=None, rounds: int = 160, rate: float = 0.2, ridge: float = 2e-4) -> Field:
    """Maximum likelihood by forward-backward and Adam, from (words, labels) rows."""
    rows = rows or labelled_rows()
    text = "\n".join(" ".join(w) for w, _ in rows).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), lut("space"))
    line = np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows])
    gold = np.array([LABELS.index(x) for _, labels in rows for x in labels])
    shape, digits, cue = raw_features(data, starts, ends)
    kinds, seen = np.unique(shape, return_counts=True)
    field = Field(kinds[seen > 1])
    numbers = field.numbers(shape, digits, cue)
    width, k = max(len(w) for w, _ in rows), len(LABELS)
    sizes = np.array([len(w) for w, _ in rows])
    col = np.concatenate([np.arange(s) for s in sizes])
    mask = np.arange(width)[None, :] < sizes[:, None]
    shifted = {}
    for name, o in field.tables:
        x, moved = numbers[name], np.zeros(len(line), np.int64)
        src = np.arange(len(line)) + o
        ok = (src >= 0) & (src < len(line))
        ok[ok] = line[src[ok]] == line[ok]
        moved[ok] = x[src[ok]]
        shifted[name, o] = moved
    params = [field.moves, *field.tables.values()]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    truth = np.eye(k)[gold]
    before = np.where(col > 0, np.concatenate([[0], gold[:-1]]), 0)
    moves_truth = np.zeros((k, k))
    np.add.at(moves_truth, (before, gold), 1)
    np.add.at(moves_truth, (gold[np.cumsum(sizes) - 1], np.zeros(len(rows), int)), 1)
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for step in range(1, rounds + 1):
        flat = sum(t[shifted[key]] for key, t in field.tables.items())
        e = np.zeros((len(rows), width, k))
        e[line, col] = flat
        t = field.moves
        alpha = np.zeros_like(e)
        alpha[:, 0] = t[0] + e[:, 0]
        for i in range(1, width):
            alpha[:, i] = np.where(mask[:, i, None], lse(alpha[:, i - 1, :, None] + t, 1) + e[:, i], alpha[:, i - 1])
        total = lse(alpha[:, -1] + t[:, 0], 1)
        beta = np.zeros_like(e)
        beta[:, -1] = t[:, 0]
        for i in range(width - 2, -1, -1):
            inner = lse(t[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(mask[:, i + 1, None], inner, t[:, 0])
        node = np.exp(alpha + beta - total[:, None, None])[line, col]
        moves = np.zeros((k, k))
        moves[0] += np.exp(alpha[:, 0] + beta[:, 0] - total[:, None]).sum(axis=0)
        ends_at = alpha[np.arange(len(rows)), sizes - 1]
        moves[:, 0] += np.exp(ends_at + t[:, 0] - total[:, None]).sum(axis=0)
        for i in range(1, width):
            pair = np.exp(alpha[:, i - 1, :, None] + t + (e[:, i] + beta[:, i])[:, None, :] - total[:, None, None])
            moves += pair[mask[:, i]].sum(axis=0)
        grads = [moves_truth - moves]
        for key, scores in field.tables.items():
            g = np.zeros_like(scores)
            np.add.at(g, shifted[key], truth - node)
            grads.append(g)
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g / len(rows) - ridge * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return field


def labelled_table(spark: SparkSession) -> DataFrame:
    """words, labels of the built-in lines; tables of one's own look the same."""
    return spark.createDataFrame(labelled_rows(), "words array<string>, labels array<string>")


def learn(labelled: DataFrame, most: int = MOST_LINES, **options) -> Field:
    """A field from a labelled table (words, labels).

    Lines without words, with a null or blank word or with more labels than words (or fewer) are not learned
    from; unknown and null labels count as O; lines over MOST_WORDS words are left out, as filler suffices.
    """
    good = "size(words) between 1 and {n} and size(words) = size(labels) and forall(words, w -> coalesce(w rlike '^[^ \\t-\\r]+$', false))".format(n=MOST_WORDS)
    rows = labelled.select("words", "labels").filter(good).orderBy(F.xxhash64("words", "labels"), "words", "labels").limit(most).collect()
    return train([(list(r[0]), [x if x in LABELS else "O" for x in r[1]]) for r in rows])


_MODEL: Field | None = None


def model() -> Field:
    """The field trained from the built-in rows, once per process."""
    global _MODEL
    if _MODEL is None:
        _MODEL = train()
    return _MODEL


_EMAIL_PARTS = re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|[\[(]at[\])]|\sat\s)\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[(]dot[\])]|\sdot\s)\s*[A-Za-z0-9-]+)+")


def plausible(kind: str, found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    if kind == "email":
        return _EMAIL_PARTS.fullmatch(found) is not None
    if kind == "ip":
        parts = found.split(".")
        return len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not re.search(r"[^\s0-9().+/-]", found)
    parts = found.split()
    return 1 <= len(parts) == len(set(parts)) <= 4 and all(x[:1].isupper() and x[1:].islower() and x.isalpha() for x in parts)


def field_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Byte spans that the field finds, for each text of a slice."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    starts, ends, first = word_spans(data, offsets, lut("space"))
    if not len(starts):
        return out
    doc = np.repeat(np.arange(len(out)), np.diff(first))
    line = np.cumsum(data == 10)[starts] + doc  # grows at each line and each text
    labels = field.decode(field.emissions(field.numbers(*raw_features(data, starts, ends)), line), line)
    hit = np.flatnonzero(labels)
    if not len(hit):
        return out
    new = np.concatenate([[True], (np.diff(hit) > 1) | (labels[hit[1:]] != labels[hit[:-1]]) | (line[hit[1:]] != line[hit[:-1]])])
    begin = hit[new]
    stop = hit[np.concatenate([new[1:], [True]])]
    for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
        lo, hi = int(starts[a]), int(ends[b])
        while hi > lo and data[hi - 1] in b".,;:!?":
            hi -= 1
        kind = LABELS[labels[a]]
        if hi > lo and plausible(kind, data[lo:hi].tobytes().decode()):
            d = int(doc[a])
            out[d].append((kind, lo - int(offsets[d]), hi - int(offsets[d])))
    return out


def all_spans(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those of ``found`` (byte offsets) that overlap none; code points, by kind and start."""
    if not found:
        return base
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    more = [(kind, int(chars[a]), int(chars[b])) for kind, a, b in found]
    ordered = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in ordered], list(itertools.accumulate((b for _, b in ordered), max))
    # Of the base spans that start before the end of one, the farthest reaching tells whether any overlaps it.
    free = lambda a, b: not (k := bisect.bisect_left(starts, b)) or reach[k - 1] <= a
    more = [m for m in more if free(m[1], m[2])]
    return sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _texts(batch: pa.RecordBatch, field: Field):
    """(row, text, base spans, all spans)."""
    at = batch.schema.get_field_index("text")
    for lo, hi, data, offsets in text_slices(batch, "text", 1 << 19):
        found = field_spans(field, data, offsets)
        for i in range(lo, hi):
            text = batch.column(at)[i].as_py() or ""
            base = base_spans(text)
            yield i, text, base, all_spans(text, base, found[i - lo])


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(field or model())

    def run(batches):
        for batch in batches:
            rows = []
            for _, _, base, every in _texts(batch, shared.value):
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a] + f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Documents with their personal data masked; n_chars, where there is such a column, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(field or model())

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            changed = False
            for i, text, _, every in _texts(batch, shared.value):
                if every:
                    texts[i], changed = masked(text, every), True
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                k = batch.schema.get_field_index("n_chars")
                if k >= 0:
                    sizes = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(k).type)
                    batch = batch.set_column(k, batch.schema.field(k), sizes)
            yield batch

    return docs.mapInArrow(tidy(run), docs.schema)
