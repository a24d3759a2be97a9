"""Similarity join on word shingles by T-occurrence search (operator 4).

A document's set is its distinct WORDS-word shingles (the whole sequence if it has fewer words).  Two
documents link when their sets' Jaccard similarity is at least 80 %.  Steps, each exact:

1. Equal texts collapse to their least doc_id.
2. Shared shingles: shingles are dealt by hash; a document of whose n shingles fewer than 0.8 n occur in
   another document has no link and leaves.  Shingles of several documents of one map task are counted
   there and sent once, so the most common shingle is a few entries of its shard.
3. Blocks: a set is cut by hash range into sublists of about 16 to 64 shingles.  Of two linked documents
   some sublist pair is itself 0.8 similar, so their prefixes (rarest first) share a shingle; a parity
   signature bounds their difference from below.  Pairs that pass are joined to blocks.  Equal sublists of
   one map task are joined there and sent once.
4. Search: inside a block every set is a query against the block's inverted lists: the short lists are
   merged by a heap, the long ones probed by binary search (DivideSkip), and documents reaching the
   required overlap are linked.  A block over SLICE_SHINGLES is cut into slices: each is searched alone,
   then one document of each component found, and last the documents outside the block's largest
   component against all slices.  A group of near copies is thus read three times, whatever its size.

Searches leave out documents already known to be in the query's component, so no group of copies is
expanded into pairs.

Defined results: null and empty texts, and texts without words, have no shingles and their own doc_id as
component; repeated rows are copies of each other; rows of one doc_id with different texts count as one
document with all their links, each row with the size of its own text's set; a null doc_id links with
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, lut, materialise, mix64, ragged, span_hashes, spread, text_slices, tidy, word_spans
from .components import components

WORDS = 5
#: The similarity threshold as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Shingles a task sends on at once, those of a slice searched alone, and those of a slice searched against others.
FLUSH_SHINGLES, SLICE_SHINGLES, BLOCK_SHINGLES = 1 << 20, 2 << 20, 2 << 20
#: Shingles in this many documents are ordered by frequency; so many of the most frequent are kept for it.
FREQUENT, FREQUENT_KEPT = 256, 1 << 17
#: Id tables up to this many rows are broadcast (some 20 to 80 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: DivideSkip's weight of a probe, and lists merged by the heap up to this total length (longer ones as sorted runs).
PROBE_WEIGHT, HEAP_LENGTH = 0.0085, 512

_COEFFICIENTS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    starts, ends, first = word_spans(data, offsets, lut("space"))
    words = span_hashes(LOWER[data], starts, ends)
    m = max(0, len(words) - WORDS + 1)
    rolled = np.zeros(m, np.uint64)
    for k in range(WORDS):
        rolled += words[k : k + m] * _COEFFICIENTS[k]
    rolled = mix64(rolled)
    out = []
    for lo, hi in itertools.pairwise(first.tolist()):
        if hi - lo >= WORDS:
            own = np.sort(rolled[lo : hi - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif hi > lo:
            out.append(mix64((words[lo:hi] * _COEFFICIENTS[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n: int) -> int:
    """Least overlap of a set of n with any set it is linked to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def similar(overlap, a, b):
    return DENOMINATOR * overlap >= NUMERATOR * (a + b - overlap)


def _groups(numbers: np.ndarray, shards: int):
    """(shard, positions) of each shard that has any."""
    order = np.argsort(numbers.astype(np.uint16) if shards <= 1 << 16 else numbers, kind="stable")
    bounds = np.searchsorted(numbers[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        yield s, order[bounds[s] : bounds[s + 1]]


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


_PACKED = "shard int, docs binary, counts binary, tokens binary, often binary, times binary"
_PACKED_NAMES = ["shard", "docs", "counts", "tokens", "often", "times"]


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=_PACKED_NAMES)


def _deal_shingles(shards: int):
    """Rows of (shard, documents, their numbers of shingles there, low halves of the hashes, those of several documents, how many).

    Shingles of several documents at hand are counted here.  Set sizes, and how many shingles are known to
    be shared, go with shard -1 - s.
    """

    def flush(ids, sets):
        tokens, off = ragged(sets)
        sizes = np.diff(off)
        ids = np.array(ids, np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(tokens)
        tokens, doc = tokens[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(tokens)))
        several = np.repeat(times > 1, times)
        shared = np.bincount(doc[several], minlength=len(ids))
        rows = [(-1 - int(ids[0]) % shards, ids.tobytes(), sizes.astype(np.uint32).tobytes(), shared.astype(np.uint32).tobytes(), b"", b"")]
        single, single_doc = tokens[~several], doc[~several]
        by_doc = np.argsort(single_doc, kind="stable")
        single, single_doc = single[by_doc], single_doc[by_doc]
        often, often_times = tokens[first[times > 1]], times[times > 1].astype(np.uint32)
        alone, common = dict(_groups(_shard_of(single, shards), shards)), dict(_groups(_shard_of(often, shards), shards))
        none = np.zeros(0, np.int64)
        for s in alone.keys() | common.keys():
            at, more = alone.get(s, none), common.get(s, none)
            own, counts = np.unique(single_doc[at], return_counts=True)
            rows.append((s, ids[own].tobytes(), counts.astype(np.uint32).tobytes(), single[at].astype(np.uint32).tobytes(), often[more].astype(np.uint32).tobytes(), often_times[more].tobytes()))
        return _packed_batch(rows)

    def run(batches):
        ids, sets, held = [], [], 0
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, "text"):
                found = shingle_sets(data, offsets)
                ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                sets += found
                held += sum(map(len, found))
                if held >= FLUSH_SHINGLES:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, sets)

    return run


_SHARED = "bucket int, docs binary, n binary, shared binary, token long, df long"
_SHARED_NAMES = ["bucket", "docs", "n", "shared", "token", "df"]


def _count_shared(buckets: int):
    """Rows of many documents each, dealt by document: its size (or -1) and its shingles here that occur in another one.

    Frequent shingles come with their document counts in rows of their own.
    """
    return lambda batches: _shared_rows(batches, buckets)


def _by_shard(batches):
    """(shard, its columns) of rows ordered by shard: one shard is held at a time."""
    now, held = None, []
    for batch in batches:
        for s, *columns in zip(*batch.columns, strict=True):
            if s.as_py() != now:
                if held:
                    yield now, held
                now, held = s.as_py(), []
            held.append([c.as_py() for c in columns])
    if held:
        yield now, held


def _shared_rows(batches, buckets: int):
    ids, sizes, known, with_shared, shared, hot, hot_df = [], [], [], [], [], [], []
    for s, parts in _by_shard(batches):
        join = lambda i, kind: np.frombuffer(b"".join(p[i] for p in parts), kind)  # noqa: B023, E731
        docs, counts, low = join(0, np.int64), join(1, np.uint32), join(2, np.uint32)
        if s < 0:
            ids.append(docs)
            sizes.append(counts.astype(np.int64))
            known.append(low.astype(np.int64))
            continue
        # Single shingles first, each of one document; then those counted before.
        every = np.concatenate([low, join(3, np.uint32)])
        times = np.concatenate([np.ones(len(low), np.int64), join(4, np.uint32).astype(np.int64)])
        if not len(every):
            continue
        order = np.argsort(every)
        ordered = every[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        df = np.add.reduceat(times[order], first)
        also = np.empty(len(every), bool)
        also[order] = np.repeat(df > 1, np.diff(np.append(first, len(every))))
        n = np.bincount(np.repeat(np.arange(len(docs)), counts)[also[: len(low)]], minlength=len(docs))
        with_shared.append(docs[n > 0])
        shared.append(n[n > 0])
        often = df >= FREQUENT
        hot.append((np.int64(s) << 32) | ordered[first[often]].astype(np.int64))
        hot_df.append(df[often])
    empty = np.zeros(0, np.int64)
    b, where = np.unique(np.concatenate([*with_shared, empty]), return_inverse=True)
    b_shared = np.bincount(where, np.concatenate([*shared, empty]), len(b)).astype(np.int64)
    docs = np.concatenate([*ids, b])
    n = np.concatenate([*sizes, np.full(len(b), -1, np.int64)])
    count = np.concatenate([*known, b_shared])
    rows = [(k, docs[at].tobytes(), n[at].tobytes(), count[at].tobytes()) for k, at in _groups(_shard_of(mix64(docs.astype(np.uint64)), buckets), buckets)]
    if rows:
        columns = list(zip(*rows, strict=True))
        null = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:]), null, null], names=_SHARED_NAMES)
    tokens = np.concatenate([*hot, empty])
    if len(tokens):
        none = pa.nulls(len(tokens), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(tokens), pa.int32()), none, none, none, pa.array(tokens), pa.array(np.concatenate(hot_df).astype(np.int64))], names=_SHARED_NAMES)


def _sum_documents(batches):
    """doc_id, n, shared over all rows of a task; a document's rows all reach one task. Of several texts the least set counts."""
    parts = [[np.frombuffer(x.as_py(), np.int64) for x in row] for batch in batches for row in zip(*batch.columns, strict=True)]
    if parts:
        docs, n, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, where = np.unique(docs, return_inverse=True)
        size = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(size, where[n > 0], n[n > 0])
        size[size == np.iinfo(np.int64).max] = 0
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), pa.array(np.bincount(where, shared, len(ids)).astype(np.int64))], names=["doc_id", "n", "shared"])


def level_of(n: int) -> int:
    """4 ** level sublists: 16 to 64 shingles each on average."""
    level = 0
    while n >= 16 * 4 ** (level + 1):
        level += 1
    return level


_POSTING = np.dtype([("key", "<u8"), ("doc", "<i8"), ("m", "<u4"), ("a", "<u8"), ("b", "<u8")])


def postings(doc_id: int, tokens: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Prefix postings of each sublist. weight: 0, or how frequent a shingle is."""
    n, level = len(tokens), level_of(len(tokens))
    if not n:
        return []
    levels = [level] if DENOMINATOR * n < NUMERATOR * 16 * 4 ** (level + 1) else [level, level + 1]
    bit = (tokens >> np.uint64(8)) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    low, high = np.where(bit < 64, one, np.uint64(0)), np.where(bit >= 64, one, np.uint64(0))
    out = []
    for lev in levels:
        part = tokens >> np.uint64(64 - 2 * lev) if lev else np.zeros(n, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(first, n))
        group = np.repeat(np.arange(len(first)), sizes)
        order = np.lexsort((tokens, weight, group))
        prefix = sizes - -(-NUMERATOR * sizes // DENOMINATOR) + 1
        keep = order[np.arange(n) - first[group] < prefix[group]]
        p = np.empty(len(keep), _POSTING)
        p["key"] = mix64(tokens[keep] + np.uint64(lev))
        p["doc"], p["m"] = doc_id, sizes[group[keep]]
        p["a"] = np.bitwise_xor.reduceat(low, first)[group[keep]]
        p["b"] = np.bitwise_xor.reduceat(high, first)[group[keep]]
        out.append(p)
    return out


def _equal_joined(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings with equal key, size and signature once, by their least document, and the pairs (document, that one)."""
    p = p[np.lexsort((p["doc"], p["b"], p["a"], p["m"], p["key"]))]
    new = np.ones(len(p), bool)
    new[1:] = (p["key"][1:] != p["key"][:-1]) | (p["m"][1:] != p["m"][:-1]) | (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1])
    least = p["doc"][new][np.cumsum(new) - 1]
    pairs = np.stack([p["doc"], least], axis=1)[~new]
    return p[new], np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _deal_postings(frequent, hot_shards: int, shards: int):
    """Rows of (shard, postings), and of pairs already known: (-1 - s, documents two by two)."""

    def flush(parts):
        every, pairs = _equal_joined(np.concatenate(parts))
        rows = [(s, every[at].tobytes()) for s, at in _groups(_shard_of(every["key"], shards), shards)]
        pairs = _spanning(pairs)
        if len(pairs):
            rows.append((-1 - int(pairs[0, 0]) % shards, pairs.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "postings"])

    def run(batches):
        keys, df = frequent.value
        parts, held = [], 0
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, "text"):
                for doc_id, tokens in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), shingle_sets(data, offsets), strict=True):
                    weight = np.zeros(len(tokens), np.int64)
                    if len(keys):
                        full = (_shard_of(tokens, hot_shards) << 32) | (tokens & np.uint64(0xFFFFFFFF)).astype(np.int64)
                        at = np.minimum(np.searchsorted(keys, full), len(keys) - 1)
                        weight = np.where(keys[at] == full, df[at], 0)
                    parts += postings(doc_id, tokens, weight)
                    held += len(tokens)
                if parts and held >= FLUSH_SHINGLES:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _near(p: np.ndarray, u: int, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` may be 0.8 similar to posting u: sizes, and the signatures' distance."""
    m, mu = p["m"][others].astype(np.int64), int(p["m"][u])
    far = np.bitwise_count(p["a"][others] ^ p["a"][u]).astype(np.int64) + np.bitwise_count(p["b"][others] ^ p["b"][u])
    # |A xor B| <= (|A| + |B|) (1 - t) / (1 + t) for Jaccard t.
    return (far * (NUMERATOR + DENOMINATOR) <= (m + mu) * (DENOMINATOR - NUMERATOR)) & (DENOMINATOR * np.minimum(m, mu) >= NUMERATOR * np.maximum(m, mu))


def _block_edges(batches):
    """A spanning forest of the pairs that some inverted list lets through, shard by shard."""
    for s, parts in _by_shard(batches):
        raw = b"".join(p[0] for p in parts)
        del parts
        if s < 0:
            yield _edge_batch(_spanning(np.frombuffer(raw, np.int64).reshape(-1, 2)))
        else:
            p, pairs = _equal_joined(np.frombuffer(raw, _POSTING))
            del raw
            yield _edge_batch(_shard_edges(p, pairs))


def _edge_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """A spanning forest of pairs of ids."""
    ids, at = np.unique(pairs, return_inverse=True)
    forest = Forest(len(ids))
    kept = [k for k, (x, y) in enumerate(at.reshape(-1, 2).tolist()) if forest.join(x, y)]
    return pairs[kept]


def _shard_edges(p: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A spanning forest of known pairs and those that the lists of postings (ordered by key) let through."""
    ids, at = np.unique(np.concatenate([p["doc"], known.ravel()]), return_inverse=True)
    doc, known = at[: len(p)], at[len(p) :].reshape(-1, 2)
    first = np.flatnonzero(np.concatenate([[True], p["key"][1:] != p["key"][:-1]]))
    size = np.diff(np.append(first, len(p)))
    forest, edges = Forest(len(ids)), []

    def link(x: int, y: int) -> None:
        if forest.join(x, y):
            edges.append((x, y))

    for a, b in known.tolist():
        link(a, b)
    pair = first[size == 2]
    if len(pair):
        m, n = p["m"][pair].astype(np.int64), p["m"][pair + 1].astype(np.int64)
        far = np.bitwise_count(p["a"][pair] ^ p["a"][pair + 1]).astype(np.int64) + np.bitwise_count(p["b"][pair] ^ p["b"][pair + 1])
        good = (far * (NUMERATOR + DENOMINATOR) <= (m + n) * (DENOMINATOR - NUMERATOR)) & (DENOMINATOR * np.minimum(m, n) >= NUMERATOR * np.maximum(m, n))
        x, y = doc[pair[good]], doc[pair[good] + 1]
        for a, b in np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1).T.tolist():
            link(a, b)
    for at, n in sorted(zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True), key=lambda r: -r[1]):
        own = doc[at : at + n].tolist()
        root = forest.find(own[0])
        if all(forest.find(x) == root for x in own):
            continue
        waiting = np.arange(at, at + n)
        while len(waiting):
            queue, waiting = [int(waiting[0])], waiting[1:]
            while queue and len(waiting):
                u = queue.pop()
                hit = _near(p, u, waiting)
                if hit.any():
                    found = waiting[hit]
                    waiting = waiting[~hit]
                    for v in found.tolist():
                        link(int(doc[u]), int(doc[v]))
                    queue += found.tolist()
    e = np.array(edges, np.int64).reshape(-1, 2)
    return ids[e]


def merge_counts(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur in at least ``least`` of the sorted lists, with the number of lists."""
    if sum(map(len, lists)) <= HEAP_LENGTH:
        found = [(x, n) for x, n in ((x, sum(1 for _ in run)) for x, run in itertools.groupby(heapq.merge(*(v.tolist() for v in lists)))) if n >= least]
        return np.array([x for x, _ in found], np.int64), np.array([n for _, n in found], np.int64)
    every = np.sort(np.concatenate(lists), kind="stable")  # sorted runs: a merge
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    n = np.diff(np.append(first, len(every)))
    return every[first[n >= least]], n[n >= least]


def divide_skip(lists: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in at least ``threshold`` of the sorted lists, and in how many."""
    lists = sorted((v for v in lists if len(v)), key=len)
    if len(lists) < threshold:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    longest = len(lists[-1])
    n_long = min(threshold - 1, int(threshold / (PROBE_WEIGHT * math.log2(longest) + 1)) if longest > 1 else 0)
    short, probed = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    ids, counts = merge_counts(short, threshold - n_long)
    for k, v in enumerate(probed):
        if not len(ids):
            break
        at = np.searchsorted(v, ids)
        counts = counts + (v[np.minimum(at, len(v) - 1)] == ids)
        alive = counts + (len(probed) - k - 1) >= threshold
        ids, counts = ids[alive], counts[alive]
    return ids, counts


def search(sets: list[np.ndarray], labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (positions) that connect every component of the sets' similarity graph; equal labels are connected already."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    tokens, off = ragged(sets)
    by_token = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(len(sets)), n)[by_token]
    ordered = tokens[by_token]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    stop = np.append(first[1:], len(ordered))
    number = np.empty(len(tokens), np.int64)
    number[by_token] = np.repeat(np.arange(len(first)), stop - first)
    # Lists ascend by position, and so by size.
    root, links, recent = np.arange(len(sets)), [], []
    members = {i: [i] for i in range(len(sets))}

    def merge(x: int, y: int) -> bool:
        x, y = int(root[x]), int(root[y])
        if x == y:
            return False
        if len(members[x]) < len(members[y]):
            x, y = y, x
        gone = members.pop(y)  # the smaller side is renamed: each set at most log2 times
        root[gone] = x
        members[x] += gone
        return True

    def link(x: int, y: int) -> None:
        if merge(x, y):
            links.append((order[x], order[y]))

    if labels is not None:
        seen: dict[int, int] = {}
        for i, k in enumerate(order):
            merge(seen.setdefault(labels[k], i), i)
    for q in range(len(sets)):
        lo = int(np.searchsorted(n, needed(int(n[q]))))
        if lo >= q:
            recent.append(q)
            continue
        # A link to a recent set first: then only sets outside that component are searched for.
        for x in recent[-2:]:
            if x >= lo and root[x] != root[q] and similar(len(np.intersect1d(sets[q], sets[x], assume_unique=True)), n[q], n[x]):
                link(q, x)
                break
        free = root[lo:q] != root[q]
        if free.any():
            some = not free.all()
            lists = []
            for t in number[off[q] : off[q + 1]].tolist():
                v = owner[first[t] : stop[t]]
                if len(v) > 1:
                    a, b = np.searchsorted(v, (lo, q))
                    v = v[a:b]
                    if some and len(v):
                        v = v[free[v - lo]]
                    if len(v):
                        lists.append(v)
            ids, counts = divide_skip(lists, needed(int(n[q])))
            for x in ids[similar(counts, n[q], n[ids])].tolist():
                link(q, x)
        if len(members[int(root[q])]) == 1 or not recent or root[recent[-1]] != root[q] or q % 16 == 0:
            recent.append(q)
    return links


def _search_runs(batches):
    """Links of each run of rows (block, lo, hi, doc_id, label, set); runs are groups, in order."""

    def finish(docs):
        ids, labels, sets = zip(*docs, strict=True)
        return _edge_batch(np.array([(ids[x], ids[y]) for x, y in search(list(sets), list(labels))], np.int64).reshape(-1, 2))

    now, docs = None, []
    for batch in batches:
        for block, lo, hi, doc_id, label, packed in zip(*batch.columns, strict=True):
            key = (block.as_py(), lo.as_py(), hi.as_py())
            if key != now:
                if len(docs) > 1:
                    yield finish(docs)
                now, docs = key, []
            docs.append((doc_id.as_py(), label.as_py(), np.frombuffer(packed.as_py(), np.uint64)))
    if len(docs) > 1:
        yield finish(docs)


_GROUPED = "doc_id long, block long, label long, at array<struct<lo: int, hi: int>>, tokens binary"


def _group_sets(batches):
    for batch in batches:
        keep = [batch.column(i) for i in range(4)]
        for lo, hi, data, offsets in text_slices(batch, "text"):
            sets = [s.tobytes() for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in keep), pa.array(sets, pa.binary())], names=["doc_id", "block", "label", "at", "tokens"])


def _search_groups(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Links inside groups (doc_id, block, label, at: the places (lo, hi) in the block that a document goes to)."""
    sets = _with_ids(texts, groups).select("doc_id", "block", "label", "at", "text").mapInArrow(tidy(_group_sets), _GROUPED).filter("octet_length(tokens) > 0")
    rows = sets.select("block", F.explode("at").alias("k"), "doc_id", "label", "tokens").select("block", "k.lo", "k.hi", "doc_id", "label", "tokens")
    parts = spread(texts.sparkSession, texts)
    return rows.repartition(parts, "block", "lo", "hi").sortWithinPartitions("block", "lo", "hi", "doc_id").mapInArrow(tidy(_search_runs), "a long, b long")


_OWN = "cast(pmod(xxhash64(doc_id), slices) as int)"


def _block_links(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges that connect what is similar in the blocks (doc_id, block, n).

    A block of one slice is one search.  In larger ones a document's label is the component known so far:
    slices alone (first), then one document of each component (second), then, of the documents outside the
    block's largest component, each against all (third): any two documents of different components of
    which one is outside the largest one meet in a group.
    """
    filled = F.expr(f"cast(ceil(sum(n) / {SLICE_SHINGLES}) as int) as slices")
    alone = F.expr(f"array(named_struct('lo', {_OWN}, 'hi', {_OWN})) as at")
    members = materialise(blocks.join(blocks.groupBy("block").agg(filled), "block"), "members")
    first = _search_groups(texts, members.select("doc_id", "block", F.col("doc_id").alias("label"), alone))
    large = members.filter("slices > 1")
    if not large.limit(1).count():
        return first
    edges = materialise(first, "links")

    now = _labelled(large, edges)
    leader = now.groupBy("block", "label").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("d")).select("block", "label", "d.*")
    leaders = materialise(leader.join(leader.groupBy("block").agg(filled), "block"), "leaders")
    edges = materialise(edges.unionByName(_search_groups(texts, leaders.select("doc_id", "block", "label", alone))), "links")

    now = materialise(_labelled(large, edges), "labels")
    sizes = now.groupBy("block", "label").agg(F.sum("n").alias("n"))
    most = sizes.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), *(F.expr(f"cast(ceil({x} / {BLOCK_SHINGLES}) as int)").alias(name) for name, x in (("outer", "(sum(n) - max(n))"), ("slices", "sum(n)"))))
    left = materialise(now.drop("slices").join(most.filter("outer > 0"), "block"), "left")
    if not left.limit(1).count():
        return edges
    own_outer = "cast(pmod(xxhash64(doc_id, 1), outer) as int)"
    column = f"transform(sequence(0, outer - 1), u -> named_struct('lo', {_OWN}, 'hi', u))"
    row = f"if(label = largest, array(), transform(sequence(0, slices - 1), s -> named_struct('lo', s, 'hi', {own_outer})))"
    third = left.select("doc_id", "block", "label", F.expr(f"array_distinct(concat({column}, {row})) as at"))
    return edges.unionByName(_search_groups(texts, third))


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with ``label``, their component by the edges so far."""
    own = edges.join(members.select(F.col("doc_id").alias("a")), "a", "left_semi")
    found = materialise(components(own).select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "components")
    return members.join(found, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def _with_ids(docs: DataFrame, ids: DataFrame, how: str = "inner") -> DataFrame:
    """Join on doc_id with a table of ids: broadcast if it is small, else by shuffle."""
    small = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", how)


def links(texts: DataFrame, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes: doc_id, n; edges: a, b spanning every component) for distinct texts (doc_id, text)."""
    spark = texts.sparkSession
    parts = spread(spark, texts)
    shards = shards or 2 * parts
    dealt = texts.select("doc_id", "text").mapInArrow(tidy(_deal_shingles(shards)), _PACKED)
    counted = materialise(dealt.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(tidy(_count_shared(parts)), _SHARED), "shared")
    by_document = counted.filter("bucket is not null").repartition(parts, "bucket").select("docs", "n", "shared")
    sizes = materialise(by_document.mapInArrow(_sum_documents, "doc_id long, n long, shared long"), "sizes")
    alive = sizes.filter(f"n > 0 and {DENOMINATOR} * shared >= {NUMERATOR} * n").select("doc_id")

    hot = counted.filter("token is not null").orderBy(F.desc("df"), "token").limit(FREQUENT_KEPT).select("token", "df").collect()
    discard(counted)
    hot = np.array(sorted((r[0], r[1]) for r in hot), np.int64).reshape(-1, 2)
    frequent = spark.sparkContext.broadcast((hot[:, 0].copy(), hot[:, 1].copy()))
    dealt = _with_ids(texts, alive).select("doc_id", "text").mapInArrow(tidy(_deal_postings(frequent, shards, shards)), "shard int, postings binary")
    rough = components(dealt.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(tidy(_block_edges), "a long, b long"))

    blocks = materialise(rough.select(F.col("node").alias("doc_id"), F.col("component").alias("block")).join(sizes.select("doc_id", "n"), "doc_id"), "blocks")
    return sizes.select("doc_id", "n"), _block_links(texts, blocks)


def _sizes_by_digest(batches):
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch, "text"):
            n = [len(s) for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64())], names=["digest", "own_n"])


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents (doc_id, text)."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    base = docs.select("doc_id", digest)
    # Written out, so that the join has a shuffle on either side: adaptive execution then splits a hot digest.
    least = materialise(base.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "least")
    members = materialise(base.join(least, "digest", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "digest"), "members")
    ids = members.filter("doc_id is not null").groupBy("doc_id").agg(F.expr("bool_and(doc_id != rep)").alias("copy"), F.expr("min(digest) != max(digest)").alias("several"))
    ids = materialise(ids.filter("copy or several"), "copies")
    distinct = _with_ids(docs.select("doc_id", "text").filter("doc_id is not null"), ids.filter("copy").select("doc_id"), "left_anti")
    sizes, found = links(distinct)
    members = members.join(sizes.select(F.col("doc_id").alias("rep"), "n"), "rep", "left")
    several = ids.filter("several").select("doc_id")
    if several.limit(1).count():
        # doc_ids with several texts: each row's own set size, and an edge to the least document of each of its texts.
        own = _with_ids(docs.select("doc_id", "text", digest), several, "left_semi").select("digest", "text").mapInArrow(tidy(_sizes_by_digest), "digest string, own_n long").distinct()
        members = materialise(members.join(own, "digest", "left").withColumn("n", F.coalesce("own_n", "n")), "sized")
        found = found.unionByName(_with_ids(members, several, "left_semi").filter("n > 0 and doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
        members = _with_ids(members, several.withColumn("_several", F.lit(True)), "left")
    else:
        members = members.withColumn("_several", F.lit(None).cast("boolean"))
    # A row looks up the component of its text's least document; one of several texts, that of its own doc_id.
    members = members.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("node", F.when(F.col("_several") | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("rep")))
    joined = components(found).select(F.col("node"), "component")
    out = members.join(joined, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id; all columns kept.

    Of rows repeated with that doc_id the least by text and the other columns is kept; rows without a
    doc_id are all kept.
    """
    first = classes(docs).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = materialise(first, "kept")
    rows = _with_ids(docs, kept.filter("_rows = 1").select("doc_id"), "left_semi")
    if kept.filter("_rows > 1").limit(1).count():
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        again = _with_ids(docs, kept.filter("_rows > 1").select("doc_id"), "left_semi")
        one = again.groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("_r"))
        rows = rows.unionByName(one.select(*(F.col("doc_id") if c == "doc_id" else F.col("_r")[c].alias(c) for c in docs.columns)))
    return rows.unionByName(docs.filter("doc_id is null"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM n UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.d)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n
"""
