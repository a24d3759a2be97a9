"""Near-duplicate vectors by int8 tile products with rigorous error bounds (operator 11).

Vectors of one label and length are compared, all of them.  Equal vectors are one first, with a count.  The
distinct ones of a label are dealt to B blocks, and each pair of blocks is a tile: the unit of work, of
bounded size, so a label of a third of all rows is as many tiles as its square needs.  B grows with the root
of the label's size, which keeps the copies of a vector (B of them) and the products of a tile in balance,
and faster where ``TILE_BYTES`` would be exceeded.

In a tile each unit vector x is held as int8 codes q and a scale s with an exact residual e = |x - s q|.  The
product of two codes is a whole number, which single precision sums without rounding up to ``EXACT_WIDTH``
columns at a time; cos(x, y) then differs from s_x s_y q_x.q_y by at most e_x + e_y + e_x e_y (and by the
rounding of double precision, ``SLACK``).  A pair below the threshold by more than that is no link, one above
it by more is one; the pairs between are computed in double precision from the vectors themselves.

A tile gives each vector's count of links and a spanning forest of the links, not the links: a group of
thousands of near copies has millions of them.  The forests of all tiles have the same components as the
links, which ``components`` finds.

Defined results: a vector that is null, empty or zero or holds a null, NaN or infinite component, or whose
label or vec_id is null, has no links and is its own component (null, not kept, where vec_id is null);
vectors of different lengths are not compared; rows of one vec_id are one node with the links of each,
every row counts its own; -0.0 equals 0.0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread, tidy
from .components import components

THRESHOLD = 0.93
#: Vectors of a label for one block, before the root is taken; bytes of the vectors of one block at most.
BLOCK_ROWS, TILE_BYTES = 256, 1 << 24
#: Rows of one product, columns whose int8 products a float32 sums exactly (127 * 127 * 1024 < 2 ** 24).
STEP, EXACT_WIDTH = 1024, 1024
#: More than double precision can round off in a product of unit vectors.
SLACK = 1e-9


def usable(vector: Column, label: Column, key: Column) -> Column:
    """Rows that can link with others."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & key.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the length of what each code leaves out (with the rounding of its own sum)."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    left = np.sqrt(np.square(unit - codes * scale[:, None]).sum(axis=1))
    return codes.astype(np.int8), scale, left * (1 + SLACK) + SLACK


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The whole-number products of all rows of two code tables."""
    width = a.shape[1]
    if width <= EXACT_WIDTH:
        return a.astype(np.float32) @ b.astype(np.float32).T
    out = np.zeros((len(a), len(b)))
    for lo in range(0, width, EXACT_WIDTH):
        out += a[:, lo : lo + EXACT_WIDTH].astype(np.float32) @ b[:, lo : lo + EXACT_WIDTH].astype(np.float32).T
    return out


class Block:
    """The vectors of one block of a tile: unit vectors, their codes, node numbers and counts."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.nodes, self.copies = nodes, copies
        # By the largest component first: squares of very large or small ones stay finite.
        self.raw = vectors / np.abs(vectors).max(axis=1)[:, None]
        self.length = np.sqrt(np.einsum("ij,ij->i", self.raw, self.raw))
        self.codes, self.scale, self.left = quantise(self.raw / self.length[:, None])

    def __len__(self):
        return len(self.nodes)


def linked_pairs(a: Block, b: Block, threshold: float):
    """(rows of a, rows of b) of the linked pairs, step by step; of a block with itself each pair once."""
    for i in range(0, len(a), STEP):
        s, e = a.scale[i : i + STEP, None], a.left[i : i + STEP, None]
        for j in range(i if a is b else 0, len(b), STEP):
            near = code_products(a.codes[i : i + STEP], b.codes[j : j + STEP]) * (s * b.scale[j : j + STEP])
            f = b.left[j : j + STEP]
            near -= threshold
            bound = e + f + e * f + SLACK
            x, y = np.nonzero(near >= -bound)
            open_ = np.flatnonzero(near[x, y] <= bound[x, y])
            linked = np.ones(len(x), bool)
            linked[open_] = cosines(a, x[open_] + i, b, y[open_] + j) >= threshold
            if a is b and i == j:
                linked &= x < y
            yield x[linked] + i, y[linked] + j


def cosines(a: Block, x: np.ndarray, b: Block, y: np.ndarray) -> np.ndarray:
    """Of pairs of rows, in double precision."""
    out = np.empty(len(x))
    for lo in range(0, len(x), 1 << 14):
        p, q = x[lo : lo + (1 << 14)], y[lo : lo + (1 << 14)]
        out[lo : lo + (1 << 14)] = np.einsum("ij,ij->i", a.raw[p], b.raw[q]) / (a.length[p] * b.length[q])
    return out


def _forest(tree: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that join two trees; ``tree`` names each place's tree and is brought up to date."""
    kept = []
    while True:
        p, q = tree[x], tree[y]
        apart = np.flatnonzero(p != q)
        if not len(apart):
            break
        x, y, high, low = x[apart], y[apart], np.maximum(p, q)[apart], np.minimum(p, q)[apart]
        # Each tree hangs itself below one smaller tree, by one of the pairs: no ring can close.
        child, first = np.unique(high, return_index=True)
        kept.append((x[first], y[first]))
        under = np.arange(len(tree))
        under[child] = low[first]
        while True:
            above = under[under]
            if np.array_equal(above, under):
                break
            under = above
        tree[:] = under[tree]
    if not kept:
        return x[:0], y[:0]
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def tile_links(a: Block, b: Block | None, threshold: float):
    """Counts of linked vectors by node, and a forest of the links: (nodes, counts, from, to). Within a without b."""
    own = b is None
    b = a if own else b
    shift = 0 if own else len(a)
    tree, counts = np.arange(len(a) + (0 if own else len(b))), np.zeros(len(a) + (0 if own else len(b)), np.int64)
    edges = []
    for x, y in linked_pairs(a, b, threshold):
        if len(x):
            counts += np.bincount(x, b.copies[y], len(counts)).astype(np.int64) + np.bincount(y + shift, a.copies[x], len(counts)).astype(np.int64)
            edges.append(_forest(tree, x, y + shift))
    nodes = a.nodes if own else np.concatenate([a.nodes, b.nodes])
    some = np.flatnonzero(counts)
    x = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
    y = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
    return nodes[some], counts[some], nodes[x], nodes[y]


def _tiles(batches, threshold: float):
    """Of rows in order of tile and side: each tile's counts and forest (node, n, other)."""

    def result(tile):
        sides = [Block(np.concatenate([p[0] for p in side]), np.concatenate([p[1] for p in side]), np.concatenate([p[2] for p in side])) if side else None for side in tile]
        if sides[0] is None:
            return
        nodes, n, x, y = tile_links(sides[0], sides[1], threshold)
        for lo in range(0, len(nodes), 1 << 15):
            hi = min(lo + (1 << 15), len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[lo:hi]), pa.array(n[lo:hi]), pa.nulls(hi - lo, pa.int64())], names=["node", "n", "other"])
        for lo in range(0, len(x), 1 << 15):
            hi = min(lo + (1 << 15), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(x[lo:hi]), pa.nulls(hi - lo, pa.int64()), pa.array(y[lo:hi])], names=["node", "n", "other"])

    now, sides = None, ([], [])
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, side = batch.columns[:4], batch.column(4).to_numpy()
        node, copies, vectors = batch.column(5).to_numpy(), batch.column(6).to_numpy(), batch.column(7)
        change = np.diff(side) != 0
        for key in keys:
            change |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(change) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(side)], strict=True):
            tile = tuple(key[int(lo)].as_py() for key in keys)
            if tile != now:
                if now is not None:
                    yield from result(sides)
                now, sides = tile, ([], [])
            values = vectors.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sides[side[lo]].append((node[lo:hi], copies[lo:hi], values.reshape(hi - lo, -1)))
    if now is not None:
        yield from result(sides)


_KEY = ["key", "label", "embedding"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Usable rows with a short key before the vector, so that sorts and joins seldom look at the vector."""
    return rows.filter(usable(F.col("embedding"), F.col("label"), F.col("vec_id"))).select("vec_id", F.xxhash64("label", "embedding").alias("key"), "label", "embedding")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """node, rep, copies and the vector of each distinct usable one; node is a number of its own."""
    same = _keyed(rows).groupBy(*_KEY).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    return materialise(same.withColumn("node", F.monotonically_increasing_id()), "vectors")


def dealt_tiles(vectors: DataFrame) -> DataFrame:
    """label, width, low, high (together a tile), side, node, copies, embedding: each vector in every tile of its block."""
    sizes = vectors.groupBy("label", F.size("embedding").alias("width")).agg(F.count("*").alias("rows"))
    blocks = F.greatest(F.ceil(F.sqrt(F.col("rows") / BLOCK_ROWS)), F.ceil(F.col("rows") * F.col("width") * 8 / TILE_BYTES)).cast("int")
    dealt = vectors.withColumn("width", F.size("embedding")).join(sizes.select("label", "width", blocks.alias("blocks")), ["label", "width"])
    own = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    return each.select("label", "width", low, high, (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "copies", "embedding")


def links(vectors: DataFrame, threshold: float) -> DataFrame:
    """node, n (linked rows) and node, other (a forest of the links), of all tiles."""
    tile = ["label", "width", "low", "high"]
    dealt = dealt_tiles(vectors).repartition(spread(vectors.sparkSession, vectors), *tile).sortWithinPartitions(*tile, "side")
    return materialise(dealt.mapInArrow(tidy(lambda batches: _tiles(batches, threshold)), "node long, n long, other long"), "tiles")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (columns vec_id, embedding, label)."""
    rows = rows.select("vec_id", "label", "embedding")
    vectors = distinct_vectors(rows)
    found = links(vectors, threshold)
    counts = found.filter("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    sets = vectors.join(counts, "node", "left").select(*_KEY, "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = materialise(_keyed(rows).join(sets, _KEY).select("vec_id", "rep", "n_links"), "members")
    ends = vectors.select("node", "rep")
    edges = found.filter("other is not null").select("node", "other")
    edges = edges.join(ends.withColumnRenamed("rep", "a"), "node").join(ends.select(F.col("node").alias("other"), F.col("rep").alias("b")), "other").select("a", "b")
    # A vec_id of several different vectors is one node: it ties their sets together.
    repeated = own.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a != z").select("vec_id")
    edges = edges.unionByName(own.join(repeated, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    joined = components(edges)
    linked = own.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("vec_id", "n_links", F.coalesce("component", "rep").alias("component_id"))
    others = rows.filter(~usable(F.col("embedding"), F.col("label"), F.col("vec_id"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = f"""
with recursive usable as (
  select row_number() over () as r, vec_id, label, embedding::double[] as v, len(embedding) as width from embeddings
  where vec_id is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
near as materialized (
  select a.r, a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.width = b.width and a.r <> b.r
  where list_cosine_similarity(a.v, b.v) >= {THRESHOLD}
),
counts as (select r, count(*) as n from near group by r),
reach(node, other) as (
  select vec_id, vec_id from usable
  union
  select reach.node, near.b from reach join near on near.a = reach.other
),
least as (select node, min(other) as component_id from reach group by node)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from usable left join counts using (r) join least on node = vec_id
union all
select vec_id, 0, vec_id, vec_id is not null from embeddings
where vec_id is null or label is null or embedding is null
  or len(list_filter(embedding, lambda x: x is null or not isfinite(x))) > 0 or len(list_filter(embedding, lambda x: x <> 0)) = 0
"""
