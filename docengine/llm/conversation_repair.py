"""Repair of conversation structure by a trie-shared dynamic programme (operator 12).

A conversation is reduced to its signature: a letter a row, of role and fault.  Distinct signatures are put
in order by a range shuffle, so each task walks a contiguous part of their prefix trie depth first: the
branch in hand is a stack of layers, and a signature that shares a prefix with the one before it only
computes the layers below the shared part.  A layer is the cheapest cost of each state of the grammar
``(s?(ua)+)?`` after so many rows.  At a signature's terminal node the cheapest edits are read off: the
layers are marked backwards along steps that keep the least cost, and the ASCII-least letters are followed
forwards through the marked states.  Memory is four numbers a row of the longest signature.

Rows are dealt by conversation twice: without their texts (a digest stands for a text) for the signature, and
with them, behind their conversation's edits, for the repaired text, which is hashed as it streams by.  Both
are read in order from a spilling sort, and no list of a conversation's rows is held but its signature; the
hash and the edits of one conversation are by nature one task's work, whatever its length.

Defined results: a null role or text, and a null conv_id or turn in the damage's key, are one space; rows of a
null conv_id are one conversation; rows of one turn are taken by role, then by the SHA-256 of their text;
initials are the first code point of a role, whatever the role, and a row of an initial other than s, u and a
is never kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, spread, tidy

INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: States of the grammar: nothing yet, after s, after u, after a; the next state by initial; where it may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
_FAR = 1 << 60
_BLANKS = "\x20\t\n\x0b\x0c\r"


def faulty(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it is cut short."""
    rest = F.rtrim(text, F.lit(_BLANKS))
    return rest == "", ~F.substring(rest, -1, 1).isin(".", "!", "?")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the damaged rows; a dropped one stays as a mark of its conversation."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    h = F.crc32(key.cast("binary")) % 20
    given = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), h.alias("h"))
    text = F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    damaged = given.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), F.when(F.col("h") == 3, 2).otherwise(1).alias("times"))
    return damaged.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")


def _streamed(rows: DataFrame, *order) -> DataFrame:
    """Rows of a conversation in one task, one conversation after the other."""
    return rows.repartition(spread(rows.sparkSession, rows), "conv_id").sortWithinPartitions("conv_id", *order)


_SIGNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def _sign(batches):
    """A row a conversation: its counts and signature. Columns conv_id, turn, initial, fault (null: gone)."""
    names = [f.split()[0] for f in _SIGNED.split(", ")]
    done: list[tuple] = []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string() if i == 6 else pa.int64()) for i in range(7)], names=names)
        done.clear()
        return batch

    def close(state):
        conv, low, high, turns, n, illegal, signature = state
        gaps = high - low + 1 - turns if turns else 0
        done.append((conv, gaps, n["b"], n["d"], n["t"], illegal, "".join(signature)))

    state = last = None
    for batch in batches:
        for conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != state[0]:
                if state is not None:
                    close(state)
                    if len(done) >= 4096:
                        yield flush()
                state, last = [conv, None, None, 0, dict.fromkeys("bdt-", 0), 0, []], None
            if fault is None:
                continue
            if turn is not None and turn != state[2]:
                state[1] = turn if state[1] is None else state[1]
                state[2], state[3] = turn, state[3] + 1
            state[4][fault] += 1
            if last is not None and last + initial not in ("su", "ua", "au"):
                state[5] += 1
            last = initial
            state[6].append(letter(initial, fault))
    if state is not None:
        close(state)
    if done:
        yield flush()


def letter(initial: str, fault: str) -> str:
    """Of a signature: s, u, a or o for the role, in upper case where the text is cut short; x must be deleted."""
    if fault in "bd":
        return "x"
    role = initial if initial in ("s", "u", "a") else "o"
    return role.upper() if fault == "t" else role


def signatures(damaged: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, signature of every conversation."""
    blank, short = faulty(F.col("text"))
    slim = damaged.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "gone", blank.alias("blank"), short.alias("short"))
    dealt = slim.repartition(spread(slim.sparkSession, slim), "conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("gone"), None).when(F.col("blank"), "b").when(F.col("seen"), "d").when(F.col("short"), "t").otherwise("-")
    marked = dealt.withColumn("seen", seen).withColumn("fault", fault)
    ordered = marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "seen")
    return ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault").mapInArrow(tidy(_sign), _SIGNED)


def steps(sign: str) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of what can be done with a row."""
    out = [("D", s, s, DELETE) for s in range(4)]
    if sign != "x":
        more = TRUNCATED if sign.isupper() else 0
        for s, ways in enumerate(NEXT):
            for initial, to in ways.items():
                if initial == sign.lower():
                    out.append(("K", s, to, more))
                if initial != "s":
                    out.append(("R", s, to, REROLE + more))
    return out


_STEPS = {sign: steps(sign) for sign in "xsuaoSUAO"}
_INSERTS = [("I", s, to, INSERT) for s, ways in enumerate(NEXT) for initial, to in ways.items() if initial != "s"]


def inserted(layer: list[int]) -> list[int]:
    """The layer with rows put in after it; two are enough to reach each state that any number reaches."""
    for _ in range(3):
        for _, s, to, cost in _INSERTS:
            layer[to] = min(layer[to], layer[s] + cost)
    return layer


def next_layer(layer: list[int], sign: str) -> list[int]:
    out = [_FAR] * 4
    for _, s, to, cost in _STEPS[sign]:
        out[to] = min(out[to], layer[s] + cost)
    return inserted(out)


def read_off(layers: list[list[int]], signature: str) -> tuple[int, str]:
    """The least cost, and the ASCII-least letters of it, from a signature's layers."""
    n = len(signature)
    cost = min(layers[n][s] for s in ENDS)
    marked = [0] * (n + 1)  # a bit a state

    def spread_back(i):
        for _ in range(3):
            for _, s, to, more in _INSERTS:
                if marked[i] >> to & 1 and layers[i][s] + more == layers[i][to]:
                    marked[i] |= 1 << s

    marked[n] = sum(1 << s for s in ENDS if layers[n][s] == cost)
    ends = marked[n]
    spread_back(n)
    for i in range(n - 1, -1, -1):
        for _, s, to, more in _STEPS[signature[i]]:
            if marked[i + 1] >> to & 1 and layers[i][s] + more == layers[i + 1][to]:
                marked[i] |= 1 << s
        spread_back(i)
    out, i, at = [], 0, 0
    while not (i == n and ends >> at & 1):
        ways = [(x, i, to) for x, s, to, more in _INSERTS if s == at and marked[i] >> to & 1 and layers[i][s] + more == layers[i][to]]
        if i < n:
            ways += [(x, i + 1, to) for x, s, to, more in _STEPS[signature[i]] if s == at and marked[i + 1] >> to & 1 and layers[i][s] + more == layers[i + 1][to]]
        x, i, at = min(ways)
        out.append(x)
    return cost, "".join(out)


class Trie:
    """The branch of the prefix trie in hand: signatures come in order, so no other branch is met again."""

    def __init__(self):
        self.layers, self.path, self.computed = [inserted([0, _FAR, _FAR, _FAR])], "", 0

    def answer(self, signature: str) -> tuple[int, str]:
        shared = 0
        for a, b in zip(self.path, signature, strict=False):
            if a != b:
                break
            shared += 1
        del self.layers[shared + 1 :]
        for sign in signature[shared:]:
            self.layers.append(next_layer(self.layers[-1], sign))
        self.computed += len(signature) - shared
        self.path = signature
        return read_off(self.layers, signature)


def _solve(batches):
    trie = Trie()
    for batch in batches:
        found = [trie.answer(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["signature", "cost", "audit"])


def solve(signed: DataFrame) -> DataFrame:
    """signature, cost, audit of each distinct signature."""
    distinct = signed.select("signature").distinct()
    ordered = distinct.repartitionByRange(spread(signed.sparkSession, signed), "signature").sortWithinPartitions("signature")
    return ordered.mapInArrow(tidy(_solve), "signature string, cost long, audit string")


def repaired(audit: str):
    """What to do with each row of a conversation, as the edits are walked: (before, role) generator.

    ``before`` are lines put in before the row; role is None for a deleted row, '' for a kept one.  The last
    item has the lines after all rows and the role None.
    """
    at, before = 0, []
    for x in audit:
        if x == "I":
            at = 3 if at == 2 else 2
            before.append("assistant:" if at == 3 else "user:")
            continue
        if x == "R":
            at = 3 if at == 2 else 2
            yield before, "assistant" if at == 3 else "user"
        elif x == "K":
            # Only an s can be kept first and leave u to come.
            kept = yield before, ""
            at = NEXT[at][kept]
        else:
            yield before, None
        before = []
    yield before, None


def _rewrite(batches):
    """conv_id, repaired_sha256. Columns conv_id, audit (of the first row of a conversation), role, text (null: gone)."""
    done: list[tuple] = []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        done.clear()
        return batch

    walk = conv = None
    sha, lines, kept = hashlib.sha256(), 0, None

    def write(line):
        nonlocal lines
        sha.update(b"\n" * bool(lines) + line.encode("utf-8", "surrogatepass"))
        lines += 1

    def step():
        before, role = walk.send(kept)
        for line in before:
            write(line)
        return role

    for batch in batches:
        for now, audit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is not None:
                if walk is not None:
                    step()
                    done.append((conv, sha.hexdigest()))
                    if len(done) >= 4096:
                        yield flush()
                walk, conv, sha, lines, kept = repaired(audit), now, hashlib.sha256(), 0, None
            elif text is not None:
                new = step()
                kept = None
                if new is not None:
                    write(f"{new or role}:{text}")
                    kept = role[:1] if new == "" else None
    if walk is not None:
        step()
        done.append((conv, sha.hexdigest()))
    if done:
        yield flush()


def rewrite(damaged: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the rows after damage, behind the edits of their conversation."""
    none = F.lit(None)
    heads = edits.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("string").alias("digest"), "audit")
    rows = damaged.filter("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.sha2("text", 256).alias("digest"), none.cast("string").alias("audit"))
    return _streamed(heads.unionByName(rows), "kind", F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "audit", "role", "text").mapInArrow(tidy(_rewrite), "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    damaged = damage(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    signed = materialise(signatures(damaged), "signatures")
    edits = materialise(signed.join(solve(signed), "signature").drop("signature"), "edits")
    hashes = rewrite(damaged, edits)
    out = edits.join(hashes, edits.conv_id.eqNullSafe(hashes.conv_id)).drop(hashes.conv_id)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


_ORDER = "turn nulls first, role, digest, seen"
ORACLE = f"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i)) as t
),
hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295), 4294967295) % 20 as h
  from conversations, crc
),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when h = 3 then 2 else 1 end)) as copy
  from hashed where h <> 0
),
marked as (
  select *, sha256(text) as digest, row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as seen,
    not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') as short
  from damaged
),
faults as (
  select *, case when blank then 'b' when seen then 'd' when short then 't' else '-' end as fault, left(role, 1) as initial,
    row_number() over w as i, left(lag(role) over w, 1) as before
  from marked window w as (partition by conv_id order by {_ORDER})
),
signs as (
  select *, case when fault in ('b', 'd') then 'x' when fault = 't' then upper(r) else r end as sign
  from (select *, case when initial in ('s', 'u', 'a') then initial else 'o' end as r from faults)
),
signed as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (before || initial not in ('su', 'ua', 'au')) as illegal, string_agg(sign, '' order by i) as signature
  from signs group by conv_id
),
everyone as (
  select distinct c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, coalesce(signature, '') as signature
  from conversations c left join signed s on c.conv_id is not distinct from s.conv_id
),
ways(initial, s, t) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('a', 2, 3), ('u', 3, 2)),
puts as (
  select s, s as t, 0 as cost, '' as letters from range(4) as r(s)
  union all select s, t, {INSERT}, 'I' from ways where initial <> 's'
  union all select a.s, b.t, 2 * {INSERT}, 'II' from ways a join ways b on a.t = b.s where a.initial <> 's' and b.initial <> 's'
),
row_steps as (
  select sign, s, s as t, {DELETE} as cost, 'D' as letter from unnest(string_split('xsuaoSUAO', '')) as x(sign), range(4) as r(s)
  union all select x.sign, s, t, x.more, 'K' from ways join (values ('s', 0), ('u', 0), ('a', 0), ('S', {TRUNCATED}), ('U', {TRUNCATED}), ('A', {TRUNCATED})) as x(sign, more) on lower(x.sign) = initial
  union all select x.sign, s, t, {REROLE} + x.more, 'R' from ways, (values ('s', 0), ('u', 0), ('a', 0), ('o', 0), ('S', {TRUNCATED}), ('U', {TRUNCATED}), ('A', {TRUNCATED}), ('O', {TRUNCATED})) as x(sign, more) where initial <> 's'
),
moves as (
  select sign, r.s, p.t, min({{'cost': r.cost + p.cost, 'letters': r.letter || p.letters}}) as m from row_steps r join puts p on r.t = p.s group by all
),
layers(signature, i, s, best) as (
  select signature, 0::bigint, p.t, {{'cost': p.cost, 'letters': p.letters}} from (select distinct signature from everyone), puts p where p.s = 0
  union all
  select signature, i + 1, m.t, min({{'cost': best.cost + m.m.cost, 'letters': best.letters || m.m.letters}})
  from layers join moves m on m.sign = signature[i + 1] and m.s = layers.s where i < length(signature) group by signature, i, m.t
),
solved as (select signature, min(best) as b from layers where i = length(signature) and s in (0, 3) group by 1),
audited as (select e.*, b.cost, b.letters as audit from everyone e join solved using (signature)),
letters as (select conv_id, unnest(string_split(audit, '')) as x, unnest(range(length(audit))) as pos from audited where audit <> ''),
numbered as (
  select *, count(*) filter (x <> 'I') over w as i, count(*) filter (x <> 'D') over w - 1 as j from letters window w as (partition by conv_id order by pos)
),
placed as (select n.*, s.role, s.text, s.initial from numbered n left join signs s on n.x in ('K', 'R') and s.conv_id is not distinct from n.conv_id and s.i = n.i where x <> 'D'),
lined as (
  select conv_id, pos, case when x = 'K' then role when (j - o) % 2 = 0 then 'user' else 'assistant' end || ':' || case when x = 'I' then '' else text end as line
  from (select *, (max(case when j = 0 and x = 'K' and initial = 's' then 1 else 0 end) over (partition by conv_id)) as o from placed)
),
hashes as (select conv_id, sha256(string_agg(line, chr(10) order by pos)) as h from lined group by 1)
select a.conv_id, gaps::bigint as gaps, blank, duplicate, truncated, illegal, cost::bigint as cost, audit, coalesce(h, sha256('')) as repaired_sha256
from audited a left join hashes on a.conv_id is not distinct from hashes.conv_id
"""
