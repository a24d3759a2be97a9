"""Chunking: merging short sections, semantic and recursive splitting, parents and children."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as X
from docengine.sources.files import written

SEPARATORS = ("\n\n###", "\n\n##", "\n\n", ". ")
RECURSIVE_SEPARATORS = ("\n\n", "\n    ", "\n  ", "\n", ". ", ", ", "; ", " ", "")


def semantic_split(text: str | None, least: int = 300, most: int = 800, overlap: int = 150) -> list[str]:
    """Pieces cut after the last separator between ``least`` and ``most`` with closed fences before it, else at ``most``."""
    if len(text or "") <= most:
        return [text or ""]
    return [piece for piece in semantic_pieces(text, least, most, overlap) if piece]


def semantic_pieces(text: str, least: int = 300, most: int = 800, overlap: int = 150, white: str | None = None) -> Iterator[str]:
    """The pieces in order, blank ones too, without ``white`` at their ends; a text up to ``most`` is one, as it is."""
    rest = text
    if len(rest) <= most:
        yield rest
        return
    while len(rest) > most:
        cut = most
        for sep in SEPARATORS:
            at = rest.rfind(sep, least, most)
            if at > least and rest[:at].count("```") % 2 == 0:
                cut = at + len(sep)
                break
        yield rest[:cut].strip(white)
        rest = rest[max(0, cut - overlap) :]
    yield rest.strip(white)


def recursive_split(text: str | None, size: int = 300, overlap: int = 150, separators=RECURSIVE_SEPARATORS) -> list[str]:
    """Split at the first separator present, recurse into what is too long, merge up to ``size`` with a carry-over (C4)."""

    def parts(s: str, seps) -> list[str]:
        if len(s) <= size:
            return [s] if s else []
        sep, rest = next(((x, seps[i + 1 :]) for i, x in enumerate(seps) if x == "" or x in s), ("", ()))
        if sep == "":
            return [s[i : i + size] for i in range(0, len(s), size)]
        cut = s.split(sep)
        pieces = [cut[0], *(sep + c for c in cut[1:])]
        return [q for p in pieces for q in parts(p, rest or ("",))]

    out, held = [], []
    for p in parts(text or "", tuple(separators)):
        if held and sum(map(len, held)) + len(p) > size:
            out.append("".join(held).strip())
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held.pop(0)
        held.append(p)
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def pack_paragraphs(text: str | None, size: int = 600) -> list[str]:
    """Paragraphs packed up to ``size``; a longer paragraph falls back to words."""
    out, held = [], ""
    for para in (p.strip() for p in (text or "").split("\n\n")):
        units, glue = ([para], "\n\n") if len(para) <= size else (para.split(), " ")
        for u in units:
            if not u:
                continue
            if held and len(held) + len(glue) + len(u) > size:
                out.append(held)
                held = ""
            held = f"{held}{glue}{u}" if held else u
    return [*out, held] if held else out


def split(df: DataFrame, text: str, splitter, out: str = "chunk", **options) -> DataFrame:
    """A row per piece with its chunk_index; splitting is sequential, so it runs in Arrow batches."""
    schema = df.drop(text)
    names = schema.columns
    declared = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields), "chunk_index int", f"{out} string", "total_chunks int"])

    def run(batches):
        for batch in batches:
            source, index, pieces, totals = [], [], [], []
            for i, value in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                found = splitter(value, **options)
                source += [i] * len(found)
                index += range(len(found))
                pieces += found
                totals += [len(found)] * len(found)
            at = pa.array(source, pa.int64())
            rest = [batch.column(batch.schema.get_field_index(n)).take(at) for n in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(index, pa.int32()), pa.array(pieces, pa.string()), pa.array(totals, pa.int32())], names=[*names, "chunk_index", out, "total_chunks"])

    return df.mapInArrow(run, declared)


def merge_short(sections: DataFrame, least: int = 300) -> DataFrame:
    """Adjacent sections (seq dense and unique, url, title, content) of one url joined while shorter than ``least``.

    Where a section starts anew is decided on lengths and titles alone: a run is cut wherever seq has a gap
    or the section before is itself long enough, and inside a run the lengths are summed up in order.
    Contents are then joined to their first section, one concatenation per merged section.
    """
    w = Window.partitionBy("url").orderBy("seq")
    narrow = sections.select("url", "seq", "title", F.length("content").alias("n"))
    start = F.when((F.col("seq") - F.lag("seq").over(w) == 1) & (F.lag("n").over(w) < least), 0).otherwise(1)
    runs = narrow.withColumn("_start", start).withColumn("_run", F.sum("_start").over(w))
    rows = runs.groupBy("url", "_run").agg(F.array_sort(F.collect_list(F.struct("seq", "title", "n"))).alias("rows"))
    # A merged section in the making: its first seq and title, its length so far; out: (seq, first seq) of every section.
    folded = F.expr(
        f"""aggregate(rows, cast(null as struct<first: bigint, title: string, n: int, out: array<struct<seq: bigint, first: bigint>>>), (acc, x) ->
            if(acc is not null and acc.n < {least},
               named_struct('first', acc.first, 'title', acc.title, 'n', acc.n + if(coalesce(x.title <> acc.title, false), 5 + length(x.title), 0) + 2 + x.n,
                 'out', concat(acc.out, array(named_struct('seq', x.seq, 'first', acc.first)))),
               named_struct('first', x.seq, 'title', x.title, 'n', x.n,
                 'out', concat(coalesce(acc.out, array()), array(named_struct('seq', x.seq, 'first', x.seq)))))).out"""
    )
    heads = rows.filter("size(rows) > 1").select("url", F.explode(folded).alias("m")).select("url", "m.seq", "m.first")
    return _joined(sections, heads)


def _joined(sections: DataFrame, heads: DataFrame) -> DataFrame:
    """Sections with their first one's seq (url, seq, first; itself where there is none) as merged sections."""
    placed = sections.join(heads, ["url", "seq"], "left").withColumn("_first", F.coalesce("first", "seq"))
    merged = placed.groupBy("url", "_first").agg(F.array_sort(F.collect_list(F.struct("seq", "title", "content"))).alias("rows"))
    part = lambda x: F.concat(F.when(x["title"] != F.col("rows")[0]["title"], F.concat(F.lit("\n\n## "), x["title"])).otherwise(F.lit("")), F.lit("\n\n"), x["content"])
    rest = F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), part)
    return merged.select(F.col("_first").alias("seq"), "url", F.col("rows")[0]["title"].alias("title"), F.concat(F.col("rows")[0]["content"], F.array_join(rest, "")).alias("content"))


def _following(seqs: list[int], titles: list, lengths: list[int], own: int, least: int) -> list[int]:
    """Of each of the first ``own`` rows: the place of the row that a merged section starting there does not take."""
    out = []
    for i in range(own):
        n, at = lengths[i], i + 1
        while n < least and at < len(seqs) and seqs[at] == seqs[at - 1] + 1:
            other = titles[at] is not None and titles[i] is not None and titles[at] != titles[i]
            n += (5 + len(titles[at]) if other else 0) + 2 + lengths[at]
            at += 1
        out.append(at)
    return out


def _groups(batches, key_columns: int):
    """(key, columns of its rows) of batches in order of their keys; a key's rows are bounded by the caller."""
    now, held = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:key_columns] != now:
                if now is not None:
                    yield now, held
                now, held = row[:key_columns], [[] for _ in row[key_columns:]]
            for column, value in zip(held, row[key_columns:], strict=True):
                column.append(value)
    if now is not None:
        yield now, held


def merge_short_split(sections: DataFrame, least: int = 300, block: int = 4096) -> DataFrame:
    """``merge_short`` as a segmented scan: one url of any length is worked on in blocks of ``block`` sections.

    Where a merged section ends follows from the at most ``least`` / 2 + 1 sections behind its first one, as each
    adds two characters.  A block sees so many rows of the next one and is summed up as a function: for each row at
    which it may be entered, the row at which the next block is.  These functions are composed along a url, a row a
    block; then each block is walked from its own entry.  Sections without a url are not merged.
    """
    halo, n = least // 2 + 2, max(1, int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if block < halo:
        raise ValueError(f"a block of {block} is shorter than a merged section may be, {halo}")
    narrow = sections.filter("url is not null").select("url", "seq", "title", F.length("content").alias("n")).withColumn("block", F.expr(f"seq div {block}"))
    over = narrow.filter(F.expr(f"seq % {block} < {halo}")).withColumn("block", F.col("block") - 1)
    rows = narrow.unionByName(over).repartition(n, "url", "block").sortWithinPartitions("url", "block", "seq").select("url", "block", "seq", "title", F.coalesce("n", F.lit(0)).alias("n"))

    def follow(batches):
        """A row a block: its rows' seqs and followers, and for each entry (the rows a section of the block before may leave it at) its exit and the last start before that."""
        for (url, at), (seqs, titles, lengths) in _groups(batches, 2):
            own = sum(s // block == at for s in seqs)
            if not own:
                continue
            after = _following(seqs, titles, lengths, own, least)
            exits, lasts = [0] * own, [0] * own
            for i in range(own - 1, -1, -1):
                exits[i], lasts[i] = (after[i], i) if after[i] >= own else (exits[after[i]], lasts[after[i]])
            seq_at = lambda i, seqs=seqs: seqs[i] if i < len(seqs) else seqs[-1] + 1
            near = sum(s % block < halo for s in seqs[:own])
            entries = range(min(near + 1, own))
            yield pa.RecordBatch.from_pydict(
                {"url": [url], "block": [at], "seqs": [seqs[:own]], "after": [[seq_at(i) for i in after]], "entries": [[seqs[i] for i in entries]], "exits": [[seq_at(exits[i]) for i in entries]], "lasts": [[seqs[lasts[i]] for i in entries]]},
                schema=_BLOCK,
            )

    blocks = written(rows.mapInArrow(follow, "url string, block long, seqs array<long>, after array<long>, entries array<long>, exits array<long>, lasts array<long>"), "merge-blocks")

    def compose(batches):
        """url, block, entry: the first row of each block at which a merged section starts; owner: the start of what is before it."""
        before = leave = last = None
        for batch in batches:
            out = []
            for url, at, entries, exits, lasts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if url != before:
                    before, leave, last = url, entries[0], None
                # The first row that the section before has not taken; it may take a whole block of few rows.
                i = next((i for i, e in enumerate(entries) if e >= leave), None)
                out.append((url, at, None if i is None else entries[i], last))
                if i is not None:
                    leave, last = exits[i], lasts[i]
            yield pa.RecordBatch.from_pydict({n: [o[i] for o in out] for i, n in enumerate(_ENTRY.names)}, schema=_ENTRY)

    heads = blocks.select("url", "block", "entries", "exits", "lasts").repartition(n, "url").sortWithinPartitions("url", "block")
    entered = blocks.select("url", "block", "seqs", "after").join(heads.mapInArrow(compose, "url string, block long, entry long, owner long"), ["url", "block"])

    def walk(batches):
        for batch in batches:
            for url, seqs, after, entry, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                next_of, start, firsts = dict(zip(seqs, after, strict=True)), entry, []
                for s in seqs:
                    if start is not None and s >= start:
                        first, start = s, next_of[s]
                    firsts.append(first)
                yield pa.RecordBatch.from_pydict({"url": [url] * len(seqs), "seq": seqs, "first": firsts}, schema=_HEAD)

    found = entered.select("url", "seqs", "after", "entry", "owner").mapInArrow(walk, "url string, seq long, first long")
    return _joined(sections, found)


_BLOCK = pa.schema([("url", pa.string()), ("block", pa.int64()), ("seqs", pa.list_(pa.int64())), ("after", pa.list_(pa.int64())), ("entries", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64())), ("lasts", pa.list_(pa.int64()))])
_ENTRY = pa.schema([("url", pa.string()), ("block", pa.int64()), ("entry", pa.int64()), ("owner", pa.int64())])
_HEAD = pa.schema([("url", pa.string()), ("seq", pa.int64()), ("first", pa.int64())])


def build_chunks(sections: DataFrame, least: int = 300, most: int = 800, overlap: int = 150) -> DataFrame:
    """Merged, split and enriched chunks keyed by (seq, chunk_index)."""
    merged = merge_short(sections, least).filter(X.strip(F.col("content")) != "")
    cut = split(merged, "content", semantic_split, "content", least=least, most=most, overlap=overlap)
    parent, current = X.section_levels(F.col("title"))
    return (
        cut.withColumn("source", X.detect_source(F.col("url")))
        .withColumn("parent_section", parent)
        .withColumn("current_section", current)
        .withColumn("has_code", X.has_code(F.col("content")))
        .withColumn("char_len", F.length("content"))
        .withColumn("tags", X.tags(F.col("content")))
        .withColumn("keywords", X.chunk_keywords(F.col("tags"), F.lit(None).cast("array<string>")))
        .withColumn("embed_text", X.embed_text(F.col("parent_section"), F.col("title"), F.col("content")))
    )


def with_sequence(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """A dense number from 0 in the given order: one count per sorted partition, then an offset (no single-task window)."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, F.col("_before") + F.expr("_place & 8589934591")).drop("_part", "_place", "_before")


def parents(sections: DataFrame, least: int = 100, most: int = 4000) -> DataFrame:
    """Sections that can be parents, with a deterministic id; longer ones are dropped."""
    kept = sections.filter(F.length("content").between(least, most))
    return kept.withColumn("parent_id", F.concat(F.lit("parent_"), F.left(F.sha2(F.concat_ws("|", "url", F.col("seq").cast("string")), 256), F.lit(16))))


def children(parent_rows: DataFrame, least: int = 30, cap: int = 30, size: int = 300, overlap: int = 150) -> DataFrame:
    """Children of each parent in order, short ones dropped, at most ``cap`` (C6: the cap is the feature)."""
    cut = split(parent_rows.select("parent_id", "content"), "content", recursive_split, "content", size=size, overlap=overlap)
    long = cut.filter(F.length("content") >= least)
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy("chunk_index"))
    return long.withColumn("_n", rank).filter(F.col("_n") <= cap).withColumn("child_id", F.concat_ws("_", F.lit("child"), "parent_id", F.col("_n").cast("string"))).drop("_n")


def coverage(parent_rows: DataFrame, child_rows: DataFrame, low: float = 0.8, high: float = 1.5) -> DataFrame:
    """parent_id, ratio, verdict: children's characters to the parent's."""
    sums = child_rows.groupBy("parent_id").agg(F.sum(F.length("content")).alias("chars"))
    ratio = F.round(F.coalesce("chars", F.lit(0)) / F.length("content"), 6)
    rows = parent_rows.join(sums, "parent_id", "left").select("parent_id", ratio.alias("ratio"))
    return rows.withColumn("verdict", F.when(F.col("ratio") < low, "low").when(F.col("ratio") > high, "high").otherwise("valid"))


def statistics(chunks: DataFrame, content: Column) -> DataFrame:
    """Counts, lengths, a three-bar histogram and the share with code."""
    n = F.length(content)
    return chunks.agg(
        F.count("*").alias("n"),
        F.round(F.avg(n), 4).alias("mean_len"),
        F.min(n).alias("min_len"),
        F.max(n).alias("max_len"),
        F.count_if(n < 300).alias("short"),
        F.count_if((n >= 300) & (n < 600)).alias("medium"),
        F.count_if(n >= 600).alias("long"),
        F.expr("count_if(contains(text, '```')) * 100 div greatest(count(*), 1)").alias("code_percent"),
    )
