"""Readers and writers: JSON lines, JSON arrays, text documents, keyed stores, collections."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators.sets import latest


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all machines share, ``spark.checkpoint.dir``; only a local session may lack it."""
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(found or f'file://{tempfile.gettempdir()}/checkpoints/docengine').rstrip('/')}/docengine-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once no plan reads it any more."""
    for df in tables:
        fs, p = _hadoop(df.sparkSession, df._scratch_path)
        fs.delete(p, True)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a table's files: their names, lengths and times."""
    fs, p = _hadoop(spark, path)
    files, seen = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:32]


def saved(spark: SparkSession, source: str, name: str, build) -> str:
    """The path of what ``build(path)`` writes from the table ``source``: built once for the same files, in the shared folder.

    It is built under a name of its own and renamed when whole, so a build that fails or loses a race leaves nothing
    that would be read.
    """
    fresh = scratch(spark, name)
    path = f"{fresh.rsplit('/', 1)[0]}/docengine-{name}-{fingerprint(spark, source)}"
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        build(fresh)
        if fs.exists(p) or not fs.rename(_hadoop(spark, fresh)[1], p):
            fs.delete(_hadoop(spark, fresh)[1], True)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """One object a line, blank lines skipped; ``tolerant`` drops corrupt lines, else they fail."""
    reader = spark.read.schema(schema).option("encoding", encoding).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    return (reader if encoding == "UTF-8" else reader.option("lineSep", "\n")).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_any_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By suffix: .jsonl by line, .json as an array."""
    return read_jsonl(spark, path, schema) if path.endswith(".jsonl") else read_json_array(spark, path, schema)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table where the file is missing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return read_jsonl(spark, path, schema) if there else spark.createDataFrame([], schema)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, title (first # line, else the file's stem), text of .md and .txt files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return raw.select("path", F.coalesce(F.nullif(F.trim(F.regexp_extract("text", r"(?m)^# (.*)$", 1)), F.lit("")), stem).alias("title"), "text")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_collection(df: DataFrame, path: str) -> int:
    """Create or overwrite, then hold the stored count against the input's (K3, K9)."""
    df.write.mode("overwrite").parquet(path)
    stored, given = df.sparkSession.read.parquet(path).count(), df.count()
    if stored != given:
        raise ValueError(f"{stored} rows stored, {given} given")
    return stored


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, version: str, target: str) -> None:
    """Last write wins per key; written to ``target``, as a table cannot be read and replaced at once (K6)."""
    latest(spark.read.parquet(path).unionByName(rows), key, version).write.mode("overwrite").parquet(target)


def delete(spark: SparkSession, path: str, ids: DataFrame, key: str, target: str) -> None:
    """The store without these keys, written to ``target`` (K6)."""
    without(spark, path, ids, key).write.mode("overwrite").parquet(target)


def clear(spark: SparkSession, path: str, target: str) -> None:
    """An empty store of the same schema (K4, K6)."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(target)


def write_json_array(df: DataFrame, path: str) -> None:
    """Files of one JSON array each, a row per line (K2, K8, K10); ``read_json_array`` reads them back."""

    def lines(batches):
        first = True
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"value": [("[" if first and i == 0 else ",") + r for i, r in enumerate(rows)]}, schema=pa.schema([("value", pa.string())]))
                first = False
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]}, schema=pa.schema([("value", pa.string())]))

    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """A small result table as JSON and as a Markdown table under ``path`` (K7)."""
    write_json_array(rows.coalesce(1), f"{path}/json")
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{' --- |' * len(rows.columns)}"
    cells = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), " | "), F.lit(" |"))
    top = rows.sparkSession.createDataFrame([(head,)], "value string")
    top.unionByName(rows.select(cells.alias("value"))).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def create_collection(spark: SparkSession, root: str, name: str, schema) -> None:
    """An empty collection, in place of one of that name."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")


def add_documents(rows: DataFrame, root: str, name: str) -> None:
    rows.write.mode("append").parquet(f"{root}/{name}")


def get_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def delete_collection(spark: SparkSession, root: str, name: str) -> None:
    """Deleting leaves an empty collection of the same schema."""
    create_collection(spark, root, name, get_collection(spark, root, name).schema)


def detect_encoding(head: bytes) -> str:
    """By a byte order mark, else by where the zero bytes of the first characters stand, else UTF-8."""
    for mark, name in ((b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"), (b"\xef\xbb\xbf", "UTF-8")):
        if head.startswith(mark):
            return name
    zeros = tuple(b == 0 for b in head[:4])
    return {(False, True, True, True): "UTF-32LE", (True, True, True, False): "UTF-32BE", (False, True, False, True): "UTF-16LE", (True, False, True, False): "UTF-16BE"}.get(zeros, "UTF-8")


_MARKS = (b"\xff\xfe", b"\xfe\xff", b"\xef\xbb\xbf")


def _decoded(spark: SparkSession, paths: list[str], schema: str, encoding: str) -> DataFrame:
    """JSON lines of files that Spark's reader does not take, in UTF-32 or with a byte order mark: a file is one task's."""

    def lines(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = [x for x in content.decode(encoding).lstrip("\ufeff").split("\n") if x.strip()]
                yield pa.RecordBatch.from_pydict({"line": rows}, schema=pa.schema([("line", pa.string())]))

    raw = spark.read.format("binaryFile").load(paths).select("content").mapInArrow(lines, "line string")
    return raw.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_detected(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, each file in the encoding that its own first bytes show.

    Tasks look at the files; a row a file reaches the driver, as does any listing.  The files of one encoding are then one
    read, which splits them, but for files in UTF-32 or with a byte order mark, which are decoded whole.
    """
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", F.expr("substring(content, 1, 4)").alias("head"))
    by: dict[tuple[str, bool], list[str]] = {}
    for r in heads.toLocalIterator():
        head = bytes(r["head"])
        encoding = detect_encoding(head)
        by.setdefault((encoding, encoding.startswith("UTF-32") or head.startswith(_MARKS)), []).append(r["path"])
    out = None
    for encoding, whole in sorted(by):
        paths = by[encoding, whole]
        part = _decoded(spark, paths, schema, encoding) if whole else read_jsonl(spark, paths, schema, encoding=encoding)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def write_texts(df: DataFrame, path: str, folder: str, text: str = "text") -> None:
    """Text rows under a relative path each, as folder=.../ files."""
    df.select(F.col(folder).alias("folder"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("folder").text(path)


def without(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """The collection without these ids (K4)."""
    return spark.read.parquet(path).join(ids.select(key), key, "left_anti")


def by_keys(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the ids that exist."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
