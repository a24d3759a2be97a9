"""WARC archives: writer, monolithic gzip normaliser and indexed reader (operator 2).

``write_archives`` leaves files as many crawlers do: one gzip stream over a whole ``.warc.gz``.
``normalise`` inflates each such stream once, rewrites every record as its own gzip member and writes a
sidecar offset index (``.warc.gz.idx``, a JSON line per record) beside the new file.  ``read_archives`` seeks
by the index and inflates single members.  A file has at most ARCHIVE_BYTES of records (or one longer
record).  File names hold the task attempt that wrote them, and the tables that name the files are written
by Spark's own commit, so files of lost or repeated attempts are never read.

Of records with equal payloads of at least REVISIT_BYTES the one with the largest page_id is written as
response, the others as revisit records that refer to it.  A response's block is an HTTP head and the
payload, a revisit's the head alone, whose Content-Length is the payload's.

Defined results: null html is an empty payload; smaller payloads are all responses; rows repeated with
the same page_id are written each, with record ids of their own (all are responses if theirs is the largest
id); null page_ids are never a revisit's target unless the group has no other, and then all are responses;
null and empty urls are written as the page's urn and read as null; an empty table gives no archives;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, file_system, materialise, scratch

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 4 << 20
#: Digests with several pages: up to this many are broadcast (100 bytes each), more are joined by shuffle.
BROADCAST_ROWS = 500_000
_VERSION = b"WARC/1.1\r\n"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to, refers_to_url (null for responses).

    Only digests and ids are shuffled, with a map-side combine.  Where very many digests have several pages,
    the pages of at least ``least`` bytes are shuffled too; adaptive execution splits a hot digest, as both
    sides of the join are shuffles.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least
    groups = rows.filter(large).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("t"), F.count("*").alias("copies"))
    targets = materialise(groups.filter("copies > 1").select("digest", F.col("t.page_id").alias("target"), F.col("t.url").alias("target_url")), "warc-targets")
    if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(targets), "digest", "left")
    else:
        joined = rows.filter(large).join(targets, "digest", "left").unionByName(rows.filter(~large), allowMissingColumns=True)
    other = F.col("target") != F.coalesce("page_id", F.lit(-(1 << 63)))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("target")).alias("refers_to"), F.when(other, F.col("target_url")).alias("refers_to_url"))


def _uri(url: str | None, page_id: int | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A") or f"urn:page:{'' if page_id is None else page_id}"


def record_bytes(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_to_url: str | None = None) -> bytes:
    """One WARC record. The payload digest is in base 32, as crawlers write it; X- fields keep the page ids."""
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Target-URI: {_uri(refers_to_url, refers_to)}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_header(data: bytes) -> dict[str, str]:
    lines = data.decode().split("\r\n")
    if lines[0] + "\r\n" != _VERSION.decode():
        raise ValueError("not a WARC record")
    return {k: v for k, _, v in (line.partition(": ") for line in lines[1:])}


def records(pieces):
    """(header, block, whole record) of each record in a stream of byte pieces."""
    buffer = bytearray()
    pieces = iter(pieces)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while fill(1):
        end, seen = -1, 0
        while end < 0:
            end = buffer.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(buffer)
            if end < 0 and not fill(seen + 1):
                raise ValueError("a record ends in its header")
        header = parse_header(bytes(buffer[:end]))
        size = int(header["Content-Length"])
        if not fill(end + 8 + size):
            raise ValueError("a record ends in its block")
        whole = bytes(buffer[: end + 8 + size])
        if whole[-4:] != b"\r\n\r\n":
            raise ValueError("no end of record")
        yield header, whole[end + 4 : end + 4 + size], whole
        del buffer[: end + 8 + size]


def _write(path: str, limit: int):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = file_system(path)
        part, number, count, held, out, press, name = f"part-{task.partitionId():06d}-a{task.taskAttemptId():08d}", 0, 0, 0, None, None, None

        def close():
            nonlocal out, press, held, count, number
            out.write(press.flush())
            out.close()
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["name", "records"])
            out, press, held, count, number = None, None, 0, 0, number + 1
            return row

        for batch in batches:
            for page_id, url, html, digest, refers_to, refers_to_url in zip(*batch.columns, strict=True):
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}/{part}-{number}-{count}").urn
                record = record_bytes(record_id, page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py(), refers_to_url.as_py())
                if held and held + len(record) > limit:
                    yield close()
                if out is None:
                    name = f"{part}-{number:06d}.warc.gz"
                    out, press = files.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(press.compress(record))
                held += len(record)
                count += 1
        if out is not None:
            yield close()

    return run


def write_archives(planned: DataFrame, path: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """name, records: the files under ``path``, each one gzip stream. Written when called."""
    files, root = file_system(path)
    files.create_dir(root)
    rows = planned.select("page_id", "url", "html", "digest", "refers_to", "refers_to_url")
    return materialise(rows.mapInArrow(_write(path, limit), "name string, records long"), "warc-names")


def inflate(source, step: int = 1 << 18):
    """The inflated bytes of a gzip file (anything with read), member after member, in pieces."""
    piece = source.read(step)
    while piece:
        pump = zlib.decompressobj(31)
        while not pump.eof:
            if not piece:
                raise ValueError("the gzip stream is cut short")
            out = pump.decompress(piece)
            piece = pump.unused_data if pump.eof else source.read(step)
            if out:
                yield out
        piece = piece or source.read(step)


def _normalise(source: str, path: str):
    def run(batches):
        from pyspark import TaskContext

        attempt = f"a{TaskContext.get().taskAttemptId():08d}"
        files, root = file_system(path)
        _, whole = file_system(source)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new, at, lines = f"{attempt}-{name}", 0, []
                with files.open_input_file(f"{whole}/{name}") as old, files.open_output_stream(f"{root}/{new}", compression=None) as out:
                    for header, _, record in records(inflate(old)):
                        press = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = press.compress(record) + press.flush()
                        out.write(member)
                        lines.append(json.dumps({"record": header["WARC-Record-ID"], "type": header["WARC-Type"], "offset": at, "length": len(member)}))
                        at += len(member)
                with files.open_output_stream(f"{root}/{new}.idx", compression=None) as out:
                    out.write("".join(x + "\n" for x in lines).encode())
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([len(lines)], pa.int64())], names=["name", "records"])

    return run


def normalise(archives: DataFrame, source: str, path: str) -> DataFrame:
    """name, records: files under ``path`` with a member per record, and an index beside each. Written when called."""
    files, root = file_system(path)
    files.create_dir(root)
    return materialise(archives.select("name").mapInArrow(_normalise(source, path), "name string, records long"), "warc-names")


_RECORD = "archive string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def parse_record(header: dict[str, str], block: bytes) -> tuple:
    """(record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload); raises if it is damaged."""
    top, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in top.decode().split("\r\n")[1:])}
    record, kind, size = header["WARC-Record-ID"], header["WARC-Type"], int(fields["content-length"])
    digest = base64.b32decode(header["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"the payload of {record} is damaged")
    number = lambda name: int(header[name]) if name in header else None
    url = header["WARC-Target-URI"]
    return record, number("X-Page-ID"), None if url.startswith("urn:page:") else url, size, digest, kind, number("X-Refers-To-Page-ID"), payload


def _read(path: str, with_payload: bool):
    def run(batches):
        names = [c.split()[0] for c in _RECORD.split(", ")]
        files, root = file_system(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{name}.idx") as index, files.open_input_file(f"{root}/{name}") as archive:
                    for line in index.read().decode().splitlines():
                        entry = json.loads(line)
                        member = pa.BufferReader(archive.read_at(entry["length"], entry["offset"]))
                        header, block, _ = next(records(inflate(member)))
                        if header["WARC-Record-ID"] != entry["record"]:
                            raise ValueError("the index does not match the archive")
                        row = parse_record(header, block)
                        rows.append((name, *row[:-1], row[-1] if with_payload and row[5] == "response" else None))
                columns = list(zip(*rows, strict=True)) or [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=names)

    return run


def read_archives(archives: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of normalised archives; each response's payload is held against its digest."""
    return archives.select("name").mapInArrow(_read(path, with_payload), _RECORD)


def check_revisits(records_read: DataFrame) -> None:
    """Raises if a revisit's digest is not that of the response it refers to."""
    named = records_read.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    bad = named.join(records_read.filter("record_type = 'response'").select("page_id", "payload_digest"), ["page_id", "payload_digest"], "left_anti").first()
    if bad:
        raise ValueError(f"no response of page {bad['page_id']} has the digest {bad['payload_digest']}")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back; one row per page, without payloads. The archives are removed when all is read."""
    spark = pages.sparkSession
    whole, members = scratch(spark, "warc-whole"), scratch(spark, "warc-members")
    names = normalise(write_archives(plan_records(pages), whole), whole, members)
    read = materialise(read_archives(names, members, with_payload=False).drop("payload"), "warc-records")
    check_revisits(read)
    for path in (whole, members):
        delete_path(spark, path)
    return read


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS target FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN target <> page_id THEN target END AS refers_to
FROM g
"""
