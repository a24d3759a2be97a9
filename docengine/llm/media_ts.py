"""Media columns as MPEG transport streams (operator 10).

``encode`` wraps each text's bytes, padded, in a transport stream: a program association table, a
program map table, then elementary packets of up to PACKET_UNITS padding units, each with a
presentation time stamp, a clock reference and the random-access flag on its first packet.  The text's own
length, before padding, is a private descriptor of the program map.  ``features`` parses the stored bytes:
tables and their checksums, continuity counters, reassembled elementary packets, time stamps and
random-access points, which it returns as ``points`` (time stamp @ payload offset, comma-joined).

Defined results: null and empty texts are one unit of padding; equal texts give equal bytes and
features; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
A damaged stream raises.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, PAD = 576, 255
PACKET_UNITS = 16
TS, SYNC = 188, 0x47
PMT_PID, ES_PID, PROGRAM = 0x0100, 0x0101, 1
#: Private data carried in elementary packets; the private stream's id.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: 90 kHz ticks between two elementary packets.
TICKS = 3600
PES_HEADER = 14
#: Tag of the descriptor (user private) that holds the unpadded length in eight bytes.
LENGTH_TAG = 0x80


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table[i] = c
    return table


_CRC = _crc_table().tolist()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section_packet(pid: int, body: bytes) -> bytes:
    """One packet with a whole section: pointer field, section, checksum, stuffing."""
    section = body + crc32_mpeg(body).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(TS, b"\xff")


def _table_section(table_id: int, ident: int, payload: bytes) -> bytes:
    length = 5 + len(payload) + 4
    return bytes([table_id, 0xB0 | length >> 8, length & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0]) + payload


_PAT = _section_packet(0, _table_section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])))


def _pmt(n_bytes: int) -> bytes:
    descriptor = bytes([LENGTH_TAG, 8]) + n_bytes.to_bytes(8, "big")
    stream = bytes([STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, len(descriptor)]) + descriptor
    return _section_packet(PMT_PID, _table_section(2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]) + stream))


_LAYOUTS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(packets as bytes with fixed parts filled in, where the elementary packet's bytes go) for its payload size."""
    found = _LAYOUTS.get(size)
    if found is None:
        total, packets, at, places = PES_HEADER + size, [], 0, []
        while at < total:
            first, left = at == 0, total - at
            field = bytes([0x50]) + bytes(6) if first else b""  # random access and clock reference flags, then the clock
            need = 1 + len(field) if first else 0
            room = TS - 4 - need
            if left < room:
                spare = room - left
                if first:
                    field += b"\xff" * spare
                else:
                    field = b"" if spare == 1 else b"\x00" + b"\xff" * (spare - 2)
                adaptation = bytes([len(field)]) + field
            else:
                adaptation = bytes([len(field)]) + field if first else b""
            take = TS - 4 - len(adaptation)
            head = bytes([SYNC, (0x40 if first else 0) | ES_PID >> 8, ES_PID & 0xFF, 0x30 if adaptation else 0x10]) + adaptation
            places.append(len(packets) * TS + len(head) + np.arange(take))
            packets.append(head + bytes(take))
            at += take
        found = _LAYOUTS[size] = np.frombuffer(b"".join(packets), np.uint8).copy(), np.concatenate(places)
    return found


def _pts_bytes(pts: np.ndarray) -> np.ndarray:
    """The five bytes of a 33-bit time stamp."""
    p = pts.astype(np.int64)
    parts = (0x21 | (p >> 30 & 7) << 1, p >> 22 & 0xFF, (p >> 15 & 0x7F) << 1 | 1, p >> 7 & 0xFF, (p & 0x7F) << 1 | 1)
    return np.stack(parts, axis=1).astype(np.uint8)


def _pcr_bytes(base: np.ndarray) -> np.ndarray:
    """Six bytes: a 33-bit base, reserved bits, a zero extension."""
    b = base.astype(np.int64)
    parts = (b >> 25 & 0xFF, b >> 17 & 0xFF, b >> 9 & 0xFF, b >> 1 & 0xFF, (b & 1) << 7 | 0x7E, np.zeros_like(b))
    return np.stack(parts, axis=1).astype(np.uint8)


def mux(payload: bytes, n_bytes: int) -> bytes:
    """A transport stream with this payload, of which n_bytes are no padding."""
    data = np.frombuffer(payload, np.uint8)
    per = PACKET_UNITS * UNIT
    full = len(data) // per
    groups = [(np.arange(full), data[: full * per].reshape(full, per))] if full else []
    if len(data) % per:
        groups.append((np.array([full]), data[full * per :].reshape(1, -1)))
    out, count = [], 0
    for numbers, units in groups:
        fixed, places = _layout(units.shape[1])
        pts = numbers * TICKS & (1 << 33) - 1
        pes = np.empty((len(units), PES_HEADER + units.shape[1]), np.uint8)
        length = min(8 + units.shape[1], 0xFFFF)
        pes[:, :9] = (0, 0, 1, STREAM_ID, length >> 8, length & 0xFF, 0x84, 0x80, 5)
        pes[:, 9:14] = _pts_bytes(pts)
        pes[:, 14:] = units
        packets = np.repeat(fixed[None, :], len(units), axis=0)
        packets[:, places] = pes
        packets[:, 6:12] = _pcr_bytes(pts)
        by_packet = packets.reshape(-1, TS)
        by_packet[:, 3] |= ((count + np.arange(len(by_packet))) & 15).astype(np.uint8)
        count += len(by_packet)
        out.append(by_packet.tobytes())
    return b"".join([_PAT, _pmt(n_bytes), *out])


def _section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    start = 5 + raw[4]
    length = (raw[start + 1] & 0x0F) << 8 | raw[start + 2]
    section = raw[start : start + 3 + length]
    if raw[start] != table_id or crc32_mpeg(section) != 0:
        raise ValueError("damaged program table")
    return section[8:-4]


def demux(stream: bytes) -> dict:
    """payload, n_bytes, stream_type, packets, elementary, pts (list), random_access (payload offsets) and continuity_errors."""
    if not stream or len(stream) % TS:
        raise ValueError("not whole transport packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, TS)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    pat = _section(p[np.flatnonzero(pid == 0)[0]], 0)
    programs = {pat[i] << 8 | pat[i + 1]: (pat[i + 2] & 0x1F) << 8 | pat[i + 3] for i in range(0, len(pat), 4)}
    pmt = _section(p[np.flatnonzero(pid == programs[min(k for k in programs if k)])[0]], 2)
    at = 4 + ((pmt[2] & 0x0F) << 8 | pmt[3])
    stream_type, es_pid = pmt[at], (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]
    info, n_bytes = pmt[at + 5 : at + 5 + ((pmt[at + 3] & 0x0F) << 8 | pmt[at + 4])], None
    while info:
        if info[0] == LENGTH_TAG:
            n_bytes = int.from_bytes(info[2 : 2 + info[1]], "big")
        info = info[2 + info[1] :]
    es = p[pid == es_pid]
    control = es[:, 3] >> 4 & 3
    has_field, has_data = control >= 2, (control & 1) == 1
    counters = es[has_data, 3].astype(np.int16) & 15
    errors = int(((np.diff(counters) & 15) != 1).sum())
    if errors:
        raise ValueError(f"{errors} breaks of the continuity counter")
    field = np.where(has_field, es[:, 4].astype(np.int64), -1)
    flagged = (field > 0) & ((es[:, 5] & 0x40) != 0)
    first = (es[:, 1] & 0x40) != 0
    begin = np.where(has_data, 5 + field, TS)
    mask = np.arange(TS)[None, :] >= begin[:, None]
    body = es[mask]
    sizes = TS - begin
    starts = (np.cumsum(sizes) - sizes)[first]
    head = body[starts[:, None] + np.arange(PES_HEADER)]
    if (head[:, :3] != (0, 0, 1)).any() or (head[:, 7] & 0x80 == 0).any():
        raise ValueError("damaged elementary packet")
    h = head[:, 9:14].astype(np.int64)
    pts = (h[:, 0] >> 1 & 7) << 30 | h[:, 1] << 22 | h[:, 2] >> 1 << 15 | h[:, 3] << 7 | h[:, 4] >> 1
    header = 9 + head[:, 8].astype(np.int64)
    step = np.zeros(len(body) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + header, -1)
    keep = np.cumsum(step[:-1]) == 0
    offsets = starts - (np.cumsum(header) - header)
    payload = body[keep].tobytes()
    if n_bytes is None or len(payload) != n_bytes + (-n_bytes % UNIT or (0 if n_bytes else UNIT)):
        raise ValueError("the payload is not of the stated length")
    return {"payload": payload, "n_bytes": n_bytes, "stream_type": int(stream_type), "packets": len(p), "elementary": len(starts), "pts": pts.tolist(), "random_access": offsets[flagged[first]].tolist(), "access_pts": pts[flagged[first]].tolist(), "continuity_errors": errors}


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % UNIT or (0 if data else UNIT))


def _encode(batches):
    for batch in batches:
        media, held, done = [], 0, 0
        for i, text in enumerate(batch.column(1), 1):
            data = (text.as_py() or "").encode()
            media.append(mux(padded(data), len(data)))
            held += len(media[-1])
            if held > 32 << 20:  # long texts: smaller batches
                yield _media_batch(batch.column(0)[done:i], media)
                media, held, done = [], 0, i
        if media:
            yield _media_batch(batch.column(0)[done:], media)


def _media_batch(ids, media) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary())], names=["doc_id", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, media (the transport stream)."""
    return docs.select("doc_id", "text").mapInArrow(_encode, "doc_id long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points string"


def _decode(batches):
    names = [c.split()[0] for c in _FEATURES.split(", ")]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc_id, media in zip(*batch.columns, strict=True):
            raw = media.as_py()
            found = demux(raw)
            payload = found["payload"]
            pts, access = found["pts"], found["random_access"]
            feature = f"type={found['stream_type']};packets={found['packets']};elementary={found['elementary']};pts={pts[0]}..{pts[-1]};access={len(access)};last_access={access[-1] if access else -1};breaks={found['continuity_errors']}"
            marks = ",".join(f"{t}@{o}" for t, o in zip(found["access_pts"], access, strict=True))
            rows.append((doc_id.as_py(), found["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, marks))
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def features(media: DataFrame) -> DataFrame:
    """Features computed from stored streams (columns doc_id, media)."""
    return media.select("doc_id", "media").mapInArrow(_decode, _FEATURES)


def points(media: DataFrame) -> DataFrame:
    """doc_id, number, pts, payload_offset of every random-access point."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, media_bytes in zip(batch.column(0), batch.column(1), strict=True):
                found = demux(media_bytes.as_py())
                rows += [{"doc_id": doc_id.as_py(), "number": i, "pts": t, "payload_offset": o} for i, (t, o) in enumerate(zip(found["access_pts"], found["random_access"], strict=True))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("number", pa.int32()), ("pts", pa.int64()), ("payload_offset", pa.int64())]))

    return media.select("doc_id", F.col("media")).mapInArrow(run, "doc_id long, number int, pts long, payload_offset long")
