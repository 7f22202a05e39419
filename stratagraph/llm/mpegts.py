"""MPEG transport streams as media columns.

Writing: a payload of 8-bit samples becomes elementary packets (PES) of a fixed
number of samples with presentation times; these are cut into 188-byte
transport packets with continuity counters. Program tables (PAT and PMT with
CRC) stand at the front and before every random-access point, whose first
packet has the random-access flag and a clock reference.

Reading: the program tables give the elementary stream, continuity counters
are checked, and packets are put together again by their start indicators. The
times of all elementary packets and the random-access points (time and the byte
of the stream from which reading can begin) are columns beside the samples, as
are the packets that are missing by the counters and the elementary packets
that are left out because a part of them is missing. A stream without a valid
program table, or of another packet size, has null for all of these.

A null text is empty; payloads are padded with zero bytes to a positive
multiple of 64. Texts of any length are handled one at a time. Every row gets a
row, repeated and null ids too; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.common import table, text_bytes

PACKET, PES_SAMPLES, RATE, CLOCK, ACCESS_EVERY = 188, 16384, 8000, 90000, 4
PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID, TABLE_EVERY = 0x1000, 0x100, 0x06, 0xBD, ACCESS_EVERY


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def section(table_id: int, ident: int, body: bytes) -> bytes:
    n = len(body) + 9
    head = bytes([table_id, 0xB0 | n >> 8, n & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return head + crc_mpeg(head).to_bytes(4, "big")


PAT = section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
PMT = section(2, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))


def table_packet(pid: int, body: bytes, count: int) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | count & 15, 0]) + body).ljust(PACKET, b"\xff")


def pes(data: bytes, pts: int) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1])
    return bytes([0, 0, 1, STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + data


def cut_packets(unit: bytes, pts: int, access: bool, count: int) -> np.ndarray:
    """Transport packets of one elementary packet."""
    first = min(len(unit), 176)
    full, tail = divmod(len(unit) - first, 184)
    n = 1 + full + (tail > 0)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    data = np.frombuffer(unit, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
    out[:, 3] = 0x10 | count + np.arange(n) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5] = 183 - first, 0x10 | 0x40 * access
    out[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
    out[0, PACKET - first :] = data[:first]
    if full:
        out[1 : 1 + full, 4:] = data[first : first + full * 184].reshape(full, 184)
    if tail:
        out[-1, 3] |= 0x20
        out[-1, 4] = 183 - tail
        if tail < 183:
            out[-1, 5] = 0
        out[-1, PACKET - tail :] = data[-tail:]
    return out


def mux(payload: bytes) -> bytes:
    out, count = [], 0
    for k in range(0, max(1, -(-len(payload) // PES_SAMPLES))):
        pts = k * PES_SAMPLES * CLOCK // RATE & (1 << 33) - 1
        access = k % ACCESS_EVERY == 0
        if access:
            out += [table_packet(0, PAT, k // TABLE_EVERY), table_packet(PMT_PID, PMT, k // TABLE_EVERY)]
        made = cut_packets(pes(payload[k * PES_SAMPLES : (k + 1) * PES_SAMPLES], pts), pts, access, count)
        count += len(made)
        out.append(made.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    times: list[int] = field(default_factory=list)
    access: list[tuple[int, int]] = field(default_factory=list)  # time and first byte of random-access points
    lost: int = 0  # packets missing by the continuity counters
    broken: int = 0  # elementary packets left out


def _section_of(packets: np.ndarray, start: np.ndarray, table_id: int) -> bytes:
    p = packets[0, start[0] :].tobytes()
    p = p[1 + p[0] :]
    n = 3 + (p[1] & 15) * 256 + p[2]
    if p[0] != table_id or crc_mpeg(p[:n]):
        raise ValueError("broken program table")
    return p[8 : n - 4]


def demux(media: bytes) -> Stream:
    a = np.frombuffer(media, np.uint8)
    if len(a) % PACKET or not len(a) or not (a[::PACKET] == 0x47).all():
        raise ValueError("not a transport stream")
    a = a.reshape(-1, PACKET)
    pid = (a[:, 1].astype(np.int32) & 31) << 8 | a[:, 2]
    adapted = a[:, 3] & 0x20 > 0
    start = np.where(adapted, 5 + a[:, 4].astype(np.int32), 4)
    own = pid == 0
    pat = _section_of(a[own], start[own], 0)
    programs = {pat[i] << 8 | pat[i + 1]: (pat[i + 2] & 31) << 8 | pat[i + 3] for i in range(0, len(pat), 4)}
    own = pid == next(v for k, v in programs.items() if k)
    pmt = _section_of(a[own], start[own], 2)
    at = 4 + ((pmt[2] & 15) << 8 | pmt[3])
    es = (pmt[at + 1] & 31) << 8 | pmt[at + 2]
    own = np.flatnonzero(pid == es)
    packets = a[own]
    count = packets[:, 3].astype(np.int32) & 15
    again = np.r_[False, (count[1:] == count[:-1]) & (packets[1:, 4:] == packets[:-1, 4:]).all(axis=1)]  # a packet may be sent twice
    own, packets, count, start, adapted = own[~again], packets[~again], count[~again], start[own][~again], adapted[own][~again]
    missing = np.r_[0, (np.diff(count) - 1) % 16]
    out = Stream(b"", lost=int(missing.sum()))
    data = packets[np.arange(PACKET) >= start[:, None]].tobytes()
    at = np.r_[0, np.cumsum(PACKET - start)]
    first = np.flatnonzero(packets[:, 1] & 0x40)
    flagged = adapted & (packets[:, 5] & 0x40 > 0) & (packets[:, 4] > 0)
    out.broken = int(len(first) == 0 or first[0] > 0)  # packets before the first start belong to a lost one
    parts = []
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(packets)], strict=True):
        unit = data[at[i] : at[j]]
        if missing[i + 1 : j].any() or unit[:3] != b"\0\0\1" or len(unit) != 6 + int.from_bytes(unit[4:6], "big"):
            out.broken += 1
            continue
        s = unit[9:14]
        out.times.append((s[0] & 14) << 29 | s[1] << 22 | (s[2] & 254) << 14 | s[3] << 7 | s[4] >> 1)
        if flagged[i]:
            out.access.append((out.times[-1], int(own[i]) * PACKET))
        parts.append(unit[9 + unit[8] :])
    out.payload = b"".join(parts)
    return out


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


def feature(s: Stream) -> str:
    """Packets, random-access points, last time, breaks, mean level and level changes through the middle."""
    x = np.frombuffer(s.payload, np.uint8)
    high = x >= 128
    return f"pes={len(s.times)};access={len(s.access)};last={s.times[-1] if s.times else -1};lost={s.lost};mean={int(x.sum(dtype=np.int64)) // max(len(x), 1)};cross={int((high[1:] != high[:-1]).sum())}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's transport stream."""

    def run(batches):
        for batch in batches:
            ids, media, n, size, at = batch.column(0), [], [], 0, 0
            for i, raw in enumerate(batch.column(1)):
                raw = raw.as_py()
                media.append(mux(padded(raw)))
                n.append(len(raw))
                size += len(media[-1])
                if size > 8 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(n)), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    at, media, n, size = i + 1, [], [], 0

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("raw")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


POINT = pa.list_(pa.struct([("time", pa.int64()), ("byte", pa.int64())]))
SAMPLES = {"payload": pa.binary(), "times": pa.list_(pa.int64()), "access": POINT, "lost": pa.int64(), "broken": pa.int64()}
SAMPLES_DDL = "payload binary, times array<long>, access array<struct<time: long, byte: long>>, lost long, broken long"
DIGESTS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()} | {k: v for k, v in SAMPLES.items() if k != "payload"}
DIGESTS_DDL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + SAMPLES_DDL.removeprefix("payload binary")


def _read(media: DataFrame, ddl: str, types: dict[str, pa.DataType], row) -> DataFrame:
    """doc_id, n_bytes and what row makes of a stored stream and its Stream, null where it can't be read."""

    def run(batches):
        for batch in batches:
            rows, size, at = [], 0, 0
            for i, stored in enumerate(batch.column(2)):
                m = stored.as_py()
                try:
                    rows.append(row(m, demux(m)))
                except (ValueError, IndexError, StopIteration):
                    rows.append((None,) * len(types))
                size += len(m)
                if size > 8 << 20 or i == batch.num_rows - 1:
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(k).slice(at, len(rows)) for k in (0, 1)] + cols, ["doc_id", "n_bytes", *types])
                    at, rows, size = i + 1, [], 0

    return media.select("doc_id", "n_bytes", F.coalesce("media", F.lit(b"")).alias("media")).mapInArrow(run, "doc_id long, n_bytes long, " + ddl)


def _points(s: Stream) -> list[dict]:
    return [{"time": t, "byte": b} for t, b in s.access]


def media_samples(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the samples read back from a media column, their times and random-access points, and what is missing."""
    return _read(media, SAMPLES_DDL, SAMPLES, lambda m, s: (s.payload, s.times, _points(s), s.lost, s.broken))


def media_digests(media: DataFrame) -> DataFrame:
    """Figures of the samples read back from a media column, with their times and random-access points."""

    def row(m: bytes, s: Stream) -> tuple:
        return len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(s), s.times, _points(s), s.lost, s.broken

    return _read(media, DIGESTS_DDL, DIGESTS, row)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(media_column(table(spark, sf_dir, "documents")))
