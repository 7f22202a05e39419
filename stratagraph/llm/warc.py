"""WARC archives: writing pages as records with segments, and reading them back whole.

Writing: equal payloads (by SHA-1 and length) are stored once, at the largest
page_id; the other pages become revisit records. A record's block is an HTTP
response in chunked framing; blocks over a size are split into a first record
and continuation records. Archives are gzip-compressed WARC/1.1 files in the
shared folder, each of a bounded number of records of bounded length.

Reading: a file is parsed record by record. Segmented records are dealt by
origin identifier and ordered by segment number, their total length is
verified, and the chunked framing is decoded. A record whose segments, length
or digest do not agree has intact = false and no payload figures.

A null html is an empty payload; all empty payloads are equal. Rows that repeat
a page_id and payload are each written; null page_ids sort first. Null urls
become an empty target. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.common import cut, scratch, table

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0:
            return None
        if n == 0:
            return b"".join(out)
        at = end + 2 + n
        if body[at : at + 2] != b"\r\n":
            return None
        out.append(body[end + 2 : at])
        at += 2


def record(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    name = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    origin = name()
    first = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": origin, "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""), "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id}
    if revisit:
        return [record(first | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": refers_to}, b"")]
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    first["Content-Type"] = "application/http; msgtype=response"
    if len(block) <= segment_bytes:
        return [record(first, block)]
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record(first | {"WARC-Segment-Number": 1}, cuts[0])]
    for k, part in enumerate(cuts[1:], 2):
        out.append(record({"WARC-Type": "continuation", "WARC-Record-ID": name(), "WARC-Date": first["WARC-Date"], "WARC-Target-URI": first["WARC-Target-URI"], "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": len(block) if k == len(cuts) else None}, part))
    return out


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10, records_per_file: int = 4096) -> None:
    """Write pages (page_id, url, html) as .warc.gz files below path."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    kept = p.groupBy("sha1", "size").agg(F.max("page_id").alias("kept_id"))
    dealt = p.join(kept, ["sha1", "size"]).select("page_id", "url", F.when(F.col("page_id").eqNullSafe(F.col("kept_id")), F.col("payload")).alias("payload"), "sha1", "kept_id")

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for page_id, url, payload, sha1, kept_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = page_records(page_id, url, payload or b"", base64.b32encode(sha1).decode(), kept_id, payload is None, segment_bytes, chunk_bytes)
                out += [r[:-1] for r in made]  # the text writer adds the last line feed
                size += sum(map(len, made))
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    written = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    written.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def parsed(data: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        n = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


PART = "origin string, segment int, total long, record_type string, page_id long, url string, refers_to long, payload_digest string, block binary"
READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary, n_segments int, intact boolean"


def _parse(batches):
    number = lambda v: int(v) if v not in (None, "") else None
    names = [x.split()[0] for x in PART.split(", ")]
    types = {"segment": pa.int32(), "total": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "block": pa.binary()}

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    for batch in batches:
        for content in batch.column(0):
            raw = content.as_py()
            rows, size = [], 0
            for h, block in parsed(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw):
                rows.append((h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), number(h.get("WARC-Segment-Number")), number(h.get("WARC-Segment-Total-Length")), h["WARC-Type"], number(h.get("X-Page-Id")), h.get("WARC-Target-URI"), number(h.get("X-Refers-To-Page-Id")), h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, block))
                size += len(block)
                if size > 8 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def _whole(rows: list[tuple]) -> tuple:
    """One record from its parts, which are ordered by segment number."""
    first = rows[0]
    _, segment, _, kind, page_id, url, refers_to, digest, _ = first
    if kind == "revisit":
        return page_id, url, kind, refers_to, digest, None, 1, True
    block = b"".join(r[8] for r in rows)
    ok = kind == "response" and (segment is None and len(rows) == 1 or [r[1] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1][2] == len(block))
    head = block.find(b"\r\n\r\n")
    payload = block[head + 4 :] if head >= 0 else None
    if payload is not None and b"transfer-encoding: chunked" in block[:head].lower():
        payload = dechunked(payload)
    ok = ok and payload is not None and (digest is None or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    return page_id, url, kind, refers_to, digest, payload if ok else None, len(rows), ok


def _assemble(batches):
    """Records from parts; the parts of a record follow each other in order."""
    names = [x.split()[0] for x in READ.split(", ")]
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary(), "n_segments": pa.int32(), "intact": pa.bool_()}

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    held: list[tuple] = []
    for batch in batches:
        out, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                out.append(_whole(held))
                size += sum(len(r[8]) for r in held)
                held = []
                if size > 8 << 20:
                    yield made(out)
                    out, size = [], 0
            held.append(row)
        if out:
            yield made(out)
    if held:
        yield made([_whole(held)])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All whole records below path. Only segmented records are shuffled."""
    files = spark.read.format("binaryFile").load(path).select("content")
    part = files.mapInArrow(_parse, PART)
    alone = part.where("segment is null").mapInArrow(_assemble, READ)
    split = part.where("segment is not null")
    joined = split.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(_assemble, READ)
    return alone.unionByName(joined)


def page_digests(records: DataFrame) -> DataFrame:
    """Per page: payload_bytes, payload_digest, record_type and refers_to; a revisit's figures are its response's. The figures without payloads are written, so that archives are parsed once."""
    r = cut(records.select("page_id", F.octet_length("payload").cast("long").alias("own_bytes"), "payload_digest", "record_type", "refers_to", "n_segments", "intact"), "digests")
    stored = r.where("record_type = 'response' and intact").groupBy(F.col("page_id").alias("stored_id"), F.col("payload_digest").alias("stored_digest")).agg(F.max("own_bytes").alias("stored_bytes"))
    found = r.join(stored, (r.record_type == "revisit") & r.refers_to.eqNullSafe(stored.stored_id) & (r.payload_digest == stored.stored_digest), "left")
    return found.select("page_id", F.coalesce("own_bytes", "stored_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "n_segments", "intact")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return page_digests(read_archives(spark, path))


# DuckDB has no base32, so the digest is built from the hexadecimal SHA-1, five bits at a time.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS kept FROM p),
b AS (SELECT *, list_reduce(list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789abcdef', substr(h, (i + 1)::INT, 1)) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce(list_transform(range(0, 5), lambda k: CASE WHEN substr(bits, (i * 5 + k + 1)::INT, 1) = '1' THEN (1 << (4 - k)::INT)::INT ELSE 0 END), lambda x, y: x + y) + 1, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to,
  CASE WHEN page_id <> kept THEN 1 ELSE ceil(s / 16384.0) END::INT AS n_segments, true AS intact
FROM (SELECT *, 88 + 5 + n + CASE WHEN n >= 4096 THEN (n // 4096) * 8 ELSE 0 END + CASE WHEN n % 4096 > 0 THEN length(printf('%x', n % 4096)) + 4 ELSE 0 END AS s FROM b)
"""
