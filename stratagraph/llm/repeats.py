"""Removal of repeated byte strings of a fixed length, across and within documents.

The suffixes of interest are the windows of `length` bytes. As in a
difference-cover algorithm only a sample of positions is named first, the
names are refined where they are ambiguous, and the remaining suffixes are
derived from the sample; but the sample is defined by content. The smallest
hash of the 24-byte strings in a window is its anchor, so equal windows have
equal anchors at equal offsets, which is the property that a difference cover
gives for fixed residues, at one sample for about 35 bytes.

1. Sample: runs of windows with one anchor are segments. Anchors that occur once
   are discarded: none of their windows can repeat.
2. Names: a segment's name is (anchor, digest of all its bytes). Of equal names
   all but the first place are repeats as a whole.
3. Recursion: where an anchor has several names, the first place of each name is
   cut into blocks of eight windows, named by (digest of the bytes all eight
   share, digest of all their bytes), and treated alike.
4. Remaining suffixes: where blocks share a core but differ, single windows are
   named by their bytes, and all but the first place are repeats.

All steps are aggregations with map-side combining and joins that can be split
when one name is frequent; nothing is gathered for a name. Texts cross the
network compressed.

Order of documents is (doc_id, hash of text); null doc_ids come first. Rows that
repeat both doc_id and text count as one document and get equal results: lists of
places are sets, so K such rows cost K times one. Null
texts are empty. Texts shorter than the length keep everything.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.common import cut, table, text_bytes
from stratagraph.llm.sentencepiece_codec import blocks

GRAM = 24
BLOCK = 8  # windows
SCAN_BYTES = 192 << 10  # hashed at a time, so that the arrays stay in cache
NO_ID = -(1 << 63)
# Odd 64-bit multipliers of the rolling hash.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """Hashes of all 24-byte strings, by doubling: 2, 4, 8, 16, and 16 with 8."""
    h = a.astype(np.uint64) + MIX[0]
    n8 = None
    for step, width in enumerate((1, 2, 4, 8)):
        h = h[:-width] * MIX[step + 1] + h[width:]
        h ^= h >> np.uint64(29)
        if width == 4:
            n8 = h
    h = h[:-8] * MIX[5] + n8[16:]
    h ^= h >> np.uint64(32)
    h *= MIX[1]
    return h ^ (h >> np.uint64(31))


def segments(data: bytes, starts: np.ndarray, length: int):
    """Segments of the texts whose starts (and the end) are given: text, start, windows, anchor place, anchor hash."""
    a = np.frombuffer(data, np.uint8)
    if len(a) < length:
        return None
    h = gram_hashes(a)
    least = (h & ~np.uint64((1 << 30) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: size - width], least[width - size :])
    anchor = (least & np.uint64((1 << 30) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(text[: len(anchor)] == text[length - 1 : length - 1 + len(anchor)])
    if not len(at):
        return None
    new = np.flatnonzero(np.r_[True, (anchor[at[1:]] != anchor[at[:-1]]) | (text[at[1:]] != text[at[:-1]])])
    start = at[new]
    windows = np.diff(np.r_[new, len(at)])
    place = anchor[start]
    return text[start], start, windows, place, h[place].view(np.int64)


def digest(raw: memoryview) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc, text_hash and raw: a document's key and bytes."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_bytes().alias("raw"))
    return d.select("doc", F.xxhash64("raw").alias("text_hash"), "raw")


def _segment_rows(docs: DataFrame, length: int, full: bool) -> DataFrame:
    schema = "anchor long" + ", name long, doc long, text_hash long, start int, windows int, place int" * full

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            for i, j in blocks([len(t) for t in texts], SCAN_BYTES):
                data = b"".join(texts[i:j])
                starts = np.r_[0, np.cumsum([len(t) for t in texts[i:j]])]
                found = segments(data, starts, length)
                if found is None:
                    continue
                text, start, windows, place, anchor = found
                if not full:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])
                    continue
                view = memoryview(data)
                name = [digest(view[s:e]) for s, e in zip(start.tolist(), (start + windows + length - 1).tolist(), strict=True)]
                which = pa.array(text + i)
                own = starts[text]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(name, pa.int64()), batch.column(0).take(which), batch.column(1).take(which), pa.array((start - own).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array((place - start).astype(np.int32))], ["anchor", "name", "doc", "text_hash", "start", "windows", "place"])

    return keyed(docs).mapInArrow(run, schema)


def named(items: DataFrame, group: str, name: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The items that are not the first of their name, and the first ones whose group has several names."""
    place = F.struct("doc", "text_hash", "start")
    first = cut(items.groupBy(group, name).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), f"{label}-first")
    out = items.join(first, [group, name], "left").withColumn("repeated", F.coalesce(F.col("first") != place, F.lit(False))).drop("first")
    out = cut(out, f"{label}-places")
    reps = out.where("not repeated")
    several = cut(reps.groupBy(group).agg((F.min(name) < F.max(name)).alias("several")).where("several").select(group), f"{label}-several")
    return out.where("repeated"), reps.join(several, group)


def _compressed(docs: DataFrame) -> DataFrame:
    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(x.as_py()) for x in batch.column(2)], pa.binary())], ["doc", "text_hash", "packed"])

    return keyed(docs).mapInArrow(run, "doc long, text_hash long, packed binary")


def _unpacker():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _segment_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted segments with their bytes."""
    lists = wanted.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("anchor", "start", "windows", "place")).alias("of"))

    def run(batches):
        unpack = _unpacker()
        for batch in batches:
            rows, size = [], 0
            for doc, text_hash, packed, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unpack(packed)
                for s in of:
                    part = raw[s["start"] : s["start"] + s["windows"] + length - 1]
                    rows.append((doc, text_hash, s["start"], s["windows"], s["place"], part))
                    size += len(part)
                if size > 8 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["doc", "text_hash", "segment", "windows", "place", "raw"])

    joined = _compressed(docs).join(lists, ["doc", "text_hash"])
    return joined.mapInArrow(run, "doc long, text_hash long, segment int, windows int, place int, raw binary")


def _block_rows(parts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for doc, text_hash, segment, windows, place, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view = memoryview(raw)
                for k in range(max(0, place - windows + 1) // BLOCK, place // BLOCK + 1):
                    low, high = max(0, place - BLOCK * k - BLOCK + 1), min(windows - 1, place - BLOCK * k)
                    core = place - BLOCK * k
                    out.append((xxhash.xxh3_64_intdigest(view[core : core + length - BLOCK + 1], seed=k) - (1 << 63), xxhash.xxh3_64_intdigest(view[low : high + length], seed=core - low) - (1 << 63), doc, text_hash, segment + low, high - low + 1, segment))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["core", "name", "doc", "text_hash", "start", "windows", "segment"])

    return parts.mapInArrow(run, "core long, name long, doc long, text_hash long, start int, windows int, segment int")


def _window_rows(parts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    lists = wanted.groupBy("doc", "text_hash", "segment").agg(F.collect_set(F.struct("start", "windows", "core")).alias("of"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text_hash, segment, raw, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view = memoryview(raw)
                for b in of:
                    for at in range(b["start"] - segment, b["start"] - segment + b["windows"]):
                        out.append((b["core"], digest(view[at : at + length]), doc, text_hash, segment + at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["core", "name", "doc", "text_hash", "start"])

    joined = parts.select("doc", "text_hash", "segment", "raw").join(lists, ["doc", "text_hash", "segment"])
    return joined.mapInArrow(run, "core long, name long, doc long, text_hash long, start int")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc, text_hash, start, end of byte spans that are covered by strings of `length` that start earlier; spans may overlap."""
    spark = docs.sparkSession
    span = lambda df: df.select("doc", "text_hash", "start", (F.col("start") + F.col("windows") + F.lit(length - 1)).alias("end"))
    again = cut(_segment_rows(docs, length, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    found = cut(_segment_rows(docs, length, True).join(again, "anchor"), "segments")
    spans0, open0 = named(found, "anchor", "name", "segment")
    parts = cut(_segment_bytes(docs, open0, length), "segment-bytes")
    spans1, open1 = named(cut(_block_rows(parts, length), "blocks"), "core", "name", "block")
    windows = cut(_window_rows(parts, open1, length), "windows")
    spans2, _ = named(windows.withColumn("windows", F.lit(1)), "core", "name", "window")
    return span(spans0).unionByName(span(spans1)).unionByName(span(spans2))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """Per document the figures of its removal; with_text adds kept, the bytes that stay."""
    spans = repeated_spans(docs, length).groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = cut(spans, "spans")

    def run(batches):
        unpack = _unpacker()
        for batch in batches:
            rows = []
            of = batch.column(2)
            flat, ends = of.flatten(), np.cumsum(of.value_lengths().fill_null(0).to_numpy()).tolist()
            start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            for doc, packed, low, high in zip(batch.column(0).to_pylist(), batch.column(1), [0, *ends], ends, strict=False):
                raw = unpack(packed.as_py())
                kept, n = raw, 0
                if high > low:
                    order = np.argsort(start[low:high])
                    s, reach = start[low:high][order], np.maximum.accumulate(end[low:high][order])
                    new = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
                    begin, stop = s[new].tolist(), reach[np.r_[new[1:] - 1, -1]].tolist()
                    kept, n = b"".join([raw[i:j] for i, j in zip([0, *stop], [*begin, len(raw)], strict=True)]), len(new)
                row = (None if doc == NO_ID else doc, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest())
                rows.append(row + (kept,) * with_text)
            if rows:
                types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    joined = _compressed(docs).join(spans, ["doc", "text_hash"], "left").select("doc", "packed", "spans")
    return joined.mapInArrow(run, RESULT + ", kept binary" * with_text)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
