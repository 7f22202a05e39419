"""SimHash near duplicates with keys of the Golay code.

A fingerprint has a bit where over half of the hashes of a text's shingles have it.
Distinct fingerprints are the nodes of a graph, so copies cost nothing more; two are
linked at up to four differing bits.

Candidates. A fingerprint is cut into segments of 22, 21 and 21 bits, each seen as a
word of the perfect Golay code of 23 bits, whose spheres of radius 3 fill the space.
A segment's near codewords are those that it, or it with one bit changed, decodes to:
one of them if the decoded codeword is at most 2 bits away, else up to six. Two
segments at up to two bits share a near codeword, as both reach the word between them.
Four errors fall on three segments in one of two ways:

- some segment has none; of the others one has at most two. Keys: the one whole, and
  each near codeword of the other.
- every segment has some; then two have exactly one, so their parities differ. Keys:
  the codewords that both decode to, given by the side with even parity of the first of
  them; the other side, with odd parity, asks for all near codewords of both.

So no pair is lost. Two unrelated fingerprints share such a key about once in 85,000
times, with about 77 keys for each; near codewords of two segments, without the parities
and whole segments, would meet some fifty times as often.

A key's fingerprints are compared in numpy by search from one to all that are left,
so a group of near copies costs what joins it, not its pairs, and yields a tree of
links. Keys of many fingerprints are cut into parts, dealt part against part. Components
come from rounds of stars, as in neardup.

Texts without words, empty and null ones have the fingerprint zero and are linked
like others. A row with a null doc_id takes part; a component's id is its smallest
doc_id that is not null, null if there is none. Repeated rows get equal rows. An
empty table gives none. Other columns are not read. Whole texts are hashed, a range of
shingles at a time.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.common import cut, release, table, text_bytes
from stratagraph.llm.infill import BLANK
from stratagraph.llm.neardup import LOWER, STARS, components, in_stars

WIDTHS = (22, 21, 21)
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
BITS = 4
PART = 2048
SMALL = 24  # buckets of so many fingerprints are compared all at once
ONE = np.uint64(1)


def fingerprint(raw: bytes, words: int = 4, step: int = 1 << 16) -> int:
    a = np.frombuffer(raw.translate(LOWER), np.uint8)
    blank = BLANK[a]
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank after each word
    a = np.where(blank, np.uint8(0x20), a)[keep]
    text = a.tobytes().strip(b" ")
    if not text:
        return 0
    gap = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    start, end = np.r_[0, gap + 1], np.r_[gap, len(text)]
    k = min(words, len(start))
    start, end = start[: len(start) - k + 1], end[k - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(start), step):
        h = np.array([digest(text[x:y], 42) for x, y in zip(start[i : i + step].tolist(), end[i : i + step].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp of every text, fp as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw")).mapInArrow(run, "doc_id long, fp long")


def remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


@lru_cache(1)
def decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of words by their high and low bits, and the errors that each remainder stands for."""
    unit = [remainder(1 << i) for i in range(23)]
    high, low = np.zeros(1 << 11, np.int64), np.zeros(1 << 12, np.int64)
    for t, first in ((high, 12), (low, 0)):
        for i in range(len(t).bit_length() - 1):
            t[1 << i : 2 << i] = t[: 1 << i] ^ unit[first + i]
    errors = np.zeros(1 << 11, np.int64)
    for n in (1, 2, 3):
        for at in combinations(range(23), n):
            r = 0
            for i in at:
                r ^= unit[i]
            errors[r] = sum(1 << i for i in at)
    return high, low, errors


@lru_cache(4)
def near_errors(width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each remainder up to six patterns that lead to near codewords, the decoded one first, and their number; changed bits are below width."""
    _, _, errors = decoder()
    out, n = np.zeros((1 << 11, 6), np.int64), np.zeros(1 << 11, np.int64)
    for r in range(1 << 11):
        found = dict.fromkeys([int(errors[r]), *(int(errors[r ^ remainder(1 << i)]) ^ (1 << i) for i in range(width))])
        out[r, : len(found)] = list(found)
        n[r] = len(found)
    return out, n


def near(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 6) indexes of near codewords, the decoded one first, and how many of each row count."""
    high, low, _ = decoder()
    patterns, n = near_errors(width)
    r = high[v >> 12] ^ low[v & 0xFFF]
    return (v[:, None] ^ patterns[r]) >> 11, n[r]


PLAIN, GIVEN, ASKED = 0, 1, 2


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, role) of the fingerprints' keys."""
    segment, at = [], 0
    for w in WIDTHS:
        segment.append(((fp >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64))
        at += w
    words, counts = zip(*(near(s, w) for s, w in zip(segment, WIDTHS, strict=True)), strict=True)
    odd = [np.bitwise_count(s) & 1 for s in segment]
    six = np.arange(6)
    rows, made, roles = [], [], []

    def add(row: np.ndarray, tag: int, a: np.ndarray, b: np.ndarray, role: int) -> None:
        rows.append(row)
        made.append((np.int64(tag) << 48) | (a << 12) | b)
        roles.append(np.full(len(row), role, np.int8))

    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        row, k = np.nonzero(six < counts[j][:, None])
        add(row, tag, segment[i][row], words[j][row, k], PLAIN)
    for tag, (i, j) in enumerate(combinations(range(3), 2), 6):
        row = np.flatnonzero(odd[i] == 0)
        add(row, tag, words[i][row, 0], words[j][row, 0] | odd[j][row].astype(np.int64) << 24, GIVEN)
        row, k, m = np.nonzero((six < counts[i][:, None])[:, :, None] & (six < counts[j][:, None])[:, None, :] & (odd[i] == 1)[:, None, None])
        add(row, tag, words[i][row, k], words[j][row, m] | (1 - odd[j][row].astype(np.int64)) << 24, ASKED)
    return np.concatenate(rows), np.concatenate(made), np.concatenate(roles)


def keyed(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), 4096):
                row, key, role = keys(fp[i : i + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i : i + 4096][row]), pa.array(role)], ["key", "fp", "role"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long, role byte")


def tree(v: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what links of at most bits differing bits join among v: each found value with the first one of its search."""
    left = np.unique(v)
    out_a, out_b = [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for x in range(0, len(front), 256):
                hit |= (np.bitwise_count(front[x : x + 256, None] ^ left) <= bits).any(axis=0)
            front, left = left[hit], left[~hit]
            out_a.append(np.full(len(front), root))
            out_b.append(front)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def linked(lists: pa.Array, bits: int = BITS):
    """Batches (a, b) of links in each list of fingerprints."""
    lists = lists.cast(pa.large_list(pa.int64()))
    flat = lists.flatten().to_numpy().view(np.uint64)
    size = lists.value_lengths().to_numpy()
    start = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])
    for n in range(2, SMALL + 1):
        of = start[size == n]
        x, y = np.triu_indices(n, 1)
        for i in range(0, len(of), 2048):
            a, b = flat[of[i : i + 2048, None] + x].ravel(), flat[of[i : i + 2048, None] + y].ravel()
            hit = (a != b) & (np.bitwise_count(a ^ b) <= bits)
            yield batch(a[hit], b[hit])
    for k in np.flatnonzero(size > SMALL):
        yield batch(*tree(flat[start[k] : start[k] + size[k]], bits))


def links(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Stars (u, v) that join linked fingerprints of nodes (fp), and the written tables they are read from."""
    every = keyed(nodes)
    has = lambda role: F.max((F.col("role") == role).cast("int"))
    count = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("role").alias("role"), has(GIVEN).alias("given")).where("n > 1 and (role = 0 or given = 1 and role = 2)")
    shared = cut(count.select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "shared-keys")
    met = every.join(shared.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    buckets = cut(met.groupBy("key", "part", "parts").agg(F.collect_list("fp").alias("fps")), "key-parts")
    one = buckets.where("parts = 1").select("fps")
    many = buckets.where("parts > 1")
    pairs = many.select("key", "fps", F.explode(F.sequence("part", F.col("parts") - 1)).alias("part")).join(many.select("key", "part", F.col("fps").alias("other")).hint("merge"), ["key", "part"]).select(F.concat("fps", "other").alias("fps"))

    def run(batches):
        for batch in batches:
            yield from linked(batch.column(0))

    return one.unionByName(pairs).mapInArrow(lambda batches: in_stars(run(batches)), STARS), [shared, buckets]


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id and kept, a row for every document."""
    s = cut(fingerprints(docs, words), "fingerprints")
    nodes = cut(s.groupBy("fp").agg(F.min("doc_id").alias("head")), "fingerprint-nodes")
    stars, read = links(nodes)
    label = components(stars)
    root = nodes.join(label.select(F.col("u").alias("fp"), F.col("v").alias("root")).hint("merge"), "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    root = cut(root, "fingerprint-roots")
    heads = cut(root.groupBy("root").agg(F.min("head").alias("component_id")), "fingerprint-heads")
    final = cut(root.select("fp", "root").join(heads.hint("merge"), "root").select("fp", "component_id"), "fingerprint-components")
    release(nodes, label, root, heads, *read)
    out = s.join(final.hint("merge"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
