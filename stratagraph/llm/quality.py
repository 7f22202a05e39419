"""Text quality by a factorisation machine.

Features of a text: its distinct words, lower-cased and hashed; structure
statistics (letter case, punctuation and symbol rates, repeated words and lines,
word length), each as a one-hot bin; metadata (n_chars) as a bin. The score is
sigma(w0 + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2)), so all pairs of
features interact in time linear in their number.

It is fitted with Adagrad on at most `bound` labelled rows, those of the
smallest hash of doc_id (of rows that repeat a doc_id, the text of the smallest hash); labels, lang, source and doc_id are not features. The
rest of the corpus is only scored.

Null texts count as empty; empty texts have the bins of an empty text. A null
n_chars counts as the characters of the text. Repeated labels of a doc_id: the largest counts.
A null doc_id is scored and counts as held out. With no labels, or labels of
one value only, every score is that share (1 where there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.bpe import binary, offsets
from stratagraph.llm.common import table, text_bytes
from stratagraph.llm.neardup import LOWER
from stratagraph.llm.sentencepiece_codec import blocks

BUCKETS = 1 << 16
BINS = 16
STATS = ("upper", "mark", "bar", "symbol", "digit", "distinct", "again", "word_length", "words", "lines_again", "line_length", "n_chars")
SIZE = BUCKETS + BINS * len(STATS)
# Byte classes: 0 other, 1 upper-case letter, 2 lower-case letter or part of a longer character, 3 digit, 4 '!' or '?', 5 '|', 6 symbol, 7 white space.
CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    CLASS[_b] = 1 if "A" <= _c <= "Z" else 2 if "a" <= _c <= "z" or _b >= 128 else 3 if "0" <= _c <= "9" else 4 if _c in "!?" else 5 if _c == "|" else 6 if _c in "#$%&*@^~<>{}[]\\_=+" else 7 if _c in " \t\n\r\v\f" else 0


def _share_bin(x: np.ndarray) -> np.ndarray:
    """Bins of a share, fine near 0 and coarse near 1: 0, up to 1/512, up to 1/256, ... ; halves are cut in four."""
    with np.errstate(divide="ignore"):
        low = np.clip(np.floor(np.log2(np.maximum(x, 1e-9))) + 11, 1, 9)
    return np.where(x <= 0, 0, np.where(x >= 0.25, np.minimum(10 + np.floor((x - 0.25) * 7), 15), low)).astype(np.int64)


def _size_bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(x, 0) + 1)), 0, BINS - 1).astype(np.int64)


def features(texts: list[bytes], n_chars: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed words of each text (sorted, distinct) and the bins of its statistics."""
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = offsets(np.array([len(t) + 1 for t in texts]))
    kind = CLASS[data]
    doc = np.repeat(np.arange(n), np.diff(starts))
    count = np.bincount(doc * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    count[:, 7] -= 1  # the line feed added above
    blank = kind == 7
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    first = np.searchsorted(begin, starts)
    n_words = np.diff(first).astype(float)
    hashed: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    distinct, again = np.zeros(n), np.zeros(n)
    if len(begin):
        raw = data[~blank].tobytes().translate(LOWER)
        coded = binary(raw, offsets(end - begin)).dictionary_encode()
        own = np.array([xxhash.xxh3_64_intdigest(w.as_buffer()) % BUCKETS for w in coded.dictionary], np.int64)
        which = coded.indices.to_numpy()
        same = np.r_[False, which[1:] == which[:-1]]
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b > a:
                u = np.unique(which[a:b])
                distinct[i], again[i] = len(u), same[a + 1 : b].sum()
                hashed[i] = np.unique(own[u])
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines], float)
    lines_again = n_lines - [len(set(x)) for x in lines]
    chars = np.maximum(count.sum(axis=1), 1)
    words = np.maximum(n_words, 1)
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    bins = np.stack([
        _share_bin(count[:, 1] / letters), _share_bin(count[:, 4] / words), _share_bin(count[:, 5] / words), _share_bin(count[:, 6] / words), _share_bin(count[:, 3] / chars),
        _share_bin(distinct / words), _share_bin(again / words), np.clip(chars / words, 0, BINS - 1).astype(np.int64), _size_bin(n_words), _share_bin(lines_again / n_lines), _size_bin(chars / n_lines), _size_bin(n_chars),
    ], axis=1)
    return hashed, bins + BUCKETS + BINS * np.arange(len(STATS))


@dataclass
class Machine:
    w0: float
    w: np.ndarray  # SIZE
    v: np.ndarray  # SIZE x factors

    def raw(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the sigmoid, the terms v x and their sums a row; every row has features."""
        q = self.v[index] * value[:, None]
        s = np.add.reduceat(q, first[:-1], axis=0)
        square = np.add.reduceat((q * q).sum(axis=1), first[:-1])
        return self.w0 + np.add.reduceat(self.w[index] * value, first[:-1]) + 0.5 * ((s * s).sum(axis=1) - square), q, s


def rows_of(hashed: list[np.ndarray], bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: indexes, values and row starts. Words share one unit of length, bins have 1 each."""
    n_words = np.array([len(h) for h in hashed])
    first = offsets(n_words + bins.shape[1])
    index = np.concatenate([x for h, b in zip(hashed, bins, strict=True) for x in (h, b)])
    value = np.concatenate([x for n in n_words for x in (np.full(n, 1 / np.sqrt(max(n, 1))), np.ones(bins.shape[1]))])
    return index, value, first


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, factors: int = 8, epochs: int = 8, batch: int = 128, rate: float = 0.08, decay: float = 1e-5) -> Machine:
    r = np.random.default_rng(7)
    share = float(labels.mean()) if len(labels) else 1.0
    m = Machine(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(SIZE), r.normal(0, 0.05, (SIZE, factors)))
    if not 0 < share < 1:
        m.w0, m.v = 60.0 * (share - 0.5), np.zeros_like(m.v)
        return m
    past_w, past_v, past_0 = np.full(SIZE, 1e-6), np.full((SIZE, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = r.permutation(len(labels))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            index, value = np.concatenate([rows[i] for i in own]), np.concatenate([values[i] for i in own])
            n = np.array([len(rows[i]) for i in own])
            raw, q, s = m.raw(index, value, offsets(n))
            g = (sigmoid(raw) - labels[own]) / len(own)
            each = np.repeat(g, n)
            touched, at = np.unique(index, return_inverse=True)
            gw = np.bincount(at, each * value) + decay * m.w[touched]
            gv = (each * value)[:, None] * (np.repeat(s, n, axis=0) - q)
            gv = np.stack([np.bincount(at, gv[:, f]) for f in range(factors)], axis=1) + decay * m.v[touched]
            past_w[touched] += gw * gw
            past_v[touched] += gv * gv
            past_0 += g.sum() ** 2
            m.w[touched] -= rate * gw / np.sqrt(past_w[touched])
            m.v[touched] -= rate * gv / np.sqrt(past_v[touched])
            m.w0 -= rate * g.sum() / np.sqrt(past_0)
    return m


def _inputs(docs: DataFrame):
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("raw"), F.coalesce(F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None), F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"))


def _blocks(batch):
    texts = [x.as_py() for x in batch.column(1)]
    chars = batch.column(2).to_numpy().astype(float)
    for i, j in blocks([len(t) for t in texts], 2 << 20):
        yield i, j, *features(texts[i:j], chars[i:j])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def trained(docs: DataFrame, labels: DataFrame, bound: int = 6000) -> Machine:
    """A machine for labels.quality, from at most bound labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = _inputs(docs).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("raw").alias("h"), "raw", "n_chars", "quality")).alias("r")).select("doc_id", "r.raw", "r.n_chars", "r.quality")

    def run(batches):
        for batch in batches:
            for i, j, hashed, bins in _blocks(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(hashed, pa.list_(pa.int32())), pa.array(list(bins), pa.list_(pa.int32())), batch.column(3).slice(i, j - i)], ["doc_id", "hashed", "bins", "quality"])

    found = rows.mapInArrow(run, "doc_id long, hashed array<int>, bins array<int>, quality int").toArrow().sort_by("doc_id")
    hashed, bins = (found.column(n).combine_chunks() for n in ("hashed", "bins"))
    pairs = [rows_of([h.values.to_numpy()], b.values.to_numpy()[None])[:2] for h, b in zip(hashed, bins, strict=True)]
    return fit([p[0].astype(np.int64) for p in pairs], [p[1] for p in pairs], found.column("quality").to_numpy().astype(float))


def scored(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches):
        for batch in batches:
            for i, j, hashed, bins in _blocks(batch):
                score = sigmoid(machine.raw(*rows_of(hashed, bins))[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], ["doc_id", "score"])

    out = _inputs(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The documents, all their columns, that are not rejected."""
    at = [docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None]

    def run(batches):
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(at[0])]
            own = batch.column(at[1]).to_pylist() if at[1] is not None else [None] * len(texts)
            chars = np.array([len(t) if c is None else c for t, c in zip(texts, own, strict=True)], float)
            texts = [t.encode("utf-8", "replace") for t in texts]
            for i, j in blocks([len(t) for t in texts], 2 << 20):
                keep = sigmoid(machine.raw(*rows_of(*features(texts[i:j], chars[i:j])))[0]) >= threshold
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))
