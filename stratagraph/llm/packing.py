"""Cost-balanced packing of tokenised documents into sequences.

Each task tokenises its documents and packs them in groups of a fixed number
of tokens, so nothing is shuffled and memory is bounded. In a group, documents
over a sequence's length give full sequences and a rest; the pieces then go, in
descending length, to the sequence of lowest estimated attention cost (linear
plus quadratic in each piece's length) of all of the group's that have room. A piece
that fits in none is cut to fill what room is left, so a group's sequences are full but
for the last tokens, which go to sequences of powers of two: those need no
padding. sequence_id holds the task's partition in its upper bits.

Null and empty texts are one end id each. Rows with equal or null doc_id are
packed as documents of their own.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.bpe import Pairs, binary, gather, merge_words, offsets, parts
from stratagraph.llm.common import table
from stratagraph.llm.sentencepiece_codec import blocks

SPLIT = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\sa-zß-öø-ÿà0-9]+")
# Characters on which Python and the library agree: printable ASCII and the letters of Latin-1.
SAFE = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
BLOCK_BYTES = 3 << 20


class Tokens:
    """Ids of a tokenizer file with lower-cased words that end in a marked symbol. Distinct words of a block are merged once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = Pairs([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], np.arange(len(merges)), [vocab[a + b] for a, b in merges])
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        off, data = parts(words)
        sym = self.inner[data]
        sym[off[1:] - 1] = self.last[data[off[1:] - 1]]
        return merge_words(sym, np.diff(off), self.pairs)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, flat, and counts of distinct words without white space."""
        special = any(s in w for w in words for s in self.special) if any("|>" in w for w in words) else False
        safe = np.array([SAFE.fullmatch(w) is not None for w in words], bool)
        if special:
            safe &= np.array([not any(s in w for s in self.special) for w in words], bool)
        chosen = [w for w, s in zip(words, safe, strict=True) if s]
        coded = pa.array(SPLIT.findall("".join(w + "\n" for w in chosen).lower()), pa.large_string()).dictionary_encode()
        ids, n = self._merged(coded.dictionary.cast(pa.large_binary())) if chosen else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        which = coded.indices.to_numpy()
        line = coded.dictionary.index("\n").as_py()
        end = np.flatnonzero(which == line)  # each word ends in a line feed, which has no ids
        if chosen:
            keep = np.repeat(np.arange(len(n)) != line, n)
            ids, n = ids[keep], np.where(np.arange(len(n)) == line, 0, n)
        flat = gather(ids, n, which)
        n_safe = np.diff(np.r_[0, offsets(n[which])[end]])
        if safe.all():
            return flat, n_safe
        other = [e.ids for e in self.library.encode_batch([w for w, s in zip(words, safe, strict=True) if not s], add_special_tokens=False)]
        lens = np.zeros(len(words), np.int64)
        lens[safe], lens[~safe] = n_safe, [len(x) for x in other]
        out = np.zeros(lens.sum(), np.int64)
        of_safe = np.repeat(safe, lens)
        out[of_safe] = flat
        out[~of_safe] = [i for x in other for i in x]
        return out, lens

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and each text's count; cut at spaces and line feeds, which the tokenizer drops."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        a = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        blank = (a == 0x20) | (a == 0x0A)
        starts = offsets(np.array([len(r) + 1 for r in raw], np.int64))
        edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))  # a word's start, its end, the next word's start ...
        begin, end = edge[::2], edge[1::2]
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        packed = a[~blank]
        words = binary(packed.tobytes(), offsets(end - begin)).dictionary_encode()
        ids, n = self._words(words.dictionary.cast(pa.large_string()).to_pylist())
        which = words.indices.to_numpy()
        return gather(ids, n, which), np.diff(offsets(n[which])[np.searchsorted(begin, starts)])


@lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cost(n: int, linear: float, quadratic: float) -> float:
    return linear * n + quadratic * n * n


def pack(lens: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of one group."""
    pieces: list[tuple[int, int, int, int, int]] = []
    n_seq = 0
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lens):
        full = n // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, n_seq + k, 0))
        n_seq += full
        if n % capacity:
            rest.append((n % capacity, d, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    bins = total // capacity
    room, spent = np.full(bins, capacity), np.zeros(bins)
    used = [0] * bins
    over: list[tuple[int, int, int]] = []
    for n, d, start in rest:
        put = int(np.where(room >= n, spent, np.inf).argmin()) if bins else 0
        if not bins or room[put] < n:
            over.append((n, d, start))
            continue
        pieces.append((d, start, n, n_seq + put, used[put]))
        used[put] += n
        room[put] -= n
        spent[put] += cost(n, linear, quadratic)
    order = [int(b) for b in np.argsort(spent, kind="stable") if room[b]]
    ends: list[int] = []  # capacities of the last sequences
    left = total - bins * capacity
    for bit in reversed(range(capacity.bit_length())):
        if left >> bit & 1:
            ends.append(1 << bit)
    used += [0] * len(ends)
    caps = [capacity] * bins + ends
    order += range(bins, len(caps))
    at = 0
    for n, d, start in over:
        while n:
            while used[order[at]] == caps[order[at]]:
                at += 1
            b = order[at]
            k = min(n, caps[b] - used[b])
            pieces.append((d, start, k, n_seq + b, used[b]))
            used[b] += k
            start, n = start + k, n - k
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, group_tokens: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids adds the ids themselves. group_tokens bounds what a task holds."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches):
        import public_tokenizers

        t = tokens(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        base, held, size = TaskContext.get().partitionId() << 40, [], 0

        def flush():
            nonlocal base, held, size
            doc_ids = [d for d, _ in held]
            lens = [len(x) for _, x in held]
            made = pack(lens, capacity)
            rows = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            ids = []
            for d, start, n, seq, off in sorted(made):
                own = held[d][1][start : start + n]
                for name, value in zip(rows, (doc_ids[d], start, n, zlib.crc32(own.astype("<u4").tobytes()), lens[d], base + seq, off), strict=True):
                    rows[name].append(value)
                if with_ids:
                    ids.append(own.astype(np.int32))
            base += max((m[3] for m in made), default=-1) + 1
            held, size = [], 0
            arrays = [pa.array(v, pa.int64()) for v in rows.values()]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, [*rows] + ["ids"] * with_ids)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [x or "" for x in texts]
            for i, j in blocks([len(x) for x in texts], BLOCK_BYTES):
                flat, n = t.encode(texts[i:j])
                at = offsets(n)
                flat = flat.astype(np.uint32)
                for k in range(j - i):
                    held.append((doc_ids[i + k], np.append(flat[at[k] : at[k + 1]], np.uint32(end_id))))
                    size += int(n[k]) + 1
                    if size >= group_tokens:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
