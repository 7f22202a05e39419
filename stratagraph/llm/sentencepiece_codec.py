"""SentencePiece BPE encoding and decoding in merge rounds over distinct units.

A text is cut where no piece of the model can cross: before a space that
follows another character, and around line feeds. Distinct units of a block of
documents are merged once (see bpe.py), then spread back by index. Characters
without a piece fall back to their UTF-8 bytes. Decoding maps ids to piece
bytes and drops the one dummy space at the front.

Null and empty texts have no ids and decode to the empty text; every row keeps its doc_id, repeated or null ones too.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.bpe import Pairs, binary, gather, merge_words, offsets, parts
from stratagraph.llm.common import table

SPACE = "▁"
UNKNOWN = 1 << 20  # + code point: a character that has no piece of its own
BLOCK_BYTES = 3 << 20


class Codec:
    """Tables of one BPE model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4, 5)}
        self.byte_id = np.zeros(256, np.int64)
        surface: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                b = int(p.piece[3:5], 16)
                self.byte_id[b] = i
                surface.append(bytes([b]))
            else:
                surface.append(b"" if p.type in (2, 3) else p.piece.replace(SPACE, " ").encode())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models with the identity normaliser and a dummy prefix are supported")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("a piece crosses the cuts between units")
        left, right, rank, merged = [], [], [], []
        symbol = lambda s: normal.get(s, UNKNOWN + ord(s) if len(s) == 1 else None)
        by_score = {s: r for r, s in enumerate(sorted({-model.pieces[i].score for i in normal.values()}))}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(by_score[-model.pieces[i].score])
                    merged.append(i)
        self.pairs = Pairs(left, right, rank, merged)
        self.char = np.arange(0x110000, dtype=np.int64) + UNKNOWN
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.char[ord(" ")] = self.char[ord(SPACE)]
        self.surface = binary(b"".join(surface), offsets(np.array([len(s) for s in surface])))
        self.decimal = pa.array([f"{i},".encode() for i in range(len(surface))], pa.large_binary())

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, flat, and their counts."""
        off, data = parts(units)
        char = (data & 0xC0) != 0x80
        sym = self.char[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        ids, n = merge_words(sym, np.diff(np.r_[0, np.cumsum(char)][off]), self.pairs)
        odd = ids >= UNKNOWN
        if odd.any():
            raw = [chr(c).encode() for c in (ids[odd] - UNKNOWN).tolist()]
            width = np.ones(len(ids), np.int64)
            width[odd] = [len(r) for r in raw]
            unit = np.repeat(np.arange(len(n)), n)
            n = np.bincount(unit, weights=width, minlength=len(n)).astype(np.int64)
            spread = np.repeat(odd, width)
            ids = np.repeat(ids, width)
            ids[spread] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, n

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct units' ids and counts, each place's unit, and the places of each text."""
        data = b"".join(b" " + t for t in texts if t)
        starts = offsets(np.array([len(t) + 1 if t else 0 for t in texts]))
        a = np.frombuffer(data, np.uint8)
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        cut_ = np.zeros(len(a) + 1, bool)
        space, line = a == 0x20, a == 0x0A
        cut_[1:-1] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        cut_[starts] = True
        at = np.flatnonzero(cut_)
        coded = binary(data, at).dictionary_encode()
        ids, n = self._units(coded.dictionary)
        return ids, n, coded.indices.to_numpy(), np.searchsorted(at, starts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        ids, n, unit, place = self._block([t.replace(SPACE, " ").encode("utf-8", "replace") for t in texts])
        flat = gather(ids, n, unit)
        doc = offsets(n[unit])[place]
        return [flat[doc[i] : doc[i + 1]] for i in range(len(texts))]

    def decode(self, ids: np.ndarray) -> str:
        _, data = parts(self.surface.take(pa.array(ids)))
        raw = data.tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def digests(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """Count of ids, SHA-256 of the decimal ids and of the decoded text, for each text."""
        ids, n, unit, place = self._block(texts)
        doc = offsets(n[unit])[place]
        made = []
        for of_id in (self.decimal, self.surface):
            off, data = parts(of_id.take(pa.array(ids)))
            spread = binary(data, off[offsets(n)]).take(pa.array(unit))
            off, data = parts(spread)
            made.append((off[place], memoryview(data.tobytes())))
        (dec_at, dec), (out_at, out) = made
        rows = []
        for i in range(len(texts)):
            a, b = int(out_at[i]), int(out_at[i + 1])
            a += a < b and out[a] == 0x20
            rows.append((int(doc[i + 1] - doc[i]), hashlib.sha256(dec[int(dec_at[i]) : max(int(dec_at[i]), int(dec_at[i + 1]) - 1)]).hexdigest(), hashlib.sha256(out[a:b]).hexdigest()))
        return rows


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def blocks(lens: list[int], limit: int):
    """Ranges of rows with about limit bytes each."""
    start = total = 0
    for i, n in enumerate(lens):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lens):
        yield start, len(lens)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def sentencepiece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; model is a file on each executor, by default the public one there."""

    def run(batches):
        import public_tokenizers

        c = codec(model or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            texts = [(t or "").replace(SPACE, " ").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for i, j in blocks([len(t) for t in texts], BLOCK_BYTES):
                n, a, b = zip(*c.digests(texts[i:j]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(table(spark, sf_dir, "documents"))
