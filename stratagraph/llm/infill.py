"""Fill-in-middle transformation by rotations of blocks in place, and its inverse.

A text is a row of units: blank space with the word after it, and blank space at
the end. Two cuts, drawn from the hash of seed and doc_id, make prefix, middle and
suffix. The marks of the three parts are inserted into one bytearray in the order
of the text; then parts change places by rotations, each made of three reversals
of ranges of that bytearray: middle and suffix for psm, and prefix and suffix too
for spm. `restored` reads the form and the marks' places from an output alone, rotates
back and removes the marks. A row is transformed by itself: nothing is shuffled.

Texts without units, texts that hold a mark, and those that the rate leaves out are
plain and stay as they are; their parts' sizes are null. Null texts are empty. A null
doc_id counts as one without digits. Repeated rows get equal rows. Texts of any length
are cut by arrays of their bytes. Other columns are not read; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.common import table, text_bytes, wider

PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def unit_ends(a: np.ndarray) -> np.ndarray:
    """The ends of the units of a text's bytes: where a word ends, and the end."""
    blank = BLANK[a]
    return np.r_[np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, len(a)] if len(a) else np.zeros(0, np.int64)


def exchange(view: np.ndarray, start: int, cut: int, end: int) -> None:
    """Exchange the neighbouring blocks [start, cut) and [cut, end) in place: each is reversed, then both together."""
    for a, b in ((start, cut), (cut, end), (start, end)):
        view[a:b] = view[a:b][::-1]


def chars(a: np.ndarray) -> int:
    return int(np.count_nonzero((a & 0xC0) != 0x80))


def draws(seed: int, doc_id: int | None) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(raw: bytes, doc_id: int | None, seed: int = 42, rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    a = np.frombuffer(raw, np.uint8)
    ends = unit_ends(a)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not n or h3 % 100 >= rate or any(m in raw for m in MARKS):
        return n, "plain", None, None, raw
    p, m = (int(ends[c - 1]) if c else 0 for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    sizes = chars(a[:p]), chars(a[p:m])
    buf = bytearray(raw)
    for at, mark in ((m, SUFFIX), (p, MIDDLE), (0, PREFIX)):  # from the end, so that places stay
        buf[at:at] = mark
    p, m = p + len(PREFIX), m + len(PREFIX) + len(MIDDLE)
    view = np.frombuffer(buf, np.uint8)
    exchange(view, p, m, len(buf))
    form = "psm"
    if h4 % 100 < spm:
        form = "spm"
        exchange(view, 0, p, p + len(buf) - m)
    return n, form, *sizes, bytes(buf)


def restore(output: bytes, form: str) -> bytes:
    """The text of an output; a mark's first place is its only one, as no mark overlaps another or a text's end."""
    if form == "plain":
        return output
    buf = bytearray(output)
    p, s, m = (buf.index(x) for x in MARKS)
    view = np.frombuffer(buf, np.uint8)
    if form == "spm":
        exchange(view, s, p, m)
        p, s = s, s + m - p
    exchange(view, s, m, len(buf))
    m, s = s, s + len(buf) - m
    del view  # a bytearray that is seen elsewhere keeps its size
    for at, mark in ((s, SUFFIX), (m, MIDDLE), (p, PREFIX)):
        del buf[at : at + len(mark)]
    return bytes(buf)


def infilled(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every text: of 100 texts about rate are transformed, of 100 of these about spm to spm."""

    def run(batches):
        for batch in batches:
            rows, size, at = [], 0, 0
            for i in range(batch.num_rows):
                rows.append(transform(batch.column(1)[i].as_py(), batch.column(0)[i].as_py(), seed, rate, spm))
                size += len(rows[-1][4])
                if size > 8 << 20 or i == batch.num_rows - 1:
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *cols], [c.split()[0] for c in OUT.split(", ")])
                    at, rows, size = i + 1, [], 0

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw")).mapInArrow(run, OUT)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(made: DataFrame) -> DataFrame:
    """made, which has output and form, with the text that they stand for as restored; a column of that name is replaced."""
    names = [c for c in made.columns if c != "restored"]
    def run(batches):
        for batch in batches:
            form, output = (batch.column(names.index(c)) for c in ("form", "output"))
            out, size, at = [], 0, 0
            for i in range(batch.num_rows):
                x = output[i].as_py()
                out.append(None if x is None else restore(x, form[i].as_py()))
                size += len(out[-1] or b"")
                if size > 8 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(out)) for k in range(len(names))), pa.array(out, pa.binary())], [*names, "restored"])
                    at, out, size = i + 1, [], 0

    as_bytes = made.select(*(F.col(c).cast("binary").alias(c) if c == "output" else F.col(c) for c in names))
    back = as_bytes.mapInArrow(run, wider(as_bytes, "restored", "binary"))
    return back.select(*(F.col(c).cast("string").alias(c) if c == "output" else F.col(c) for c in names), F.col("restored").cast("string").alias("restored"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(infilled(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
