"""Hard negatives by exact search with length buckets and feasible ranges of coordinates.

Vectors are scaled to whole numbers; a score is their inner product. An anchor's
positives are its best rows of the same label; for each positive, the negatives are the
best rows of other labels whose score lies in a band below the positive's.

1. Index. A vector's bucket is its length, rounded on a scale of steps of 10 %; buckets
   are cut into blocks by hash, so memory is bounded and no block is large, whatever
   its length or label. A block holds its rows in order of label and id, and for each coordinate
   the list of its rows in order of that coordinate's share of their length.
2. A bounded sample gives each anchor a first threshold: the score of the k-th best row
   there, which the k-th best of all cannot be below. The sample changes what is
   compared, never what is found.
3. Search. Anchors, the stated query set, go to blocks in blocks of their own; blocks are
   numbered from the longest bucket, and anchors are not sent past the last bucket that
   could reach the least of their thresholds. In a block the threshold divided by both lengths
   is the least cosine. For the anchor's largest coordinates, its focus, it leaves a range
   of feasible values; the rows in the ranges of all focus coordinates are the candidates, and
   are verified by their exact inner products. Where the ranges leave most rows, all are
   verified at once, as a product of matrices.
4. The best of all blocks are merged, first for positives, then for the negatives of all
   of an anchor's positives together.

Products are exact: in double precision while no sum can reach 2^53, else with Python's
numbers; scores beyond 64 bits count as the nearest number of 64 bits. Rows with a null id, label or vector, or any
null or non-finite component take no part. A shorter vector counts as ending in zeros; zero vectors take part.
Equal rows count once; rows that repeat an id with another label or vector are rows and
anchors of their own, and none of them is another row to the others. An anchor without
positives, or a positive without negatives, gives no row. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.llm.common import cut, release, table, wider

BLOCK, ASKED, SAMPLE, FOCUS = 8192, 256, 2048, 4
STEP = math.log(1.1)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
EXACT = 1 << 53


def whole(vectors: list) -> np.ndarray:
    """Rows of whole numbers, floor(256 x), as doubles, which hold them exactly; shorter rows end in zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return np.floor(np.clip(out * 256, -1e300, 1e300))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(rows of x, rows of q) inner products, exact."""
    n = min(x.shape[1], q.shape[1])
    x, q = x[:, :n], q[:, :n]
    if n * np.abs(x).max(initial=0) * np.abs(q).max(initial=0) < EXACT:
        return (x @ q.T).astype(np.int64)
    exact = np.array([[int(a) for a in row] for row in x], object).reshape(x.shape) @ np.array([[int(a) for a in row] for row in q], object).reshape(q.shape).T
    return np.clip(exact, LOW, HIGH).astype(np.int64) if n else np.zeros((len(x), len(q)), np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0)
    scale = np.where(most > 0, most, 1)
    return np.sqrt(((x / scale[:, None]) ** 2).sum(axis=1)) * scale


class Block:
    """Rows (ids, labels, vectors) in order of label and id, with lists of rows by coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.labels, self.x = ids, labels, x
        self.length = lengths(x)
        self.least, self.most = float(self.length.min(initial=np.inf)), float(self.length.max(initial=0))
        self.share = x / np.where(self.length > 0, self.length, 1)[:, None]
        self.order = np.argsort(self.share, axis=0, kind="stable").astype(np.int32) if order is None else order

    @classmethod
    def of(cls, rows: list[dict]) -> Block:
        x = whole([r["v"] for r in rows])
        ids, labels = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "label"))
        at = np.lexsort((*x.T, ids, labels))
        same = np.zeros(len(at), bool)
        same[1:] = (ids[at[1:]] == ids[at[:-1]]) & (labels[at[1:]] == labels[at[:-1]]) & (x[at[1:]] == x[at[:-1]]).all(axis=1)
        at = at[~same]
        return cls(ids[at], labels[at], x[at])

    def feasible(self, q: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Rows whose focus coordinates allow a score of least; None where that may be most of them."""
        if not len(self.ids) or not np.isfinite(least):
            return None
        reach = length * (self.most if least > 0 else self.least)
        if reach == 0:
            return None if least <= 0 else np.zeros(0, np.int64)
        cosine = least / reach - 1e-9
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return None
        spread = math.acos(cosine)
        share = q / length
        ranges = []
        for f in np.argsort(-np.abs(share), kind="stable")[:FOCUS]:
            if f < self.x.shape[1]:
                angle = math.acos(max(-1.0, min(1.0, share[f])))
                low, high = math.cos(min(math.pi, angle + spread)) - 1e-9, math.cos(max(0.0, angle - spread)) + 1e-9
                column = self.share[:, f]
                a, b = np.searchsorted(column, [low, high], sorter=self.order[:, f])
                ranges.append((b - a, a, b, f, low, high))
        if not ranges or min(ranges)[0] > len(self.ids) // 4:
            return None
        _, a, b, f, _, _ = min(ranges)
        rows = np.sort(self.order[a:b, f])
        for _, _, _, f, low, high in ranges:
            rows = rows[(self.share[rows, f] >= low) & (self.share[rows, f] <= high)]
        return rows

    def scored(self, q: np.ndarray, length: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, scores) for each anchor, rows that can reach least among them."""
        every = []
        for a in range(len(q)):
            rows = self.feasible(q[a], float(length[a]), float(least[a]))
            if rows is None:
                every.append(a)
            elif len(rows):
                yield a, rows, products(self.x[rows], q[a : a + 1])[:, 0]
        for i in range(0, len(every), 64):
            part = every[i : i + 64]
            s = np.ascontiguousarray(products(self.x, q[part]).T)
            for a, row in zip(part, s, strict=True):
                at = np.flatnonzero(row >= least[a])
                yield a, at, row[at]


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(score) > 8 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((ids[near], -score[near].astype(object) if (score[near] == LOW).any() else -score[near]))[:k]]
    return np.lexsort((ids, -score.astype(object) if (score == LOW).any() else -score))[:k]


def band(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and largest score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def positives_of(block: Block, asked: list[dict], q: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple]:
    """(anchor's key, row's id, score) of the k best rows of each anchor's label."""
    for a, rows, score in block.scored(q, lengths(q), least):
        mine = (block.labels[rows] == asked[a]["label"]) & (block.ids[rows] != asked[a]["vec_id"])
        rows, score = rows[mine], score[mine]
        for i in best(score, block.ids[rows], k):
            yield asked[a]["key"], int(block.ids[rows[i]]), int(score[i])


def negatives_of(block: Block, asked: list[dict], q: np.ndarray, k: int, low: int, high: int, bounds: list[list[int]] | None = None) -> Iterator[tuple]:
    """(anchor's key, the positive's place, row's id, score) of the k best rows of other labels in each positive's band; bounds are least scores that are known."""
    bands = [[band(p["score"], low, high) for p in d["positives"]] for d in asked]
    floors = [[max(b[0], m) for b, m in zip(x, bounds[i] if bounds else [LOW] * len(x), strict=True)] for i, x in enumerate(bands)]
    least = np.array([max(LOW, min(x)) for x in floors], object).astype(np.float64)
    for a, rows, score in block.scored(q, lengths(q), np.nextafter(least, -np.inf)):
        other = block.labels[rows] != asked[a]["label"]
        rows, score = rows[other], score[other]
        for j, ((_, top), floor) in enumerate(zip(bands[a], floors[a], strict=True)):
            if floor <= top:
                at = np.flatnonzero((score >= max(floor, LOW)) & (score <= min(top, HIGH)))
                for i in at[best(score[at], block.ids[rows[at]], k)]:
                    yield asked[a]["key"], j, int(block.ids[rows[i]]), int(score[i])


def kth(found: Iterator[tuple], k: int) -> dict:
    """The k-th best score by what stands before id and score, where there are so many."""
    by: dict[tuple, list[int]] = {}
    for *key, _, score in found:
        by.setdefault(tuple(key), []).append(score)
    return {key: scores[k - 1] for key, scores in by.items() if len(scores) >= k}


def usable(vectors: DataFrame, moved: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, labels as moved says."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    d = d.where("vec_id is not null and label is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return d if moved is None else d.withColumn("label", moved(F.col("vec_id"), F.col("label")))


def bucket() -> Column:
    """The step of a vector's length; lengths beyond double precision share the last."""
    square = F.least(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(F.least(F.greatest(x, F.lit(-1e15)), F.lit(1e15)) * 256).cast("double") * F.floor(F.least(F.greatest(x, F.lit(-1e15)), F.lit(1e15)) * 256).cast("double")), F.lit(1e300))
    return F.when(square < 1, -1).otherwise(F.floor(F.log(square) / 2 / STEP)).cast("int")


def indexed(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, float]]]:
    """The written blocks, numbered from the longest bucket, and for each bucket its end among the blocks and the length that none of its rows exceeds. There are at most about 3700 buckets, whatever the rows."""
    spark = rows.sparkSession
    r = rows.withColumn("bucket", bucket())
    sizes = sorted(((x["bucket"], x["n"]) for x in r.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    made, ends, first = [], [], 0
    for b, n in sizes:
        parts = -(-n // BLOCK)
        made.append((b, first, parts))
        first += parts
        ends.append((first, math.exp((b + 1) * STEP) * (1 + 1e-9) if b < 3000 else math.inf))
    numbers = F.broadcast(spark.createDataFrame(made, "bucket int, first int, parts int"))
    r = r.join(numbers, "bucket").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    grouped = r.groupBy("block").agg(F.collect_list(F.struct("vec_id", "label", "v")).alias("rows"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                b = Block.of(batch.column(1)[k].as_py())
                small = b.x.astype(np.int32)
                x = small if (small == b.x).all() else b.x
                cols = [pa.array([batch.column(0)[k].as_py()], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in (b.ids, b.labels, x, b.order)), pa.array([x.dtype.str])]
                yield pa.RecordBatch.from_arrays(cols, ["block", "ids", "labels", "x", "by_coordinate", "kind"])

    return cut(grouped.mapInArrow(run, "block int, ids binary, labels binary, x binary, by_coordinate binary, kind string"), "length-buckets"), ends


def _stored(row: dict) -> Block:
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
    shape = len(ids), -1
    x = np.frombuffer(row["x"], row["kind"])
    x = x.reshape(shape) if len(x) else np.zeros((len(ids), 0))
    return Block(ids, labels, x.astype(np.float64), np.frombuffer(row["by_coordinate"], np.int32).reshape(x.shape))


def searched(blocks: DataFrame, ends: list[tuple[int, float]], asked: DataFrame, least: Callable[[dict], float], find: Callable, schema: str) -> DataFrame:
    """What find yields for blocks of anchors met with blocks of rows. asked: one struct column anchor; least: the lowest score that an anchor can still use."""
    n = max(1, -(-asked.count() // ASKED))

    def reach(batches):
        for batch in batches:
            rows = batch.column(0).to_pylist()
            last = []
            for r in rows:
                length, low = float(lengths(whole([r["v"]]))[0]), least(r)
                end = ends[-1][0]
                if low > 0:
                    end = max((e for e, most in ends if length * most >= low), default=0)
                last.append(end)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(last, pa.int32())], ["anchor", "end"])

    sent = asked.mapInArrow(reach, wider(asked, "end", "int"))
    sent = sent.withColumn("part", F.pmod(F.xxhash64("anchor.key"), F.lit(n)).cast("int")).groupBy("part").agg(F.collect_list("anchor").alias("anchors"), F.max("end").alias("end")).where("end > 0")
    sent = cut(sent, "anchors")
    met = sent.select("anchors", F.explode(F.sequence(F.lit(0), F.col("end") - 1)).alias("block")).join(blocks.hint("merge"), "block").select("anchors", "ids", "labels", "x", "by_coordinate", "kind")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("ids", "labels", "x", "by_coordinate", "kind", "anchors")}
                found = list(find(_stored(row), row["anchors"], whole([a["v"] for a in row["anchors"]])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return met.mapInArrow(run, schema)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, moved: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each row whose vec_id is divisible by every and each of its best positives, the best negatives with a score from low to high hundredths of the positive's."""
    spark = vectors.sparkSession
    rows = usable(vectors, moved)
    sample = [r.asDict() for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    known = Block.of(sample)
    blocks, ends = indexed(rows)
    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "v"]).withColumn("key", F.xxhash64("vec_id", "label", "v"))

    def bounded(batches):
        for batch in batches:
            d = batch.column(0).to_pylist()
            found = kth(positives_of(known, d, whole([a["v"] for a in d]), positives, np.full(len(d), -np.inf)), positives) if d else {}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([found.get((a["key"],)) for a in d], pa.int64())], ["anchor", "least"])

    one = anchors.select(F.struct("key", "vec_id", "label", "v").alias("anchor"))
    asked = cut(one.mapInArrow(bounded, wider(one, "least", "long")).select(F.struct("anchor.*", "least").alias("anchor")), "asked")
    floor = lambda a: -math.inf if a["least"] is None else float(np.nextafter(float(a["least"]), -np.inf))

    def find_positives(block: Block, d: list[dict], q: np.ndarray) -> Iterator[tuple]:
        return positives_of(block, d, q, positives, np.array([floor(a) for a in d]))

    found = searched(blocks, ends, asked, floor, find_positives, "key long, id long, score long").distinct()
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    sets = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("positives"))
    paired = asked.select("anchor.*").drop("least").join(sets.hint("merge"), "key").select(F.struct("key", "vec_id", "label", "v", "positives").alias("anchor"))

    def bounded_bands(batches):
        for batch in batches:
            d = batch.column(0).to_pylist()
            at = kth(negatives_of(known, d, whole([a["v"] for a in d]), negatives, low, high), negatives) if d else {}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[at.get((a["key"], j), LOW) for j in range(len(a["positives"]))] for a in d], pa.list_(pa.int64()))], ["anchor", "bounds"])

    pairs = cut(paired.mapInArrow(bounded_bands, wider(paired, "bounds", "array<long>")).select(F.struct("anchor.*", "bounds").alias("anchor")), "pairs")

    def lowest(a: dict) -> float:
        floors = [max(band(p["score"], low, high)[0], m) for p, m in zip(a["positives"], a["bounds"], strict=True)]
        return float(np.nextafter(float(max(LOW, min(floors))), -np.inf))

    def find_negatives(block: Block, d: list[dict], q: np.ndarray) -> Iterator[tuple]:
        return negatives_of(block, d, q, negatives, low, high, [a["bounds"] for a in d])

    hard = searched(blocks, ends, pairs, lowest, find_negatives, "key long, place int, id long, score long").distinct()
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    of = pairs.select("anchor.key", F.col("anchor.vec_id").alias("anchor_id"), F.posexplode("anchor.positives").alias("place", "p"))
    out = hard.join(of.hint("merge"), ["key", "place"]).select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
    out = cut(out, "hard-negatives")
    release(blocks, asked, pairs)
    return out


OP13_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.anchor_label AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), moved=moved)
