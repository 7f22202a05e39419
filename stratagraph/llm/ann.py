"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by `hashes` Gaussian projections, shifted and cut into
cells of one width; the width is fitted on whole vectors of a bounded sample, to the
distance that the k-th neighbour has in all of them, so it holds for any number of
components. Every distinct vector is indexed in every
table. A query visits, in each table, its own bucket and then buckets whose
cells are perturbed by one step, in the order of estimated success: the sum of
squared distances to the borders crossed, smallest first. The sets of steps tried
come from one list made for expected distances, twice as long as the probes, of
which each query takes the best by its own distances.

Buckets are dealt to units, a share of a table's buckets each; a query is sent to
the units that hold a bucket it visits, with those buckets, and meets nothing else
there. Units over a size, as of a frequent bucket, are cut into parts, so memory is
bounded; candidates never become rows. The candidates of all units are merged and
ranked by exact Euclidean distance in double precision.

Equal vectors are searched once: each keeps its smallest k + 1 ids, which is
all that ranks up to k can need. A query with fewer than k candidates is
searched again in all units of one table.

Vectors that are null, zero, of another length than most of the sample, or that
hold null or non-finite components take no part, nor do rows with a null
vec_id. Repeated rows of a vec_id count once for each distinct vector. Fewer
candidates than k give fewer rows; an empty table gives none. Other columns are
not read.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.llm.common import cut, release, table

TABLES, HASHES, PROBES, WIDTH = 12, 10, 300, 1.8
SAMPLE, UNIT, QUERY_BLOCK, CHUNK = 2048, 8192, 512, 256


def bucket_ids(cells: np.ndarray) -> np.ndarray:
    """One number a bucket from its cells on the last axis."""
    out = np.zeros(cells.shape[:-1], np.int64)
    for k in range(cells.shape[-1]):
        out = out * np.int64(1000003) + cells[..., k]
    return out


@lru_cache(8)
def step_sets(hashes: int, n: int) -> np.ndarray:
    """(n, 2 * hashes) with a 1 for each step of a set, steps in order of their distance, sets by their expected score; the first is empty."""
    j = np.arange(1, hashes + 1)
    near = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    far = 1 - (hashes + 1 - j) / (hashes + 1) + (hashes + 1 - j) * (hashes + 2 - j) / (4 * (hashes + 1) * (hashes + 2))
    expected = np.r_[near, far].tolist()
    last = 2 * hashes - 1
    sets: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))]
    while heap and len(sets) < n:
        score, chosen = heapq.heappop(heap)
        if not any(last - k in chosen for k in chosen):  # not both borders of one cell
            sets.append(chosen)
        end = chosen[-1]
        if end < last:
            heapq.heappush(heap, (score + expected[end + 1], (*chosen, end + 1)))
            heapq.heappush(heap, (score - expected[end] + expected[end + 1], (*chosen[:-1], end + 1)))
    out = np.zeros((len(sets), 2 * hashes))
    for i, chosen in enumerate(sets):
        out[i, list(chosen)] = 1
    return out


class Hashing:
    def __init__(self, dim: int, width: float, tables: int = TABLES, hashes: int = HASHES, seed: int = 11):
        r = np.random.default_rng(seed)
        self.width, self.tables, self.hashes = width, tables, hashes
        self.a = r.normal(size=(dim, tables * hashes))
        self.b = r.uniform(0, width, tables * hashes)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Cell coordinates with their fractions, (rows, tables, hashes)."""
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return bucket_ids(np.floor(self.places(x)).astype(np.int64))

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """Buckets that a query visits in each table, (tables, probes), likeliest first."""
        place = self.places(q[None])[0]
        cell = np.floor(place)
        distance = np.concatenate([(place - cell) ** 2, (1 - place + cell) ** 2], axis=1)
        order = np.argsort(distance, axis=1, kind="stable")
        sets = step_sets(self.hashes, 2 * n)
        score = np.take_along_axis(distance, order, 1) @ sets.T
        best = np.argsort(score, axis=1, kind="stable")[:, :n]
        step = np.zeros((self.tables, 2 * self.hashes, self.hashes), np.int64)
        t, k = np.indices(order.shape)
        step[t, k, order % self.hashes] = np.where(order < self.hashes, -1, 1)
        return bucket_ids(cell[:, None].astype(np.int64) + sets[best].astype(np.int64) @ step)


def unit_of(buckets: np.ndarray, units: int) -> np.ndarray:
    x = buckets.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(units)).astype(np.int32)


def nearest(ids: np.ndarray, vectors: np.ndarray, buckets: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, probes: list, k: int):
    """(query, vector, distance) of each query's k + 1 nearest among the vectors in the buckets it visits, ties to smaller ids; among all where probes are None."""
    order = np.argsort(buckets, kind="stable")
    known = buckets[order]
    for q in range(len(queries)):
        at = order
        if probes[q] is not None:
            low, high = (np.searchsorted(known, probes[q], side) for side in ("left", "right"))
            n = high - low
            ends = np.cumsum(n)
            at = order[np.arange(ends[-1]) + np.repeat(high - ends, n)] if len(n) else order[:0]
        d = np.sqrt(((vectors[at] - queries[q]) ** 2).sum(axis=1))
        if len(d) > k + 1:
            near = np.flatnonzero(d <= np.partition(d, k)[k])
            at, d = at[near], d[near]
        for i in np.lexsort((ids[at], d))[: k + 1]:
            yield int(query_ids[q]), int(ids[at[i]]), float(d[i])


def nearest_scale(x: np.ndarray, rank: int = 1, asked: int = 256) -> float:
    """The median distance of the first vectors to the rank-th nearest unequal one in x, all components; 1 if there is none. One vector at a time, so memory is bounded."""
    least = []
    for q in x[:asked]:
        d = x - q
        d = np.einsum("ij,ij->i", d, d)
        d = d[d > 0]
        if len(d):
            r = min(rank, len(d)) - 1
            least.append(np.sqrt(np.partition(d, r)[r]))
    least = np.array(least)[np.isfinite(least)]
    return float(np.median(least)) if len(least) else 1.0


def _stored(df: DataFrame) -> str:
    """The type vectors are dealt in: single precision where they are given so; distances are in double precision."""
    return "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"


def _valid(df: DataFrame) -> DataFrame:
    d = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast(_stored(df)).alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.where(finite & F.exists("v", lambda x: x != 0))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = _valid(vectors)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(sample):
        return empty
    dim = int(sample.v.map(len).mode()[0])
    x = np.stack([v for v in sample.v if len(v) == dim]).astype(np.float64)
    kind = _stored(vectors)

    valid = valid.where(F.size("v") == dim).dropDuplicates(["vec_id", "v"])
    key = valid.withColumn("h", F.xxhash64("v"))
    ranked = key.withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = cut(ranked.select("vec_id", "v", "n", "h"), "vectors")
    heads = classes.where("n = 1").select(F.col("vec_id").alias("head"), "v", "h")
    queries = cut(valid.where(F.col("vec_id") % every == 0), "queries")
    n_heads = heads.count()
    units = max(1, -(-n_heads // UNIT))
    hashing = Hashing(dim, WIDTH * nearest_scale(x, max(1, -(-k * len(x) // n_heads))))

    def index(batches):
        for batch in batches:
            b = hashing.buckets(matrix(batch.column(1), dim))
            first = pa.array(np.arange(len(b) + 1, dtype=np.int32) * b.shape[1])
            lists = [pa.ListArray.from_arrays(first, pa.array(x.ravel())) for x in (unit_of(b, units), b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["head", "v", "units", "buckets"])

    indexed = cut(heads.select("head", "v").mapInArrow(index, f"head long, v {kind}, units array<int>, buckets array<long>"), "index")
    sizes = indexed.select(F.posexplode("units").alias("t", "unit")).groupBy("t", "unit").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("parts"))
    sizes = cut(sizes, "units")
    placed = indexed.select("head", "v", F.posexplode(F.arrays_zip("units", "buckets")).alias("t", "at")).select("head", "v", "t", F.col("at.units").alias("unit"), F.col("at.buckets").alias("bucket"))
    placed = placed.join(sizes.hint("merge"), ["t", "unit"]).withColumn("part", F.pmod(F.xxhash64("head"), F.col("parts")).cast("int"))
    stored = cut(placed.groupBy("t", "unit", "part").agg(F.collect_list(F.struct("head", "bucket", "v")).alias("stored")), "stored")

    def ask(hashed: bool):
        def run(batches):
            for batch in batches:
                q = matrix(batch.column(1), dim)
                for i in range(0, len(q), CHUNK):
                    rows = []
                    for r in range(i, min(i + CHUNK, len(q))):
                        if not hashed:
                            rows += [(r, 0, u, None) for u in range(units)]
                            continue
                        for t, b in enumerate(hashing.probes(q[r], PROBES)):
                            of = unit_of(b, units)
                            rows += [(r, t, int(u), b[of == u]) for u in np.unique(of)]
                    which, t, u, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(u, pa.int32()), *(batch.column(c).take(pa.array(which)) for c in (0, 1)), pa.array(b, pa.list_(pa.int64()))], ["t", "unit", "vec_id", "v", "probes"])

        return run

    def search(asked: DataFrame, hashed: bool) -> DataFrame:
        n = max(1, -(-asked.count() // QUERY_BLOCK))
        rows = asked.select("vec_id", "v").mapInArrow(ask(hashed), f"t int, unit int, vec_id long, v {kind}, probes array<long>")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).groupBy("t", "unit", "block").agg(F.collect_list(F.struct("vec_id", "v", "probes")).alias("asked"))
        met = rows.join(stored.hint("merge"), ["t", "unit"]).select("stored", "asked")

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    own, ask_ = (batch.column(c).slice(r, 1).flatten() for c in (0, 1))
                    probes = [None if not p.is_valid else p.values.to_numpy() for p in ask_.field("probes")]
                    found = list(nearest(own.field("head").to_numpy(), matrix(own.field("v"), dim), own.field("bucket").to_numpy(), ask_.field("vec_id").to_numpy(), matrix(ask_.field("v"), dim), probes, k))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "head", "score"])

        best = met.mapInArrow(run, "query_id long, head long, score double").distinct()
        order = Window.partitionBy("query_id").orderBy("score", "head")
        best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
        mine = classes.select("vec_id", "h", "v").join(heads.hint("merge"), ["h", "v"]).select("head", "vec_id")
        rows = best.join(mine.hint("merge"), "head").where("vec_id <> query_id")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return rows.select("query_id", "rank", "vec_id", "score")

    found = cut(search(queries, True), "found")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    few = cut(queries.join(full, queries.vec_id == full.query_id, "left_anti"), "few")
    again = cut(search(few, False), "again") if not few.isEmpty() else None
    release(classes, queries, indexed, sizes, stored, few)
    return found if again is None else found.join(full, "query_id", "left_semi").unionByName(again)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
