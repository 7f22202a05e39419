"""Near-duplicate groups by MinHash bands with sequential Bayesian verification.

1. A document's set is its distinct word shingles, hashed to 64 bits. Documents
   of equal sets form a class, a node of the graph named by the set's hash; only
   a class's smallest row goes on, so exact copies cost nothing more.
2. Bands of the signature give buckets. With 40 bands of 5 a pair at similarity
   0.8 shares no bucket with probability 1.2e-7. Nodes of buckets with several
   nodes are open: their texts are fetched once.
3. Candidates of a bucket are compared with one member first, its hub, and
   verified links are joined to components. Hubs are the first by one of a few
   orders, so members of a large group meet several hubs. Where a bucket then still holds
   several components, its members outside the most frequent one are compared
   with all of it, share against share, by signatures alone; a pair is compared
   in the first band whose bucket it shares, so once. What survives is kept as lists
   by the shares of texts that hold the two, and verified where these texts meet:
   no pair becomes a row, and no candidate is left out.
4. Verification reads signatures batch by batch and drops a pair as soon as the
   posterior probability (uniform prior) that its similarity reaches the
   threshold is below `miss`. Survivors are confirmed on their full sets.
5. Components come from rounds of pointers, each cut to the shared folder: pointers
   double, and a union-find joins the edges within a block. The links of step 3's second
   half lead from component to component, so their rounds run on labels only.

Joins are merge joins at every size: no side has a proven bound. Aggregates that
meet a frequent key in a join are written first, so that the join can be split.

Null and empty texts and those without words have an empty set and are linked
with nothing. Texts with fewer words than a shingle count as one shingle. Rows
with a null doc_id are not linked and get a null component_id. Rows are ordered by
doc_id and the hash of their text: rows that repeat a doc_id with other texts are
linked by their own texts only, and `first` marks the smallest row of a component
and its equals, where `kept` marks all rows of the smallest doc_id.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.bpe import binary, offsets
from stratagraph.llm.common import cut, release, table, text_bytes
from stratagraph.llm.sentencepiece_codec import blocks

BANDS, ROWS, BATCH = 40, 5, 40
ORDERS = 4  # orders by which buckets choose their hub
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@lru_cache(1)
def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240607)
    return r.integers(1, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * ODD[1]
    h = (h ^ (h >> np.uint64(27))) * ODD[2]
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    data = np.frombuffer(b" ".join(texts).translate(LOWER) + b" ", np.uint8)
    starts = offsets(np.array([len(t) + 1 for t in texts]))
    blank = (data == 0x20) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return [np.zeros(0, np.uint64)] * len(texts)
    coded = binary(data[~blank].tobytes(), offsets(end - begin)).dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w.as_buffer()) for w in coded.dictionary], np.uint64)[coded.indices.to_numpy()]
    first = np.searchsorted(begin, starts)
    h = own.copy()
    for k in range(1, words):
        h[: len(h) - k] = mixed(h[: len(h) - k] * ODD[0]) + own[k:]
    h = mixed(h)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(h[a : b - words + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(own[a:b].tobytes(), seed=b - a)], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    a, b = hash_functions()
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(out, (x[i : i + 512, None] * a + b).min(axis=0), out=out)
    return out


@lru_cache(16)
def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches that keep a pair) after each batch; the low byte of each minimum is compared, so unequal minima match once in 256; the top byte is 0 for long texts, as a minimum of n hashes is near 2^32 / n."""
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, -1
        while True:  # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
            total += comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m + 1))
    return out


SKETCH = "doc_id long, text_key long, n_shingles long, key1 long, key2 long, sig binary, bands array<long>"


def text_key() -> Column:
    """The hash that tells rows of one doc_id apart; null counts as empty."""
    return F.xxhash64(text_bytes()).alias("text_key")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            for i, j in blocks([len(t) for t in texts], 2 << 20):
                cols: list[list] = [[], [], [], [], []]
                for s in shingle_sets(texts[i:j], words):
                    raw = s.tobytes()
                    sig = signature(s)
                    bands = np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(sig.reshape(BANDS, ROWS))], np.uint64).view(np.int64) if len(s) else np.zeros(0, np.int64)
                    for c, v in zip(cols, (len(s), xxhash.xxh3_64_intdigest(raw) - (1 << 63), xxhash.xxh3_64_intdigest(raw, seed=1) - (1 << 63), (sig & 255).astype(np.uint8).tobytes(), bands), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True))], [x.split()[0] for x in SKETCH.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("raw"), text_key()).mapInArrow(run, SKETCH)


def bayes_pruned(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) of nodes that survive all signature batches."""
    bounds = least_matches(threshold, miss)
    side = lambda end: sigs.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}")).hint("merge")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(n, -1) for c in (batch.column(2), batch.column(3)))
            left, matches = np.arange(n), np.zeros(n, np.int64)
            for size, least in bounds:
                matches[left] += (x[left, size - BATCH : size] == y[left, size - BATCH : size]).sum(axis=1)
                left = left[matches[left] >= least]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(left)), batch.column(1).take(pa.array(left))], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def open_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, sig, bands and packed, the compressed text, of nodes (node, rep, sig, bands). Texts are compressed before they are dealt, once for each doc_id and text."""
    import zstandard

    def compress(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(x.as_py()) for x in batch.column(2)], pa.binary())], ["doc_id", "text_key", "packed"])

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), text_bytes().alias("raw")).where("doc_id is not null").mapInArrow(compress, "doc_id long, text_key long, packed binary")
    packed = packed.groupBy("doc_id", "text_key").agg(F.first("packed").alias("packed"))
    return nodes.select("node", "sig", "bands", "rep.doc_id", "rep.text_key").hint("merge").join(packed, ["doc_id", "text_key"]).select("node", "sig", "bands", "packed")


def _sets(packed: list[bytes], words: int) -> list[np.ndarray]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    texts = [z.decompress(x) for x in packed]
    return [s for i, j in blocks([len(t) for t in texts], 2 << 20) for s in shingle_sets(texts[i:j], words)]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Stars (u, v) of the pairs of nodes whose full sets have 100 * intersection >= percent * union; texts are (node, packed)."""
    side = lambda end: texts.select(F.col("node").alias(end), F.col("packed").alias(f"text_{end}")).hint("merge")

    def run(batches):
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            for i, j in blocks([len(p) + len(q) for p, q in zip(x, y, strict=True)], 1 << 20):
                sets = _sets(x[i:j] + y[i:j], words)
                keep = pa.array([similar(sets[k], sets[j - i + k], percent) for k in range(j - i)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i).filter(keep) for k in (0, 1)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: in_stars(run(batches)), STARS)


SHARE, TEXTS = 768, 512  # nodes in a share of a bucket, and in a share of the texts


class Members:
    """Nodes of a bucket as arrays, from an Arrow list of structs; earlier holds their buckets of the bands before this one."""

    def __init__(self, rows: pa.StructArray):
        get = lambda c: rows.field(c).to_numpy(zero_copy_only=False)
        self.node, self.label, self.out = get("node"), get("label"), get("out")
        self.sig = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint8).reshape(len(rows), -1)
        self.earlier = rows.field("earlier").flatten().to_numpy().reshape(len(rows), -1)


def first_met(x: Members, y: Members) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that are compared in this bucket: their labels differ and they share no bucket of an earlier band; of two outside members once."""
    found: list[list[np.ndarray]] = [[], []]
    for r in range(0, len(x.node), 256):
        rows = slice(r, r + 256)
        new = (x.label[rows, None] != y.label) & (~y.out | (x.node[rows, None] < y.node))
        for k in range(x.earlier.shape[1]):
            new &= x.earlier[rows, k, None] != y.earlier[:, k]
        i, j = np.nonzero(new)
        found[0].append(i + r)
        found[1].append(j)
    return np.concatenate(found[0]), np.concatenate(found[1])


def survivors(x: Members, y: Members, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that are first met here and survive all signature batches."""
    out: list[list[np.ndarray]] = [[], []]
    every = first_met(x, y)
    for at in range(0, len(every[0]), 1 << 16):
        i, j = (e[at : at + (1 << 16)] for e in every)
        matches = np.zeros(len(i), np.int64)
        for size, least in bounds:
            matches += (x.sig[i, size - BATCH : size] == y.sig[j, size - BATCH : size]).sum(axis=1)
            keep = matches >= least
            i, j, matches = i[keep], j[keep], matches[keep]
        out[0].append(i)
        out[1].append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out[0]]), np.concatenate([none, *out[1]])


def similar_pairs(of_x: list[np.ndarray], of_y: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (i, j) of sets have 100 * intersection >= percent * union."""
    if len(i) * 8 < len(of_x) * len(of_y):
        return np.array([similar(of_x[a], of_y[b], percent) for a, b in zip(i, j, strict=True)], bool)
    every = np.unique(np.concatenate([*of_x, *of_y]))  # many pairs: shared shingles of all at once, as a product of incidence matrices over a part of the shingles at a time
    both = np.zeros((len(of_x), len(of_y)), np.int64)
    for k in range(0, len(every), 4096):
        part = every[k : k + 4096]
        m = [np.zeros((len(z), len(part)), np.float32) for z in (of_x, of_y)]
        for rows, sets in zip(m, (of_x, of_y), strict=True):
            for r, s in zip(rows, sets, strict=True):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                r[np.searchsorted(part, s)] = 1
        both += (m[0] @ m[1].T).astype(np.int64)
    union = np.array([len(s) for s in of_x])[:, None] + np.array([len(s) for s in of_y]) - both
    return ((both > 0) & (100 * both >= percent * union))[i, j]


def verified(nodes: np.ndarray, packed: list[bytes], a: np.ndarray, b: np.ndarray, words: int, percent: int, size: int = 128) -> np.ndarray:
    """Which of the pairs of nodes (a, b) are similar by their texts; sets of size nodes at a time on either side."""
    order = np.argsort(nodes)
    at = [order[np.searchsorted(nodes[order], z)] for z in (a, b)]
    tile = (at[0] // size) * (len(nodes) // size + 1) + at[1] // size
    good = np.zeros(len(a), bool)
    by = np.argsort(tile, kind="stable")
    for pairs in np.split(by, np.flatnonzero(np.diff(tile[by])) + 1):
        if len(pairs):
            (ux, i), (uy, j) = (np.unique(z[pairs], return_inverse=True) for z in at)
            good[pairs] = similar_pairs(_sets([packed[k] for k in ux], words), _sets([packed[k] for k in uy], words), i, j, percent)
    return good


FOUND = "share_a int, share_b int, a array<long>, b array<long>, label_a array<long>, label_b array<long>"


def linked_components(members: DataFrame, texts: DataFrame, words: int, percent: int, miss: float) -> tuple[DataFrame, list[DataFrame]]:
    """Stars (u, v) of the labels that a link joins, and the written tables they are read from.

    members: (bucket, main, total, node, label), total the bucket's members; in each bucket those of other labels than main
    are compared with all, by signatures alone, and a pair only in the first bucket that it shares.
    What survives goes to the shares of texts that hold the two nodes, as lists, where each text comes once.
    """
    bounds = least_matches(percent / 100, miss)
    shares = max(1, -(-texts.count() // TEXTS))
    carried = members.join(texts.select("node", "sig", "bands").hint("merge"), "node").withColumn("n_blocks", F.ceil(F.col("total") / SHARE).cast("int"))
    carried = carried.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    member = F.struct("node", "label", (F.col("label") != F.col("main")).alias("out"), "sig", F.slice("bands", 1, F.array_position("bands", F.col("bucket")).cast("int") - 1).alias("earlier"))
    blocks_ = cut(carried.groupBy("bucket", "block", "n_blocks").agg(F.collect_list(member).alias("y")), "blocks")
    grouped = blocks_.withColumn("x", F.filter("y", lambda d: d["out"]))
    one = grouped.where("n_blocks = 1").select("x", "y")
    x = grouped.where("n_blocks > 1 and size(x) > 0").select("bucket", "x", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    many = x.join(grouped.where("n_blocks > 1").select("bucket", "block", "y").hint("merge"), ["bucket", "block"]).select("x", "y")
    share = lambda n: ((n.astype(np.uint64) * ODD[0] >> np.uint64(32)) % np.uint64(shares)).astype(np.int32)

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (Members(batch.column(c).slice(k, 1).flatten()) for c in (0, 1))
                i, j = survivors(x, y, bounds)
                if not len(i):
                    continue
                a, b, la, lb = x.node[i], y.node[j], x.label[i], y.label[j]
                swap = (share(a) > share(b)) | ((share(a) == share(b)) & (a > b))
                a, b, la, lb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, lb, la), np.where(swap, la, lb)
                sa, sb = share(a), share(b)
                order = np.lexsort((sb, sa))
                new = np.flatnonzero(np.r_[True, (np.diff(sa[order]) != 0) | (np.diff(sb[order]) != 0)])
                ends = pa.array(np.r_[new, len(order)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(sa[order[new]]), pa.array(sb[order[new]]), *(pa.ListArray.from_arrays(ends, pa.array(z[order])) for z in (a, b, la, lb))], [c.split()[0] for c in FOUND.split(", ")])

    found = one.where(F.size("x") > 0).unionByName(many).mapInArrow(compare, FOUND)
    lists = found.groupBy("share_a", "share_b").agg(F.collect_list(F.struct("a", "b", "label_a", "label_b")).alias("of"))
    lists = cut(lists.select("share_a", "share_b", *(F.flatten(F.col(f"of.{c}")).alias(c) for c in ("a", "b", "label_a", "label_b"))), "survivors")
    needed = lists.select("share_a", "share_b", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node"))
    with_texts = needed.join(texts.select("node", "packed").hint("merge"), "node").groupBy("share_a", "share_b").agg(F.collect_list(F.struct("node", "packed")).alias("texts"))
    met = lists.join(with_texts.hint("merge"), ["share_a", "share_b"]).select("texts", "a", "b", "label_a", "label_b")

    def verify(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                texts_ = batch.column(0).slice(k, 1).flatten()
                a, b, la, lb = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in range(1, 5))
                good = verified(texts_.field("node").to_numpy(), texts_.field("packed").to_pylist(), a, b, words, percent)
                yield pa.RecordBatch.from_arrays([pa.array(la[good]), pa.array(lb[good])], ["a", "b"])

    return met.mapInArrow(lambda batches: in_stars(verify(batches)), STARS), [blocks_, lists]


STARS = "u long, v long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest node of its component, for the edges (a, b) alone."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(names)))
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        up[max(i, j)] = min(i, j)
    for i, j in enumerate(up):  # parents come first
        up[i] = up[j]
    root = names[up]
    leaf = root != names
    return names[leaf], root[leaf]


def in_stars(batches, block: int = 1 << 18):
    """Batches of (u, v) with u > v: the edges (a, b) of each block of rows as stars, without loss of connections."""
    held: list[pa.RecordBatch] = []

    def made():
        u, v = forest(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= block:
            yield made()
            held = []
    if held:
        yield made()


POINTERS = "u long, v long, own boolean"
EDGES = 1 << 16  # edges that a task contracts, where they are many


def pointers(batches, block: int = 1 << 18):
    """Batches of POINTERS from groups (u, vs) of edges u > v: each block as stars, without loss of connections; own marks the groups' u, other rows are for the groups of later rounds."""
    held: list[pa.RecordBatch] = []

    def made():
        of, to = (pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))
        of = of.to_numpy()
        u, v = forest(np.repeat(of, to.value_lengths().to_numpy()), to.flatten().to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.isin(u, of))], [c.split()[0] for c in POINTERS.split(", ")])

    for batch in batches:
        held.append(batch)
        if sum(len(x.column(1).flatten()) for x in held) >= block:
            yield made()
            held = []
    if held:
        yield made()


def _contracted(edges: DataFrame, n: int) -> tuple[DataFrame, dict]:
    """n edges u > v, few of them for any u, as written pointers; their number and that of those that are not own."""
    seen = Observation()
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-n // EDGES))
    groups = edges.groupBy("u").agg(F.collect_set("v").alias("vs")).coalesce(tasks)  # a task joins what it holds, so few edges are not dealt to many
    e = cut(groups.mapInArrow(pointers, POINTERS).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(~F.col("own")).alias("loose")), "edges")
    return e, seen.get


def components(stars: DataFrame) -> DataFrame:
    """(u, v, own) for every node that is not the smallest of its component, v being the smallest; stars are edges u > v, with any u once in a block.

    A round moves each edge's v to v's own pointer, then groups by u. Own pointers are unique by u, so
    they meet the edges without an aggregate, and the frequent v of a large star can be split. In each
    round nodes get smaller or loose rows fewer; it ends where no pointer moves and none is loose.
    """
    seen = Observation()
    e = cut(stars.observe(seen, F.count(F.lit(1)).alias("n")), "stars")
    if not seen.get["n"]:
        return e
    past, (e, now) = e, _contracted(e, seen.get["n"])
    release(past)
    moved, loose = 1, 0
    while moved or loose:
        past, loose, seen = e, now["loose"], Observation()
        to = e.where("own").select(F.col("u").alias("v"), F.col("v").alias("m"))
        near = e.join(to.hint("merge"), "v", "left").observe(seen, F.count("m").alias("n"))
        e, now = _contracted(near.select("u", F.coalesce("m", "v").alias("v")), now["n"])
        moved = seen.get["n"]
        release(past)
    return e


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for every document."""
    return near_duplicate_rows(docs, words, percent, miss).select("doc_id", "n_shingles", "component_id", "kept")


def near_duplicate_rows(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """near_duplicates with text_key and first; rows of one doc_id and text are equal here."""
    s = cut(sketches(docs, words), "sketches")
    linked = s.where("doc_id is not null and n_shingles > 0")
    classes = cut(linked.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    nodes = classes.select(F.col("key1").alias("node"), "key2", "rep", "sig", "bands")
    member = classes.select(F.explode("bands").alias("bucket"), F.col("key1").alias("node"))
    hub = F.min_by("node", F.xxhash64("node", F.pmod("bucket", F.lit(ORDERS))))
    shared = cut(member.groupBy("bucket").agg(hub.alias("hub"), F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("bucket", "hub"), "shared")
    buckets = cut(member.join(shared.hint("merge"), "bucket"), "buckets")
    texts = cut(open_nodes(docs, nodes.join(buckets.select("node").distinct().hint("merge"), "node")), "open")
    pairs = buckets.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    label = components(confirmed(bayes_pruned(pairs, texts, percent / 100, miss), texts, words, percent))
    # Members of a bucket outside its most frequent component.
    named = label.select(F.col("u").alias("node"), F.col("v").alias("label")).hint("merge")
    of = cut(buckets.join(named, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "labelled")
    count = of.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    main = cut(count.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).where("k > 1").select("bucket", "main", "total"), "mains")
    links, read = linked_components(of.join(main.hint("merge"), "bucket"), texts, words, percent, miss)
    over = components(links)
    root = nodes.join(named, "node", "left").select("node", "key2", "rep", F.coalesce("label", "node").alias("v"))
    root = cut(root.join(over.select(F.col("u").alias("v"), F.col("v").alias("w")).hint("merge"), "v", "left").select("node", "key2", "rep", F.coalesce("w", "v").alias("root")), "roots")
    heads = cut(root.groupBy("root").agg(F.min("rep").alias("head")), "heads")
    release(classes, shared, buckets, texts, label, of, main, over, *read)
    final = root.join(heads.hint("merge"), "root").select(F.col("node").alias("key1"), "key2", "head")
    out = s.join(final.hint("merge"), ["key1", "key2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    first = alone | ((F.col("doc_id") == F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key")))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), first.alias("first"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
