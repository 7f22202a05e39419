"""Directory dependency graphs of many repositories at once, their components and cycles.

Inputs: files (repo_id, path) and imports (repo_id, source_file, raw_import,
resolved_path, is_package, line, column, kind). Every table keeps repo_id.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stratagraph.functions.paths import directory, package_id
from stratagraph.sources.written import cut, release


def nodes(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id", directory("path").alias("subtree")).agg(F.count(F.lit(1)).alias("n_files"))


def local_imports(imports: DataFrame) -> DataFrame:
    return imports.where("not is_package and resolved_path is not null and resolved_path <> ''")


def edges(imports: DataFrame) -> DataFrame:
    """Distinct source files for each pair of different directories."""
    e = local_imports(imports).select("repo_id", "source_file", directory("source_file").alias("src"), directory("resolved_path").alias("dst")).where("src <> dst")
    return e.groupBy("repo_id", "src", "dst").agg(F.countDistinct("source_file").alias("n_files"))


def package_edges(imports: DataFrame) -> DataFrame:
    e = imports.where("is_package").select("repo_id", "source_file", directory("source_file").alias("src"), package_id("raw_import").alias("pkg")).where("pkg <> ''")
    return e.groupBy("repo_id", "src", "pkg").agg(F.countDistinct("source_file").alias("n_files"))


def file_edges(imports: DataFrame) -> DataFrame:
    return local_imports(imports).select("repo_id", F.col("source_file").alias("src_file"), F.col("resolved_path").alias("dst_file")).distinct()


def source_activity(files_graph: DataFrame, packages: DataFrame) -> DataFrame:
    """Per directory: file edges that leave its files, plus package edge counts."""
    local = files_graph.select("repo_id", directory("src_file").alias("subtree"), F.lit(1).cast("long").alias("n"))
    return local.unionByName(packages.select("repo_id", F.col("src").alias("subtree"), F.col("n_files").alias("n"))).groupBy("repo_id", "subtree").agg(F.sum("n").alias("activity"))


def target_usage(graph_edges: DataFrame, target: str) -> DataFrame:
    return graph_edges.groupBy("repo_id", F.col(target).alias("target")).agg(F.sum("n_files").alias("usage"), F.count(F.lit(1)).alias("spread"))


def normalised_graph(graph_edges: DataFrame, normalise) -> DataFrame:
    """Edges re-keyed by normalise (a function of a path column); counts are summed and self edges dropped."""
    e = graph_edges.select("repo_id", normalise(F.col("src")).alias("src"), normalise(F.col("dst")).alias("dst"), "n_files").where("src <> dst")
    return e.groupBy("repo_id", "src", "dst").agg(F.sum("n_files").alias("n_files"))


def _counted(df: DataFrame, name: str, *more: Column) -> tuple[DataFrame, dict]:
    """df, written, and its count with further aggregates of it."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *more), name)
    return out, seen.get


def _settled(start: DataFrame, name: str, step: Callable[[DataFrame], DataFrame], *more: Column) -> tuple[DataFrame, dict]:
    """Repeat step until count and aggregates stay; a result goes when the next one is written."""
    now, seen = _counted(start, name, *more)
    while seen["n"]:
        after, then = _counted(step(now), name, *more)
        release(now)
        same, now, seen = then == seen, after, then
        if same:
            break
    return now, seen


def _ends(live: DataFrame) -> DataFrame:
    """(repo_id, node, ins, outs, before, after): the numbers of a node's edges, and its neighbours where there is one on a side."""
    none = F.lit(None).cast("string")
    side = live.select("repo_id", F.inline(F.array(F.struct(F.col("u").alias("node"), none.alias("before"), F.col("v").alias("after")), F.struct(F.col("v").alias("node"), F.col("u").alias("before"), none.alias("after")))))
    return side.groupBy("repo_id", "node").agg(F.count("before").alias("ins"), F.count("after").alias("outs"), F.min("before").alias("before"), F.min("after").alias("after"))


def _signed(*columns: str) -> Column:
    """An aggregate that stays only if the columns do."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("hash")


def _chains(ends: DataFrame) -> DataFrame:
    """(repo_id, node, head, behind, ahead, least, ring) of the nodes with one edge in and one out: the nodes on either side of the run of such nodes that holds it.

    Pointers double in each round. Where a run has no end it is a ring, and least is its smallest node.
    """
    c = ends.where("ins = 1 and outs = 1").select("repo_id", "node", F.col("before").alias("behind"), F.col("after").alias("ahead"), F.col("node").alias("least"), F.lit(True).alias("head"), F.lit(True).alias("ring"))

    def doubled(c: DataFrame) -> DataFrame:
        far = c.select("repo_id", F.col("node").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("least").alias("_least"))
        back = c.select("repo_id", F.col("node").alias("behind"), F.col("behind").alias("_behind"))
        both = c.join(far, ["repo_id", "ahead"], "left").join(back, ["repo_id", "behind"], "left")
        return both.select(
            "repo_id", "node", F.coalesce("_behind", "behind").alias("behind"), F.coalesce("_ahead", "ahead").alias("ahead"), F.least("least", "_least").alias("least"),
            (F.col("head") & F.col("_behind").isNull()).alias("head"), F.col("_ahead").isNotNull().alias("ring"),
        )

    return _settled(c, "chains", doubled, F.count_if("ring").alias("open"), _signed("repo_id", "node", "least"))[0]


def _least_before(live: DataFrame, name: str) -> DataFrame:
    """(repo_id, node, colour): the smallest node from which each node is reached, itself too.

    What reaches a node's colour reaches the node, so it takes its colour's colour as well. A
    colour may be that of most nodes; it is one row on the other side of that join, where
    adaptive execution splits a large partition.
    """
    nodes = live.select("repo_id", F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("colour", F.col("node"))

    def coloured(c: DataFrame) -> DataFrame:
        near = live.join(c.withColumnRenamed("node", "u"), ["repo_id", "u"]).select("repo_id", F.col("v").alias("node"), "colour")
        best = c.unionByName(near).groupBy("repo_id", "node").agg(F.min("colour").alias("colour"))
        further = c.where("node <> colour").select("repo_id", F.col("node").alias("colour"), F.col("colour").alias("_colour"))
        return best.join(further, ["repo_id", "colour"], "left").select("repo_id", "node", F.coalesce("_colour", "colour").alias("colour"))

    return _settled(nodes, name, coloured, _signed("repo_id", "node", "colour"))[0]


def _core(live: DataFrame) -> list[DataFrame]:
    """Components of edges that are not contracted any further: colours forwards, and within a colour backwards; nodes whose colours are one are a component, and go."""
    found: list[DataFrame] = []
    n = 1
    while n:
        colour = _least_before(live, "colours")
        at = lambda end, name: colour.select("repo_id", F.col("node").alias(end), F.col("colour").alias(name))  # noqa: B023, E731
        same = cut(live.join(at("u", "a"), ["repo_id", "u"]).join(at("v", "b"), ["repo_id", "v"]).where("a = b").select("repo_id", F.col("v").alias("u"), F.col("u").alias("v")), "inner")
        back = _least_before(same, "back").withColumnRenamed("colour", "component")
        met = cut(back.join(colour.withColumnRenamed("colour", "component"), ["repo_id", "node", "component"], "left_semi"), "met")
        many = met.groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(cut(met.join(many, ["repo_id", "component"], "left_semi").select("repo_id", "node", "component"), "found"))
        gone = met.select("repo_id", "node").unionByName(colour.where("node = colour").select("repo_id", "node")).distinct()
        rest = live.join(gone.withColumnRenamed("node", "u"), ["repo_id", "u"], "left_anti").join(gone.withColumnRenamed("node", "v"), ["repo_id", "v"], "left_anti")
        past, (live, seen) = live, _counted(rest.select("repo_id", "u", "v"), "live")
        n = seen["n"]
        release(past, same, colour, met)
    return found


def components(graph_edges: DataFrame) -> DataFrame:
    """(repo_id, node, component) of nodes on a cycle; component is its smallest node.

    Runs of nodes with one edge in and one out are contracted to an edge, and nodes that no
    cycle can hold are cut off, by turns, so trees and paths take a number of rounds that is
    logarithmic in their size; what is left is coloured (`_core`). Then runs are put back: one is on
    a cycle if both its ends are in one component, or are the same node. A round costs the edges
    that are left, whatever the number of repositories, and its result is a written table.
    """
    live, seen = _counted(graph_edges.select("repo_id", F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v").distinct(), "live")
    runs: list[DataFrame] = []
    while seen["n"]:
        ends, kinds = _counted(_ends(live), "ends", F.count_if(F.expr("ins = 1 and outs = 1")).alias("chain"), F.count_if(F.expr("ins = 0 or outs = 0")).alias("dead"))
        if not kinds["chain"] and not kinds["dead"]:
            release(ends)
            break
        e = live
        if kinds["chain"]:
            runs.append(_chains(ends))
            inner = ends.where("ins = 1 and outs = 1")
            e = live.join(inner.select("repo_id", F.col("node").alias("u")), ["repo_id", "u"], "left_anti").join(inner.select("repo_id", F.col("node").alias("v")), ["repo_id", "v"], "left_anti")
            e = e.select("repo_id", "u", "v").unionByName(runs[-1].where("head and not ring and behind <> ahead").select("repo_id", F.col("behind").alias("u"), F.col("ahead").alias("v"))).distinct()
        if kinds["dead"]:
            e = e.join(ends.where("ins = 0").select("repo_id", F.col("node").alias("u")), ["repo_id", "u"], "left_anti").join(ends.where("outs = 0").select("repo_id", F.col("node").alias("v")), ["repo_id", "v"], "left_anti")
        past, (live, seen) = live, _counted(e.select("repo_id", "u", "v"), "live")
        release(past, ends)
    none = graph_edges.select("repo_id", F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    found = reduce(DataFrame.unionByName, _core(live) if seen["n"] else [none])
    for c in reversed(runs):
        loops = c.where("not ring and behind = ahead").select("repo_id", F.col("behind").alias("node")).distinct().join(found, ["repo_id", "node"], "left_anti")
        found = found.unionByName(loops.select("repo_id", "node", F.col("node").alias("component")))
        at = lambda end, name: found.select("repo_id", F.col("node").alias(end), F.col("component").alias(name))  # noqa: B023, E731
        back = c.where("not ring").join(at("behind", "component"), ["repo_id", "behind"]).join(at("ahead", "_other"), ["repo_id", "ahead"]).where("component = _other")
        rings = c.where("ring").select("repo_id", "node", F.col("least").alias("component"))
        found = cut(found.unionByName(back.select("repo_id", "node", "component")).unionByName(rings), "found")
        release(c)
    if not runs:
        return found
    first = found.groupBy("repo_id", "component").agg(F.min("node").alias("_first"))
    return found.join(first, ["repo_id", "component"]).select("repo_id", "node", F.col("_first").alias("component"))


class Ring:
    """The edges of one component as they arrive, in order of their ends; then adjacency arrays of numbered nodes."""

    def __init__(self):
        self.parts: list[tuple[pa.Array, pa.Array]] = []

    def add(self, src: pa.Array, dst: pa.Array) -> None:
        self.parts.append((src.dictionary_encode(), dst))

    def closed(self) -> tuple[list[str], Iterator[list[int]]]:
        """Names, and the rings that a depth-first search closes, nodes and neighbours in order. On a component each node has an edge, so the sources are all its nodes."""
        names = pa.chunked_array([p[0].dictionary for p in self.parts]).unique()
        number = lambda xs: pc.index_in(xs, value_set=names).to_numpy(zero_copy_only=False).astype(np.int32)
        after = array("i", np.concatenate([number(d) for _, d in self.parts]).tobytes())
        counts = sum(np.bincount(number(s.dictionary)[s.indices.to_numpy(zero_copy_only=False)], minlength=len(names)) for s, _ in self.parts)
        self.parts = []
        return names, back_edge_rings(array("q", np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes()), after)


def back_edge_rings(first: array, after: array) -> Iterator[list[int]]:
    """Rings that a depth-first search closes, as it meets them: node n's neighbours are after[first[n]:first[n + 1]].

    A ring is a path of the search and the edge that closes it, and each edge is met once, so no ring comes twice.
    """
    n = len(first) - 1
    at, depth = array("q", first[:n]), array("i", bytes(4 * n))  # depth on the path from 1; 0: not met, -1: left
    for root in range(n):
        if depth[root]:
            continue
        path = [root]
        depth[root] = 1
        while path:
            node = path[-1]
            if at[node] == first[node + 1]:
                depth[node] = -1
                path.pop()
                continue
            nxt = after[at[node]]
            at[node] += 1
            if depth[nxt] > 0:
                yield path[depth[nxt] - 1 :]
            elif not depth[nxt]:
                path.append(nxt)
                depth[nxt] = len(path)


CHAINS = "repo_id string, component string, first string, chain string"


def chains(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cycles of (repo_id, component, src, dst) that come sorted; results leave when they hold about `most` characters.

    A task holds one component: its targets' names in Arrow, then 4 bytes an edge and 12 a node.
    """
    key, ring = None, Ring()

    def search() -> Iterator[pa.RecordBatch]:
        names, rings = ring.closed()
        rows, size = [], 0
        for r in rings:
            on = names.take(pa.array([*r, r[0]])).to_pylist()
            rows.append((*key, on[0], " -> ".join(on)))
            size += len(rows[-1][3])
            if size >= most:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["repo_id", "component", "first", "chain"])

    for b in batches:
        repo, component, src, dst = b.columns
        runs = pc.run_end_encode(pa.array(pc.binary_join_element_wise(repo, component, "\x00"))).run_ends.to_pylist() if b.num_rows else []
        start = 0
        for end in runs:
            here = (repo[start].as_py(), component[start].as_py())
            if key is not None and here != key:
                yield from search()
                ring = Ring()
            key = here
            ring.add(src.slice(start, end - start), dst.slice(start, end - start))
            start = end
    if key is not None:
        yield from search()


def cycles(graph_edges: DataFrame) -> DataFrame:
    """(repo_id, component, first, chain): cycles within each strongly connected component, searched from its smallest node; a component's edges are one sorted stream."""
    c = components(graph_edges)
    inner = graph_edges.join(c.select("repo_id", F.col("node").alias("src"), "component"), ["repo_id", "src"]).join(c.select("repo_id", F.col("node").alias("dst"), F.col("component").alias("other")), ["repo_id", "dst"]).where("component = other")
    inner = inner.select("repo_id", "component", "src", "dst").distinct()
    return inner.repartition("repo_id", "component").sortWithinPartitions("repo_id", "component", "src", "dst").mapInArrow(chains, CHAINS)
