"""Candidate rules from observed structure: supports, prevalences, gates, caps and aggregation.

Absence of an import is evidence too, so any scope and target of a repository may
make a candidate. `pairs` lists every pair with its reason, by an equi-join on repo_id,
and `open_pairs` those that are not dropped. Mining itself makes no such rows: `sides`
gates scopes, targets and edges apart, `greedy_accepted` takes pairs from them up to the caps,
and `drop_counts` counts what is dropped from sums and products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import profiles
from stratagraph.functions.paths import confidence_rank, directory, ecosystem_package, low_signal, mined_confidence, suffix
from stratagraph.operators import graph
from stratagraph.sources.written import cut


def limits(min_support: int) -> dict[str, int]:
    """Caps and least usages that follow from the support."""
    step = 2 if min_support >= 50 else 1 if min_support >= 20 else 0
    return {"imports": max(1, min_support), "packages": max(1, min_support // 2), "per_scope": (3, 5, 8)[step], "per_target": (5, 10, 16)[step]}


def pairs(kind: str, nodes: DataFrame, edges: DataFrame, target: str, targets: DataFrame, activity: DataFrame, min_support: int = 20, max_prevalence: float = 0.02) -> DataFrame:
    """Every (scope, target) pair with its counts and drop_reason, null for candidates; caps are applied by greedy_caps."""
    sources = nodes.where(F.col("n_files") >= min_support).select("repo_id", F.col("subtree").alias("scope"), F.col("n_files").alias("support"))
    active = sources.groupBy("repo_id").agg(F.count(F.lit(1)).alias("sources"))
    usage = graph.target_usage(edges, target)
    counts = edges.select("repo_id", F.col("src").alias("scope"), F.col(target).alias("target"), F.col("n_files").alias("violations"))
    p = sources.join(targets, "repo_id")
    if kind == "no_import":
        p = p.where("scope <> target")
    p = p.join(usage, ["repo_id", "target"], "left").join(counts, ["repo_id", "scope", "target"], "left").join(activity.withColumnRenamed("subtree", "scope"), ["repo_id", "scope"], "left").join(active, "repo_id")
    p = p.fillna(0, ["usage", "spread", "violations", "activity"]).withColumn("prevalence", F.col("violations") / F.col("support"))
    zero = F.col("violations") == 0
    least = limits(min_support)["imports" if kind == "no_import" else "packages"]
    reason = F.when(F.col("usage") == 0, "target_never_observed")
    if kind == "no_package":
        reason = reason.when(zero & ~ecosystem_package(F.col("target")), "zero_non_ecosystem_target")
    reason = reason.when(zero & (F.col("usage") < least), "zero_low_global_usage").when(zero & (F.col("activity") == 0), "zero_inactive_source").when(zero & low_signal(F.col("scope")), "zero_low_signal_scope").when(zero & (F.col("spread") > most_spread(F.col("sources"))), "zero_target_over_spread").when(~zero & (F.col("prevalence") > max_prevalence), "prevalence_over_limit")
    return p.select("repo_id", F.lit(kind).alias("kind"), "scope", "target", "support", "violations", "prevalence", "usage", "spread", reason.alias("drop_reason"))


@dataclass
class Sides:
    """What the open pairs of a kind are made of: violating pairs, and scopes and targets of which each pair without an edge is open."""

    kind: str
    bad: DataFrame  # repo_id, scope, target, support, violations, usage, spread
    scopes: DataFrame  # repo_id, scope, support
    targets: DataFrame  # repo_id, target, usage, spread
    edges: DataFrame  # repo_id, scope, target of all edges

    def rows(self, zero: DataFrame) -> DataFrame:
        """The violating pairs and the given ones without violations (repo_id, scope, target, support, usage, spread)."""
        columns = ["repo_id", F.lit(self.kind).alias("kind"), "scope", "target", "support", "violations", (F.col("violations") / F.col("support")).alias("prevalence"), "usage", "spread", F.lit(None).cast("string").alias("drop_reason")]
        return self.bad.select(*columns).unionByName(zero.withColumn("violations", F.lit(0).cast("long")).select(*columns))


def sides(kind: str, nodes: DataFrame, edges: DataFrame, target: str, activity: DataFrame, min_support: int = 20, max_prevalence: float = 0.02) -> Sides:
    """Gates on violating pairs, and on scopes and targets of the others by themselves, so that nothing is paired to be dropped."""
    sources = nodes.where(F.col("n_files") >= min_support).select("repo_id", F.col("subtree").alias("scope"), F.col("n_files").alias("support"))
    usage = graph.target_usage(edges, target)
    counts = edges.select("repo_id", F.col("src").alias("scope"), F.col(target).alias("target"), F.col("n_files").alias("violations"))
    if kind == "no_import":
        counts = counts.join(nodes.select("repo_id", F.col("subtree").alias("target")), ["repo_id", "target"], "left_semi")
        usage = usage.join(nodes.select("repo_id", F.col("subtree").alias("target")), ["repo_id", "target"], "left_semi")
    bad = counts.join(sources, ["repo_id", "scope"]).where(F.col("violations") / F.col("support") <= max_prevalence).join(usage, ["repo_id", "target"])
    active = sources.groupBy("repo_id").agg(F.count(F.lit(1)).alias("sources"))
    good = usage.where(F.col("usage") >= limits(min_support)["imports" if kind == "no_import" else "packages"]).join(active, "repo_id").where(F.col("spread") <= most_spread(F.col("sources"))).drop("sources")
    if kind == "no_package":
        good = good.where(ecosystem_package(F.col("target")))
    busy = sources.join(activity.where("activity > 0").select("repo_id", F.col("subtree").alias("scope")), ["repo_id", "scope"], "left_semi").where(~low_signal(F.col("scope")))
    return Sides(kind, bad, busy, good, counts.select("repo_id", "scope", "target"))


def most_spread(sources: Column) -> Column:
    """The most scopes a target may have, by the number of scopes in its repository."""
    return F.when(sources <= 4, sources).otherwise(F.greatest(F.lit(3), F.floor(sources / 4)))


def open_pairs(kind: str, nodes: DataFrame, edges: DataFrame, target: str, activity: DataFrame, min_support: int = 20, max_prevalence: float = 0.02) -> DataFrame:
    """The pairs that `pairs` does not drop, all of them as rows."""
    s = sides(kind, nodes, edges, target, activity, min_support, max_prevalence)
    zero = s.scopes.join(s.targets, "repo_id").join(s.edges, ["repo_id", "scope", "target"], "left_anti")
    return s.rows(zero.where("scope <> target") if kind == "no_import" else zero)


def drop_counts(kind: str, nodes: DataFrame, edges: DataFrame, target: str, targets: DataFrame, activity: DataFrame, min_support: int = 20, max_prevalence: float = 0.02) -> DataFrame:
    """(repo_id, kind, reason, n): how many pairs `pairs` drops for each reason, without pairs.

    A pair without violations is dropped by a property of its target, of its scope, or
    of its target again, in this order. So scopes and targets are counted by these
    properties, the counts multiplied, and corrected by the pairs that have edges and, of
    directories, by those of a scope with itself.
    """
    sources = nodes.where(F.col("n_files") >= min_support).select("repo_id", F.col("subtree").alias("scope"), F.col("n_files").alias("support"))
    active = sources.groupBy("repo_id").agg(F.count(F.lit(1)).alias("sources"))
    least = limits(min_support)["imports" if kind == "no_import" else "packages"]
    t = targets.select("repo_id", "target").join(graph.target_usage(edges, target), ["repo_id", "target"], "left").fillna(0, ["usage", "spread"]).join(active, "repo_id")
    first = F.when(F.col("usage") == 0, "target_never_observed")
    if kind == "no_package":
        first = first.when(~ecosystem_package(F.col("target")), "zero_non_ecosystem_target")
    first = first.when(F.col("usage") < least, "zero_low_global_usage")
    t = t.select("repo_id", "target", first.alias("first"), F.when(F.col("spread") > most_spread(F.col("sources")), "zero_target_over_spread").alias("last"))
    s = sources.join(activity.withColumnRenamed("subtree", "scope"), ["repo_id", "scope"], "left").fillna(0, ["activity"])
    s = s.select("repo_id", "scope", "support", F.when(F.col("activity") == 0, "zero_inactive_source").when(low_signal(F.col("scope")), "zero_low_signal_scope").alias("second"))
    reason = F.coalesce("first", "second", "last").alias("reason")
    by_target = t.groupBy("repo_id", "first", "last").agg(F.count(F.lit(1)).alias("targets"))
    by_scope = s.groupBy("repo_id", "second").agg(F.count(F.lit(1)).alias("scopes"))
    parts = [by_target.join(by_scope, "repo_id").select("repo_id", reason, (F.col("targets") * F.col("scopes")).alias("n"))]
    met = edges.select("repo_id", F.col("src").alias("scope"), F.col(target).alias("target"), F.col("n_files").alias("violations")).join(s, ["repo_id", "scope"]).join(t, ["repo_id", "target"])
    over = F.when(F.col("violations") / F.col("support") > max_prevalence, "prevalence_over_limit")
    parts.append(met.select("repo_id", F.inline(F.array(F.struct(reason, F.lit(-1).cast("long").alias("n")), F.struct(over.alias("reason"), F.lit(1).cast("long").alias("n"))))))
    if kind == "no_import":
        parts.append(s.join(t.withColumnRenamed("target", "scope"), ["repo_id", "scope"]).select("repo_id", reason, F.lit(-1).cast("long").alias("n")))
    every = reduce(DataFrame.unionByName, parts).where("reason is not null").groupBy("repo_id", "reason").agg(F.sum("n").alias("n"))
    return every.where("n > 0").select("repo_id", F.lit(kind).alias("kind"), "reason", "n")


ACCEPTED = "repo_id string, scope string, target string"


class Openings:
    """The targets of one repository in order, each until its cap is used up; a full one points to what follows it."""

    def __init__(self, names: list[str], cap: int):
        self.names, self.left, self.after = names, [cap] * len(names), list(range(len(names) + 1))

    def next(self, k: int) -> int:
        """The first open place from k on."""
        at = k
        while self.after[at] != at:
            at = self.after[at]
        while self.after[k] != at:
            self.after[k], k = at, self.after[k]
        return at

    def take(self, most: int, blocked: set[str]) -> list[str]:
        """The first open targets that are not blocked, at most so many; each loses a place."""
        out: list[str] = []
        k = self.next(0)
        while len(out) < most and k < len(self.names):
            if self.names[k] not in blocked:
                out.append(self.names[k])
                self.left[k] -= 1
                if not self.left[k]:
                    self.after[k] = k + 1
            k = self.next(k + 1)
        return out


def greedy_accepted(s: Sides, min_support: int = 20) -> DataFrame:
    """(repo_id, scope, target) of the pairs without an edge that are accepted in order of scope and target while both counts are under their caps; a directory is not paired with itself.

    Each acceptance depends on the earlier ones in both dimensions, so a repository is one stream, but of its scopes, targets
    and edges and not of its pairs: full targets are skipped by pointers, and a scope ends at its cap. The task holds a
    repository's targets and one scope's edges.
    """
    cap = limits(min_support)
    at = lambda df, part, scope, target: df.select("repo_id", F.lit(part).alias("part"), scope.alias("scope"), target.alias("target"))
    none = F.lit(None).cast("string")
    edges = s.edges.join(s.scopes.select("repo_id", "scope"), ["repo_id", "scope"], "left_semi")
    rows = at(s.targets, 0, none, F.col("target")).unionByName(at(s.scopes, 1, F.col("scope"), none)).unionByName(at(edges, 1, F.col("scope"), F.col("target")))
    itself = s.kind == "no_import"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, names, open_, scope, blocked, out = None, [], None, None, set(), []

        def close() -> None:
            nonlocal open_
            if scope is not None:
                open_ = open_ or Openings(names, cap["per_target"])
                out.extend((repo, scope, t) for t in open_.take(cap["per_scope"], blocked))

        for batch in batches:
            for r, part, name, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != repo or name != scope:
                    close()
                    scope, blocked = name, {name} if itself else set()
                if r != repo:
                    repo, names, open_ = r, [], None
                if part == 0:
                    names.append(t)
                elif t is not None:
                    blocked.add(t)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["repo_id", "scope", "target"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["repo_id", "scope", "target"])

    return rows.repartition("repo_id").sortWithinPartitions("repo_id", "part", "scope", "target").mapInArrow(fold, ACCEPTED)


def greedy_caps(gated: DataFrame, accepted: DataFrame, min_support: int = 20) -> DataFrame:
    """gated with the pairs that caps drop: a pair after the last one that its scope may have is dropped by the scope's cap, another one that is not accepted by the target's."""
    cap = limits(min_support)["per_scope"]
    last = accepted.groupBy("repo_id", "scope").agg(F.count(F.lit(1)).alias("_n"), F.max("target").alias("_last")).where(F.col("_n") >= cap).drop("_n")
    g = gated.join(accepted.withColumn("_taken", F.lit(True)), ["repo_id", "scope", "target"], "left").join(last, ["repo_id", "scope"], "left")
    out = F.col("drop_reason").isNull() & (F.col("violations") == 0) & F.col("_taken").isNull()
    reason = F.when(out & (F.col("target") > F.col("_last")), "zero_source_cap").when(out, "zero_target_cap")
    return g.withColumn("drop_reason", F.coalesce("drop_reason", reason)).select(*gated.columns)


@dataclass
class Inputs:
    """What is mined: files, and the graph as counted tables."""

    files: DataFrame  # repo_id, path
    nodes: DataFrame
    edges: DataFrame
    packages: DataFrame
    activity: DataFrame


def inputs(files: DataFrame, imports: DataFrame, frameworks: DataFrame | None = None) -> Inputs:
    """The inputs of mining; with frameworks (repo_id, framework), of profiles.detect, paths are those of each repository's own profile.

    Counts of directories that get one name are added, and edges within one name go. Edges between files are not
    renamed, so where a profile applies a directory's activity is that of its packages.
    """
    nodes, edges, packages, local = graph.nodes(files), graph.edges(imports), graph.package_edges(imports), graph.file_edges(imports)
    if frameworks is None:
        return Inputs(files, nodes, edges, packages, graph.source_activity(local, packages))
    known = frameworks.select("repo_id", F.when(F.col("framework").isin(*profiles.SEGMENTS), F.col("framework")).alias("_profile"))
    own = lambda df: df.join(known, "repo_id", "left")
    name = lambda c: profiles.by_profile(F.col("_profile"), F.col(c), profiles.normal_subtree).alias(c)
    total = F.sum("n_files").alias("n_files")
    packages = own(packages).groupBy("repo_id", name("src"), "pkg").agg(total)
    return Inputs(
        own(files).select("repo_id", profiles.by_profile(F.col("_profile"), F.col("path"), profiles.normal_file).alias("path")),
        own(nodes).groupBy("repo_id", name("subtree")).agg(total),
        own(edges).select("repo_id", name("src"), name("dst"), "n_files").where("src <> dst").groupBy("repo_id", "src", "dst").agg(total),
        packages,
        graph.source_activity(local.join(known.where("_profile is not null"), "repo_id", "left_anti"), packages),
    )


def propose(files: DataFrame, imports: DataFrame, min_support: int = 20, max_prevalence: float = 0.02, most: int = 200, frameworks: DataFrame | None = None) -> DataFrame:
    """All candidates of a repository: the four generators, caps on pairs without violations, siblings joined, at most `most` of a kind; to be ordered by kind and scope.

    Limits of 0 or less mean the defaults. The graph is built once and written. frameworks: as inputs takes them.
    """
    min_support, max_prevalence, most = (x if x > 0 else y for x, y in ((min_support, 20), (max_prevalence, 0.02), (most, 200)))
    files = cut(files.select("repo_id", "path"), "files")
    facts = cut(imports.select("repo_id", "source_file", "raw_import", "resolved_path", "is_package"), "imports")
    i = inputs(files, facts, frameworks)
    nodes, edges, packages, activity = (cut(df, name) for df, name in ((i.nodes, "nodes"), (i.edges, "edges"), (i.packages, "package-edges"), (i.activity, "activity")))
    files = i.files
    parts = []
    for kind, e, target in (("no_import", edges, "dst"), ("no_package", packages, "pkg")):
        s = sides(kind, nodes, e, target, activity, min_support, max_prevalence)
        s.scopes, s.targets = cut(s.scopes, "scopes"), cut(s.targets, "targets")
        zero = greedy_accepted(s, min_support).join(s.scopes, ["repo_id", "scope"]).join(s.targets, ["repo_id", "target"])
        parts.append(ranked_cap(sibling_scopes(candidates(s.rows(zero))), most))
    parts.append(ranked_cap(file_patterns(files, min_support), most))
    parts.append(ranked_cap(cycle_rules(nodes, edges, min_support).withColumn("target", F.lit(None).cast("string")), most))
    columns = ["repo_id", "kind", "scope", "target", "severity", "support", "violations", "prevalence", "confidence", "evidence"]
    return reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))


def candidates(kept: DataFrame) -> DataFrame:
    """Candidate rows from pairs that were not dropped."""
    c = kept.where("drop_reason is null")
    target = F.when(F.col("kind") == "no_import", F.concat("target", F.lit("/**"))).otherwise(F.col("target"))
    evidence = F.concat(F.col("violations"), F.lit("/"), F.col("support"), F.lit(" files in "), F.col("scope"), F.lit(" import "), F.col("target"))
    return c.select("repo_id", "kind", F.concat("scope", F.lit("/**")).alias("scope"), target.alias("target"), F.lit("warning").alias("severity"), "support", "violations", "prevalence", mined_confidence(F.col("prevalence"), F.col("support")).alias("confidence"), evidence.alias("evidence"))


def drop_stats(kept: DataFrame) -> DataFrame:
    return kept.where("drop_reason is not null").groupBy("repo_id", "kind", F.col("drop_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def sibling_scopes(c: DataFrame) -> DataFrame:
    """Two or more candidates without violations, with one target and parent directory, become one candidate of the parent."""
    root = F.regexp_replace("scope", "/[*][*]$", "")
    c = c.withColumn("_parent", directory(root)).withColumn("_can", (F.col("violations") == 0) & ~F.col("_parent").isin(".", "/", ""))
    key = ["repo_id", "kind", "target", "_parent"]
    groups = c.where("_can").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sum("support").alias("support"), F.max((F.col("severity") == "error").cast("int")).alias("_error")).where("_n >= 2")
    stay = c.where("not _can").unionByName(c.where("_can").join(groups.select(*key), key, "left_anti"))
    none = F.lit(0).cast("long")
    merged = groups.select(
        "repo_id", "kind", F.concat("_parent", F.lit("/**")).alias("scope"), "target", F.when(F.col("_error") == 1, "error").otherwise("warning").alias("severity"), "support", none.alias("violations"), F.lit(0.0).alias("prevalence"),
        mined_confidence(F.lit(0.0), F.col("support")).alias("confidence"), F.concat(F.lit("0/"), F.col("support"), F.lit(" files across "), F.col("_n"), F.lit(" sibling scopes under "), F.col("_parent"), F.lit(" import "), F.col("target")).alias("evidence"),
    )
    return stay.drop("_parent", "_can").unionByName(merged)


def better() -> list[Column]:
    return [confidence_rank(F.col("confidence")).desc(), F.col("support").desc(), F.col("prevalence"), F.col("violations"), F.col("scope"), F.col("target")]


def ranked_cap(c: DataFrame, most: int = 200) -> DataFrame:
    """At most `most` candidates of a kind: violating ones first, then a bounded share of the others."""
    c, bad = cut(c, "candidates"), F.col("violations") > 0
    count = c.groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("_all"), F.count_if(bad).alias("_bad"))
    rank = F.row_number().over(Window.partitionBy("repo_id", "kind", bad).orderBy(*better()))
    first = c.withColumn("_rank", rank).where(F.col("_rank") <= most)  # a bounded number in each task, before they meet
    half, third = most // 2 if most // 2 >= 20 else most, most // 3 if most // 3 >= 20 else most
    quota = F.greatest(F.lit(0), F.least(F.when(F.col("_bad") == 0, min(half, third)).otherwise(half), most - F.col("_bad")))
    return first.join(count, ["repo_id", "kind"]).where((F.col("_all") <= most) | bad | (F.col("_rank") <= quota)).select(*c.columns)


def suffix_counts(files: DataFrame) -> DataFrame:
    return files.select("repo_id", directory("path").alias("subtree"), suffix("path").alias("suffix")).where("suffix is not null").groupBy("repo_id", "subtree", "suffix").agg(F.count(F.lit(1)).alias("n"))


def dominant_suffix(files: DataFrame) -> DataFrame:
    """The most frequent suffix of each directory; ties go to the smaller suffix."""
    s = suffix_counts(files)
    return s.groupBy("repo_id", "subtree").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("suffix").alias("suffix"))).alias("best")).select("repo_id", "subtree", F.col("best.suffix").alias("suffix"), (-F.col("best.m")).alias("n"))


def file_patterns(files: DataFrame, min_support: int = 20) -> DataFrame:
    """A naming rule for each directory whose dominant suffix leaves at most a fifth of its files out."""
    every = suffix_counts(files)
    total = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_files"))
    top = every.groupBy("repo_id", "suffix").agg(F.sum("n").alias("_n")).groupBy("repo_id").agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col("suffix").alias("suffix"))).alias("_top"))
    d = graph.nodes(files).where(F.col("n_files") >= min_support).join(dominant_suffix(files), ["repo_id", "subtree"]).join(total, "repo_id").join(top, "repo_id")
    d = d.withColumn("violations", F.col("n_files") - F.col("n")).withColumn("prevalence", F.col("violations") / F.col("n_files")).where("prevalence <= 0.20")
    trivial = F.col("suffix").isin(".php", ".phtml") & (F.col("violations") == 0) & (F.col("_top.suffix") == F.col("suffix")) & (-F.col("_top.m") / F.col("_files") >= 0.9)
    quoted = F.regexp_replace("suffix", r"([\\.+*?()|\[\]{}^$])", r"\\$1")
    return d.where(~trivial).select("repo_id", F.lit("file_pattern").alias("kind"), F.concat("subtree", F.lit("/**")).alias("scope"), F.concat(F.lit("^.*"), quoted, F.lit("$")).alias("target"), F.lit("warning").alias("severity"), F.col("n_files").alias("support"), "violations", "prevalence", F.lit("HIGH").alias("confidence"), F.concat("n", F.lit("/"), "n_files", F.lit(" files in "), "subtree", F.lit(" match suffix "), "suffix").alias("evidence"))


def cycle_rules(nodes: DataFrame, graph_edges: DataFrame, min_support: int = 20) -> DataFrame:
    """A no_cycle candidate for each component of enough files."""
    c = graph.components(graph_edges).join(nodes.withColumnRenamed("subtree", "node"), ["repo_id", "node"])
    g = c.groupBy("repo_id", "component").agg(F.sum("n_files").alias("support"), F.count(F.lit(1)).alias("violations"), F.array_sort(F.collect_set("node")).alias("members"))
    shared = F.aggregate(F.transform("members", lambda m: F.split(m, "/")), F.split(F.element_at("members", 1), "/"), lambda acc, m: F.when(F.size(acc) == 0, acc).otherwise(F.slice(acc, 1, F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(acc))), lambda i: F.slice(acc, 1, i) == F.slice(m, 1, i))))))
    prefix = F.array_join(shared, "/")
    scope = F.concat(F.when(prefix != "", prefix).otherwise(F.element_at("members", 1)), F.lit("/**"))
    return g.where(F.col("support") >= min_support).select("repo_id", F.lit("no_cycle").alias("kind"), scope.alias("scope"), F.lit("error").alias("severity"), "support", "violations", F.lit(1.0).alias("prevalence"), F.lit("HIGH").alias("confidence"), F.concat(F.lit("cycle component ("), "violations", F.lit(" subtrees): "), F.array_join("members", " <-> ")).alias("evidence"))


def dedupe_workspaces(c: DataFrame, most: int = 200) -> DataFrame:
    """One candidate for each kind, scope, target and severity: the one of larger support; then the cap."""
    w = Window.partitionBy("repo_id", "kind", "scope", "target", "severity").orderBy(F.desc("support"), *better())
    return ranked_cap(c.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), most)


