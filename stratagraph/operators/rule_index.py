"""Thousands of rules as rows: paths meet by an equi-join only the rules they may fit, and only those are matched by pattern.

A glob that fits a path shows it a key: the literal segments it begins with, else a literal
segment anywhere, else its file extension. A path has few such keys. An import has them on
two sides; a rule waits on the side whose keys fewer rules share. A glob without any literal,
such as **, has the empty key, which every path has, since every path may fit it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratagraph.functions.globs import NEVER, alternatives, clean, glob_regex
from stratagraph.functions.paths import basename, cleaned, package_id
from stratagraph.operators import policy
from stratagraph.operators.policy import Rule

Key = tuple[str, str]  # kind and value: head, segment, extension, exact, or any with ''
ROW = "rank int, id string, kind string, severity string, message string, scope string, target array<string>, target_glob string, excepted string, side string, key_kind string, key string"
WILD = re.compile(r"[*?\[]")
LINE_END = r"(?:\r\n|[\n\r\x85\x{2028}\x{2029}])\z"


def glob_keys(pattern: str) -> set[Key]:
    """A key for each brace alternative of a glob; none if nothing fits the glob."""
    if glob_regex(pattern) is None:
        return set()
    out: set[Key] = set()
    for one in alternatives(clean(pattern.strip())):
        segments = one.split("/")
        wild = [bool(WILD.search(s)) for s in segments]
        lead = wild.index(True) if True in wild else len(segments)
        plain = [s for s, w in zip(segments, wild, strict=True) if s and not w]
        extension = re.search(r"\.([^.*?\[\]]+)$", segments[-1])
        if any(segments[:lead]):
            out.add(("head", "/".join(segments[:lead])))
        elif plain:
            out.add(("segment", max(plain, key=len)))
        else:
            out.add(("extension", extension[1]) if extension else ("any", ""))
    return out


def glob_pattern(patterns: list[str]) -> str:
    return "|".join(rx for rx in map(glob_regex, patterns) if rx) or NEVER


def rule_rows(ranked: list[tuple[int, Rule]]) -> list[tuple]:
    """A row, as ROW has it, for each key that a rule waits for."""
    sides = {k: {"scope": set().union(*map(glob_keys, r.scope)), "target": _target_keys(r)} for k, r in ranked}
    shared = Counter((side, key) for s in sides.values() for side, keys in s.items() for key in keys or ())
    rows = []
    for k, r in ranked:
        # The side of fewer sharers; a key that every path has counts most. None: a side that is no path.
        worth = {side: max(((key[0] == "any", shared[side, key]) for key in keys), default=(False, 0)) for side, keys in sides[k].items() if keys is not None}
        side = min(worth, key=worth.__getitem__)
        target = [policy.regex_dialect(p) for p in r.target] if r.relation() == "files" else r.target
        for kind, key in sorted(sides[k][side]):
            rows.append((k, r.id, r.kind, r.severity, r.message, glob_pattern(r.scope), target, glob_pattern(r.target) if r.relation() in ("imports", "packages") else NEVER, glob_pattern(r.except_), side, kind, key))
    return rows


def _target_keys(r: Rule) -> set[Key] | None:
    if r.relation() not in ("imports", "packages"):
        return None
    keys = set().union(*map(glob_keys, r.target))
    return keys | {("exact", t) for t in r.target} if r.relation() == "packages" else keys


def path_keys(path: Column, kinds: set[str], heads: list[int]) -> Column:
    """The keys of the given kinds that globs of the path may show, as an array of structs; heads: the numbers of segments that a glob begins with. A line end after a path counts as none, as patterns see it."""
    key = lambda kind, value: F.struct(F.lit(kind).alias("key_kind"), value.alias("key"))
    segments = F.split(F.regexp_replace(path, LINE_END, ""), "/")
    fitting = F.filter(F.array(*map(F.lit, heads)).cast("array<int>"), lambda n: n <= F.size(segments))
    of = {
        "head": F.transform(fitting, lambda n: key("head", F.array_join(F.slice(segments, 1, n), "/"))),
        "segment": F.transform(F.array_distinct(segments), lambda s: key("segment", s)),
        "extension": F.array(key("extension", F.substring_index(F.element_at(segments, -1), ".", -1))),
        "any": F.array(key("any", F.lit(""))),
        "exact": F.array(key("exact", path)),
    }
    return F.when(path.isNotNull(), F.concat(*(of[k] for k in sorted(kinds))))


def met(df: DataFrame, rows: list[tuple], sides: dict[str, list[Column]]) -> DataFrame:
    """df's rows with the rules (columns _rule_*) whose key they have on the side on which the rule waits; a row may meet a rule by several keys."""
    spark, names = df.sparkSession, [x.split()[0] for x in ROW.split(", ")]
    rules = spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=to_arrow_schema(StructType.fromDDL(ROW))), ROW)
    parts = []
    for side, paths in sides.items():
        kinds = {kind for *_, at, kind, _ in rows if at == side}
        heads = sorted({key.count("/") + 1 for *_, at, kind, key in rows if at == side and kind == "head"})
        for p in paths if kinds else ():
            keys = F.coalesce(path_keys(p, kinds, heads), F.array().cast("array<struct<key_kind:string,key:string>>"))
            parts.append(F.transform(keys, lambda x: F.struct(F.lit(side).alias("side"), x["key_kind"].alias("key_kind"), x["key"].alias("key"))))  # noqa: B023
    key = ["side", "key_kind", "key"]
    probed = df.select("*", F.inline(F.array_distinct(F.concat(*parts))))
    return probed.join(rules.select(*key, *(F.col(c).alias(f"_rule_{c}") for c in rules.columns if c not in key)), key).drop(*key)


def evaluate_indexed(rules: list[Rule], files: DataFrame, imports: DataFrame, constructions: DataFrame | None = None) -> DataFrame:
    """What policy.evaluate finds, for thousands of rules: its plan does not grow with their number.

    The rules are a table of the size of the given list, which Spark broadcasts if it is small.
    Rules over cycles are left to policy.evaluate, as each is a graph of its own. Paths are
    as policy.evaluate takes them; a null path meets no rule; no rules find nothing.
    """
    ranked = list(enumerate(rules))
    one, none = F.lit(1), F.lit("")
    parts: list[DataFrame] = []

    def scan(relation: str, df: DataFrame, sides: dict[str, list[Column]], holds: Column, place: tuple[Column, ...], fallback: Column) -> None:
        rows = rule_rows([(k, x) for k, x in ranked if x.relation() == relation])
        if not rows:
            return
        path, line, column, raw = place
        message = F.when(F.col("_rule_message") != "", F.col("_rule_message")).otherwise(fallback)
        found = met(df, rows, sides).where(F.rlike(path, F.col("_rule_scope")) & holds)
        parts.append(found.select("repo_id", F.col("_rule_rank").alias("rule_rank"), F.col("_rule_id").alias("rule_id"), F.col("_rule_kind").alias("rule_kind"), F.col("_rule_severity").alias("severity"), message.alias("message"), path.alias("file_path"), line.cast("int").alias("line"), column.cast("int").alias("column"), raw.alias("raw_import"), none.alias("details")))

    free: Callable[..., Column] = lambda *columns: ~reduce(lambda a, b: a | b, (F.rlike(c, F.col("_rule_excepted")) for c in columns))
    source, resolved, raw, path, file = (F.col(c) for c in ("source_file", "resolved_path", "raw_import", "path", "file"))
    place = (source, F.col("line"), F.col("column"), raw)
    local = imports.where("not is_package and resolved_path is not null and resolved_path <> ''")
    scan("imports", local, {"scope": [source], "target": [resolved]}, free(source, resolved) & F.rlike(resolved, F.col("_rule_target_glob")), place, F.concat("source_file", F.lit(" imports "), "resolved_path"))
    bought = imports.where("is_package").withColumns({"_package": package_id(raw), "_raw": cleaned(raw)}).withColumn("_name", cleaned("_package"))
    named = F.array_contains(F.col("_rule_target"), raw) | F.array_contains(F.col("_rule_target"), F.col("_package")) | F.rlike(F.col("_raw"), F.col("_rule_target_glob")) | F.rlike(F.col("_name"), F.col("_rule_target_glob"))
    scan("packages", bought, {"scope": [source], "target": [F.col("_raw"), F.col("_name"), raw, F.col("_package")]}, free(source, F.col("_raw")) & named, place, F.concat("source_file", F.lit(" imports package "), "raw_import"))
    fits = F.aggregate("_rule_target", F.lit(False), lambda found, p: found | F.rlike(basename(path), p))
    scan("files", files, {"scope": [path]}, free(path) & ~fits, (path, one, one, none), F.concat("path", F.lit(" does not match required file pattern")))
    if constructions is not None:
        places = (file, F.col("line"), F.col("column"), F.col("class_name"))
        scan("constructions", constructions.where("is_resolved and is_service"), {"scope": [file]}, free(file), places, F.concat(F.lit("direct construction of service "), "class_name", F.lit(" outside composition root")))
    cyclic = [(k, x) for k, x in ranked if x.relation() == "cycles"]
    if cyclic:
        parts += [policy.cycle_findings(x, k, imports) for k, x in cyclic]
    return policy.once(reduce(DataFrame.unionByName, parts)) if parts else policy.once(policy.no_findings(files))
