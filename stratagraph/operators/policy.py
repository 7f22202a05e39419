"""Policy rules evaluated over files and imports in one scan each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.globs import matches_any
from stratagraph.functions.paths import basename, cleaned, fingerprint, package_id
from stratagraph.operators import graph

NO_IMPORT, NO_PACKAGE, FILE_PATTERN, NO_CYCLE, PATTERN = "no_import", "no_package", "file_pattern", "no_cycle", "pattern"
SEVERITY_RANK = {"warning": 1, "error": 2}


@dataclass
class Rule:
    id: str
    kind: str
    severity: str = "warning"
    scope: list[str] = field(default_factory=list)
    target: list[str] = field(default_factory=list)
    except_: list[str] = field(default_factory=list)
    template: str = ""
    params: dict[str, str] = field(default_factory=dict)
    message: str = ""

    def relation(self) -> str:
        """imports, packages, files, cycles or constructions: what the rule is evaluated over."""
        if self.kind == PATTERN:
            if self.template == "construction_policy":
                return "constructions"
            return self.params.get("relation") or "imports"
        return {NO_IMPORT: "imports", NO_PACKAGE: "packages", FILE_PATTERN: "files", NO_CYCLE: "cycles"}[self.kind]


def regex_dialect(pattern: str) -> str:
    """A pattern of the linear-time dialect in Java's: named groups, and $ as the end of text. What that dialect lacks is an error: look-around, atomic groups, back references, possessive repeats."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            follow = pattern[i + 1 : i + 2]
            if follow.isdigit() or follow == "k":
                raise ValueError(f"back reference in {pattern!r}")
            end = pattern.find("\\E", i) if follow == "Q" else -1
            end = len(pattern) if follow == "Q" and end < 0 else end + 2 if follow == "Q" else i + 2
            out.append(pattern[i:end])
            i = end
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" and pattern[i + 1 : i + 2] != ":" else c)
            if c == "[" and pattern[i + 1 : i + 2] == ":":  # a named class such as [:alpha:]
                end = pattern.index(":]", i) + 2
                name = pattern[i + 2 : end - 2].lstrip("^")
                out[-1] = ("\\P{" if pattern[i + 2] == "^" else "\\p{") + {"word": "IsWord"}.get(name, name.capitalize() if name != "xdigit" else "XDigit") + "}"
                i = end
                continue
        elif c == "[":
            in_class = True
            out.append(c)
            start = i + 1 + (pattern[i + 1 : i + 2] == "^")
            out.append(pattern[i + 1 : start])
            if pattern[start : start + 1] == "]":  # a bracket in front stands for itself
                out.append("\\]")
                start += 1
            i = start
            continue
        elif c == "$":
            out.append("\\z")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif re.match(r"\(\?(?:[=!>]|<[=!])", pattern[i:]) or (c == "+" and re.search(r"(?<!\\)[*+?}]$", pattern[:i])):
            raise ValueError(f"not a pattern of the linear-time dialect: {pattern!r}")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _excepted(rule: Rule, *columns: Column) -> Column:
    return reduce(lambda a, b: a | b, (matches_any(c, rule.except_) for c in columns))


def import_predicate(rule: Rule) -> Column:
    source, resolved, raw = F.col("source_file"), F.col("resolved_path"), F.col("raw_import")
    if rule.relation() == "packages":
        package = package_id(raw)
        named = raw.isin(rule.target) | package.isin(rule.target) | matches_any(cleaned(raw), rule.target) | matches_any(cleaned(package), rule.target)
        return F.col("is_package") & matches_any(source, rule.scope) & ~_excepted(rule, source, cleaned(raw)) & named
    local = ~F.col("is_package") & resolved.isNotNull() & (resolved != "")
    return local & matches_any(source, rule.scope) & ~_excepted(rule, source, resolved) & matches_any(resolved, rule.target)


def file_predicate(rule: Rule) -> Column:
    path = F.col("path")
    fits = reduce(lambda a, b: a | b, (basename(path).rlike(regex_dialect(p)) for p in rule.target))
    return matches_any(path, rule.scope) & ~_excepted(rule, path) & ~fits


def _finding(rule: Rule, rank: int, path: Column, line: Column, column: Column, raw: Column, details: Column, fallback: Column) -> Column:
    return F.struct(
        F.lit(rank).alias("rule_rank"), F.lit(rule.id).alias("rule_id"), F.lit(rule.kind).alias("rule_kind"), F.lit(rule.severity).alias("severity"), (F.lit(rule.message) if rule.message else fallback).alias("message"),
        path.alias("file_path"), line.cast("int").alias("line"), column.cast("int").alias("column"), raw.alias("raw_import"), details.cast("string").alias("details"),
    )


def _scan(df: DataFrame, found: list[tuple[Column, Column]]) -> DataFrame:
    """One scan for all rules: the rules that hold for a row become rows."""
    hits = F.filter(F.array(*(F.when(p, f) for p, f in found)), lambda x: x.isNotNull())
    return df.select("repo_id", F.explode(hits).alias("f")).select("repo_id", "f.*")


def evaluate(rules: list[Rule], files: DataFrame, imports: DataFrame, constructions: DataFrame | None = None) -> DataFrame:
    """All findings, once for each fingerprint, without order or limit."""
    one, none = F.lit(1), F.lit("")
    parts: list[DataFrame] = []
    ranked = list(enumerate(rules))
    said = {"imports": F.concat("source_file", F.lit(" imports "), "resolved_path"), "packages": F.concat("source_file", F.lit(" imports package "), "raw_import")}
    over = [(import_predicate(r), _finding(r, k, F.col("source_file"), F.col("line"), F.col("column"), F.col("raw_import"), none, said[r.relation()])) for k, r in ranked if r.relation() in said]
    if over:
        parts.append(_scan(imports, over))
    over = [(file_predicate(r), _finding(r, k, F.col("path"), one, one, none, none, F.concat("path", F.lit(" does not match required file pattern")))) for k, r in ranked if r.relation() == "files"]
    if over:
        parts.append(_scan(files, over))
    over = [(F.col("is_resolved") & F.col("is_service") & matches_any(F.col("file"), r.scope) & ~_excepted(r, F.col("file")), _finding(r, k, F.col("file"), F.col("line"), F.col("column"), F.col("class_name"), none, F.concat(F.lit("direct construction of service "), "class_name", F.lit(" outside composition root")))) for k, r in ranked if r.relation() == "constructions"]
    if over and constructions is not None:
        parts.append(_scan(constructions, over))
    for k, r in ranked:
        if r.relation() == "cycles":
            parts.append(cycle_findings(r, k, imports))
    return once(reduce(DataFrame.unionByName, parts))


def cycle_findings(rule: Rule, rank: int, imports: DataFrame) -> DataFrame:
    """Findings of a rule over cycles, among the directories that it covers."""
    one, none = F.lit(1), F.lit("")
    inside = matches_any(F.col("src"), rule.scope) & matches_any(F.col("dst"), rule.scope) & ~_excepted(rule, F.col("src"), F.col("dst"))
    c = graph.cycles(graph.edges(imports).where(inside))
    return _scan(c, [(F.lit(True), _finding(rule, rank, F.col("first"), one, one, none, F.col("chain"), F.concat(F.lit("dependency cycle detected: "), "chain")))])


def no_findings(files: DataFrame) -> DataFrame:
    """Findings of no rule at all."""
    nothing = Rule("", FILE_PATTERN)
    return _scan(files.where(F.lit(False)), [(F.lit(True), _finding(nothing, 0, F.col("path"), F.lit(1), F.lit(1), F.lit(""), F.lit(""), F.lit("")))])


def once(rows: DataFrame) -> DataFrame:
    """Findings, of those with one fingerprint the first."""
    rows = rows.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line"), F.col("column"), F.col("raw_import"), F.col("details")))
    every = [c for c in rows.columns if c not in ("fingerprint", "repo_id")]
    first = rows.groupBy("repo_id", "fingerprint").agg(F.min(F.struct(*every)).alias("f"))
    return first.select("repo_id", "f.rule_id", "f.rule_kind", "f.severity", "f.message", "f.file_path", "f.line", "f.column", "f.raw_import", "fingerprint", "f.details")


ORDER = ("severity", "rule_id", "file_path", "line", "column", "fingerprint")


def ordered(findings: DataFrame, limit: int = 0) -> DataFrame:
    """Errors first, then by rule and place; limit 0 keeps all."""
    out = findings.orderBy(*ORDER)
    return out.limit(limit) if limit > 0 else out


def summary(findings: DataFrame, files: DataFrame, imports: DataFrame, parse_errors: int = 0, files_skipped: int = 0) -> DataFrame:
    """One row a repository: files and imports scanned, findings by severity, and what could not be read."""
    n = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    f = findings.groupBy("repo_id").agg(F.count(F.lit(1)).alias("findings_total"), F.count_if(F.col("severity") == "error").alias("findings_error"), F.count_if(F.col("severity") == "warning").alias("findings_warning"))
    d = n(files, "files_scanned").join(n(imports, "imports_scanned"), "repo_id", "full").join(f, "repo_id", "full").fillna(0)
    return d.select("repo_id", "files_scanned", "imports_scanned", "findings_total", "findings_error", "findings_warning", F.lit(parse_errors).cast("long").alias("parse_errors"), F.lit(files_skipped).cast("long").alias("files_skipped"))


def exit_code(findings: DataFrame, threshold: str = "error", parse_errors: int = 0, parse_policy: str = "warn") -> int:
    """2 for parse errors under the policy 'error', 1 for a finding of the threshold or above, else 0."""
    if parse_errors and parse_policy == "error":
        return 2
    least = SEVERITY_RANK[threshold]
    return int(not findings.where(F.col("severity").isin([s for s, r in SEVERITY_RANK.items() if r >= least])).isEmpty())


def changed_only(files: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    return files.join(changed.select("repo_id", F.col("path").alias(key)), ["repo_id", key], "left_semi")
