"""Paths, package ids, fingerprints and scores as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments whose scopes say little about architecture, and the tokens of naming scores.
LOW_SIGNAL = ("test", "tests", "__tests__", "testing", "fixture", "fixtures", "golden", "example", "examples", "sample", "samples", "benchmark", "benchmarks", "e2e", "compliance", "spec", "specs")
NAMING_TOKENS = ("domain", "infra", "application", "app", "ui", "service", "services", "core")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalised(path: Column | str) -> Column:
    """Forward slashes and no '.', '..' or empty segments; '.' for nothing."""
    p = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    rooted = p.startswith("/")
    segments = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))

    def step(acc: Column, s: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when(s != "..", F.concat(acc, F.array(s))).when(up, F.slice(acc, 1, F.size(acc) - 1)).when(rooted, acc).otherwise(F.concat(acc, F.array(s)))

    # The folded path is named once, as an expression is computed wherever it is named.
    joined = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.regexp_replace(joined, r"\A\z", "."))


def cleaned(path: Column | str) -> Column:
    """normalised, but computed only for paths that need it."""
    p = _col(path)
    return F.when(p.rlike(r"^$|\\|//|/$|(?:^|/)[.]{1,2}(?:/|$)"), normalised(p)).otherwise(p)


def directory(path: Column | str) -> Column:
    """The directory of a path, '.' for a file at the root."""
    d = F.regexp_extract(_col(path), "^(.*)/[^/]*$", 1)
    return F.when(d == "", F.when(_col(path).startswith("/"), F.lit("/")).otherwise(F.lit("."))).otherwise(d)


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """From the first dot of the base name on; null without a dot."""
    base = basename(path)
    return F.when(base.contains("."), F.regexp_extract(base, r"^[^.]*(\..*)$", 1))


def package_id(raw: Column | str) -> Column:
    """The package of an import: scope and name, or the first segment; '' for local paths."""
    t = F.regexp_extract(F.trim(_col(raw)), "^([^?#]*)", 1)
    t = F.trim(F.replace(t, F.lit("\\"), F.lit("/")))
    first = F.regexp_extract(t, "^([^/]*)", 1)
    scoped = F.regexp_extract(t, "^(@[^/]+/[^/]+)", 1)
    return F.when((t == "") | t.startswith(".") | t.startswith("/"), F.lit("")).when(t.startswith("@"), F.when(scoped != "", scoped).otherwise(first)).otherwise(first)


def fingerprint(rule_id: Column, file_path: Column, line: Column, column: Column, raw: Column, details: Column) -> Column:
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha1(F.concat_ws("|", empty(rule_id), empty(file_path), F.concat_ws(":", empty(line), empty(column)), empty(raw), empty(details)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mined_confidence(prevalence: Column, support: Column) -> Column:
    return F.when((prevalence <= 0.01) & (support >= 50), "HIGH").when((prevalence <= 0.02) & (support >= 20), "MEDIUM").otherwise("LOW")


def score_confidence(score: Column) -> Column:
    return F.when(score >= 0.85, "HIGH").when(score >= 0.65, "MEDIUM").otherwise("LOW")


def confidence_rank(c: Column) -> Column:
    return F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).when(c == "LOW", 1).otherwise(0)


def effective_support(configured: int, scoped: Column) -> Column:
    return F.least(F.lit(configured if configured > 0 else 20), F.greatest(F.lit(3), scoped))


def prevalence_support(prevalence: Column, support: Column, max_prevalence: float, least: Column) -> Column:
    s = F.when(least > 0, clamp(support / least, 0.0, 1.0)).otherwise(1.0)
    over = F.lit(0.0) if max_prevalence >= 1 else clamp(1.0 - (prevalence - max_prevalence) / (1.0 - max_prevalence), 0.0, 1.0)
    return (s + F.when(prevalence > max_prevalence, over).otherwise(1.0)) / 2.0


def construction_support(prevalence: Column, support: Column, least: Column) -> Column:
    s = F.when(least > 0, clamp(support / least, 0.0, 1.0)).otherwise(0.0)
    return (s + clamp(prevalence / 0.4, 0.0, 1.0)) / 2.0


def naming_score(scope: Column, target: Column, globs: list[str]) -> Column:
    expected = [t for t in NAMING_TOKENS if any(t in g.lower() for g in globs)]
    if not expected:
        return F.lit(0.6)
    hit = lambda t: (F.lower(scope).contains(t) | F.lower(target).contains(t)).cast("int")
    return reduce(lambda a, b: a + b, map(hit, expected)) / float(len(expected))


def weighted_score(structural: Column, support: Column, naming: Column) -> Column:
    return clamp(0.4 * structural + 0.4 * support + 0.2 * naming, 0.0, 1.0)


def low_signal(scope: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(F.regexp_replace(scope, "^/+|/+$", "")), "/"), F.array(*map(F.lit, LOW_SIGNAL)))


def ecosystem_package(name: Column) -> Column:
    t = F.trim(name)
    return F.when(t == "", False).when(t.startswith("node:"), True).when(t.startswith("@"), t.rlike("^@[^/]+/[^/]+")).otherwise(~t.rlike("[A-Z]"))
