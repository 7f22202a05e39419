"""Known boundaries matched against mined candidates: every pattern in one scan, the best match of each rule kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions.globs import matches_any
from stratagraph.functions.paths import effective_support, naming_score, prevalence_support, score_confidence, weighted_score
from stratagraph.operators.constructions import construction_match


@dataclass(frozen=True)
class Boundary:
    """Sources that should not depend on targets; kind is the candidates' kind."""

    id: str
    name: str
    category: str
    description: str
    kind: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    max_prevalence: float = 0.02
    min_support: int = 20
    severity: str = "warning"


# The built-in boundaries.
BOUNDARIES = (
    Boundary("CAT-DOMAIN-NO-HTTP-CLIENTS", "Domain avoids transport clients", "dependency", "Domain code should avoid direct dependencies on HTTP client packages.", "no_package", ("**/domain/**",), ("axios", "got", "node-fetch", "undici", "@aws-sdk/**")),
    Boundary("CAT-LAYERED-APP-INFRA", "Layered: app avoids direct infra access", "layering", "Application services should avoid direct infrastructure coupling where architectural boundaries exist.", "no_import", ("**/app/**", "**/application/**"), ("**/infra/**",), 0.03),
    Boundary("CAT-LAYERED-DOMAIN-INFRA", "Layered: domain avoids infra", "layering", "Domain layer should not depend directly on infrastructure layer.", "no_import", ("**/domain/**",), ("**/infra/**",)),
    Boundary("CAT-LAYERED-UI-DOMAIN", "Layered: ui avoids domain internals", "layering", "UI layer should use application-facing APIs instead of importing domain internals directly.", "no_import", ("**/ui/**",), ("**/domain/**",)),
)


@dataclass(frozen=True)
class Construction:
    """Classes that should be constructed in composition roots only."""

    id: str
    name: str
    category: str
    description: str
    scope: tuple[str, ...]
    services: tuple[str, ...]
    allowed: tuple[str, ...]
    name_regex: str = ".*Service$"
    max_prevalence: float = 0.02
    min_support: int = 20
    severity: str = "warning"


# The built-in construction pattern.
CONSTRUCTIONS = (
    Construction("CAT-SERVICES-VIA-COMPOSITION-ROOT", "Services are constructed in composition roots", "construction", "Service classes should be instantiated in composition root/bootstrap files rather than across application code.", ("src/**",), ("src/services/**",), ("src/bootstrap/**", "src/di/**", "src/main/**")),
)


def rule_name(pattern_id: Column, *lists: Column) -> Column:
    """The id of the rule that a pattern proposes: the pattern's name and a hash of its lists."""
    plain = F.regexp_replace(F.replace(F.replace(F.upper(pattern_id), F.lit("CAT-"), F.lit("")), F.lit("_"), F.lit("-")), "[^A-Z0-9-]", "")
    return F.concat(F.lit("AG-CAT-"), plain, F.lit("-"), F.substring(F.sha1(F.concat_ws("|", *lists)), 1, 8))


def construction_matches(constructions_: DataFrame, files: DataFrame, pattern: Construction = CONSTRUCTIONS[0], show_low: bool = False) -> DataFrame:
    """One row for each repository with files in the pattern's scope: how often services are constructed outside the roots, with the proposed rule."""
    m = construction_match(constructions_, files, list(pattern.scope), list(pattern.allowed), pattern.min_support)
    text = F.concat("violating_files", F.lit("/"), "eligible_files", F.lit(" eligible files instantiate service classes ("), "events", F.lit(" events, resolved="), "resolved_count", F.lit(" unresolved="), "unresolved_count", F.lit(")"))
    shown = F.coalesce(F.array_join("resolved_examples", ", "), F.lit(""))
    lists = [F.lit(",".join(x)) for x in (pattern.scope, pattern.services, pattern.allowed)]
    m = m.select(
        "repo_id", F.lit(pattern.id).alias("catalog_id"), F.lit(pattern.name).alias("name"), F.lit(pattern.category).alias("category"), "score", "confidence", F.concat(text, F.when(shown != "", F.concat(F.lit("; examples: "), shown)).otherwise("")).alias("evidence"),
        "scoped_files", "eligible_files", "violating_files", F.col("eligible_files").alias("support"), "prevalence", "structural_fit", "prevalence_support", "naming_fit", "resolved_count", "unresolved_count", "sample_locations", "resolved_examples", "unresolved_reasons",
        rule_name(F.lit(pattern.id), *lists).alias("proposed_rule_id"), F.lit(pattern.severity).alias("rule_severity"), F.lit(f"[derived_from_catalog={pattern.id}] {pattern.description}").alias("message"),
    )
    return m if show_low else m.where("confidence <> 'LOW'")


SHARED = ["repo_id", "catalog_id", "name", "category", "score", "confidence", "evidence", "scoped_files", "eligible_files", "violating_files", "support", "prevalence", "structural_fit", "prevalence_support", "naming_fit"]
SHARED += ["resolved_count", "unresolved_count", "sample_locations", "resolved_examples", "unresolved_reasons", "proposed_rule_id", "rule_severity", "message", "rule"]


def _rule(template: str, scope: Column, target: Column, except_: Column, params: Column) -> Column:
    """The proposed rule in full; params are in order of name."""
    return F.struct(F.col("proposed_rule_id").alias("id"), F.lit("pattern").alias("kind"), F.col("rule_severity").alias("severity"), F.lit(template).alias("template"), scope.alias("scope"), target.alias("target"), except_.alias("except"), params.alias("params"), F.col("message").alias("message"))


def rule_signature(rule: Column) -> Column:
    """What two rules share when they say the same."""
    listed = lambda c: F.array_join(F.sort_array(c), ",")
    params = F.transform(F.map_entries(rule["params"]), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return F.concat_ws("|", rule["kind"], rule["template"], rule["severity"], listed(rule["scope"]), listed(rule["target"]), listed(rule["except"]), listed(params))


def all_matches(candidates: DataFrame, constructions_: DataFrame, files: DataFrame, boundaries: tuple[Boundary, ...] = BOUNDARIES, pattern: Construction = CONSTRUCTIONS[0], show_low: bool = False) -> DataFrame:
    """Matches of every built-in pattern, whatever it is matched against, with the proposed rules; of those that say the same the one of best score."""
    none = F.array().cast("array<string>")
    b = boundary_matches(candidates, boundaries, True).withColumn("proposed_rule_id", rule_name(F.col("catalog_id"), F.col("scope"), F.col("target")))
    b = b.withColumn("rule", _rule("dependency_constraint", F.array("scope"), F.array("target"), none, F.create_map(F.lit("relation"), F.col("relation"))))
    b = b.withColumns({"scoped_files": F.col("support"), "eligible_files": F.col("support"), "violating_files": F.col("violations"), "resolved_count": F.lit(0).cast("long"), "unresolved_count": F.lit(0).cast("long"), "sample_locations": none, "resolved_examples": none, "unresolved_reasons": F.array().cast("array<struct<reason:string,count:bigint>>")})
    c = construction_matches(constructions_, files, pattern, True)
    lists = [F.array(*map(F.lit, x)) if x else none for x in (pattern.scope, pattern.services, pattern.allowed)]
    c = c.withColumn("rule", _rule("construction_policy", *lists, F.create_map(F.lit("service_name_regex"), F.lit(pattern.name_regex))))
    m = b.select(*SHARED).unionByName(c.select(*SHARED))
    same = Window.partitionBy("repo_id", rule_signature(F.col("rule"))).orderBy(F.desc("score"), "catalog_id")
    m = m.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return m if show_low else m.where("confidence <> 'LOW'")


def boundary_matches(candidates: DataFrame, boundaries: tuple[Boundary, ...] = BOUNDARIES, show_low: bool = False) -> DataFrame:
    """Candidates that a boundary describes, with scores and the proposed relation.

    Scope and target globs of a candidate are matched as though they were paths.
    Of matches that propose the same rule the best score stays, ties go to the
    smaller catalog_id; matches of LOW confidence are hidden unless show_low.
    """
    scope, target = F.col("scope"), F.col("target")
    found = []
    for b in boundaries:
        hit = matches_any(target, list(b.targets)) | (target.isin(*b.targets) if b.kind == "no_package" else F.lit(False))
        support = prevalence_support(F.col("prevalence"), F.col("support"), b.max_prevalence, effective_support(b.min_support, F.col("support")))
        naming = naming_score(scope, target, [*b.sources, *b.targets])
        row = F.struct(
            F.lit(b.id).alias("catalog_id"), F.lit(b.name).alias("name"), F.lit(b.category).alias("category"), F.lit(b.severity).alias("rule_severity"), F.lit("imports" if b.kind == "no_import" else "packages").alias("relation"),
            F.lit(f"[derived_from_catalog={b.id}] {b.description}").alias("message"), F.lit(1.0).alias("structural_fit"), support.alias("prevalence_support"), naming.alias("naming_fit"), weighted_score(F.lit(1.0), support, naming).alias("score"),
        )
        found.append(F.when((F.col("kind") == b.kind) & matches_any(scope, list(b.sources)) & hit, row))
    m = candidates.select("repo_id", "scope", "target", "support", "violations", "prevalence", "evidence", F.explode(F.array_compact(F.array(*found))).alias("m"))
    m = m.select("repo_id", "m.*", "scope", "target", "support", "violations", "prevalence", "evidence")
    rule = Window.partitionBy("repo_id", "rule_severity", "relation", "scope", "target").orderBy(F.desc("score"), "catalog_id")
    m = m.withColumn("_n", F.row_number().over(rule)).where("_n = 1").drop("_n").withColumn("confidence", score_confidence(F.col("score")))
    return m if show_low else m.where("confidence <> 'LOW'")
