"""Findings and candidates in report formats, a row for each result, so that reports are written by Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ADOPTED = {"high": ("HIGH",), "medium": ("HIGH", "MEDIUM")}


def _some(c: str) -> Column:
    """Null for empty strings, which JSON then leaves out."""
    return F.when(F.col(c) != "", F.col(c)).alias(c)


def json_findings(findings: DataFrame) -> DataFrame:
    """(repo_id, fingerprint, json); raw_import and details are left out when empty."""
    fields = ["rule_id", "rule_kind", "severity", "message", "file_path", "line", "column"]
    return findings.select("repo_id", "fingerprint", F.to_json(F.struct(*fields, _some("raw_import"), "fingerprint", _some("details"))).alias("json"))


def text_findings(findings: DataFrame) -> DataFrame:
    """(repo_id, heading, file_path, line, column, text): lines below the heading of their rule, to be ordered by these columns."""
    place = F.concat_ws(":", "file_path", "line", "column")
    shown = lambda before, c, after: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    text = F.concat(F.lit("  - "), place, F.lit(" "), "message", shown(" (import: ", "raw_import", ")"), shown(" [", "details", "]"))
    return findings.select("repo_id", F.concat("rule_id", F.lit(" ("), "severity", F.lit(")")).alias("heading"), "file_path", "line", "column", text.alias("text"))


def text_summary(summary: DataFrame) -> DataFrame:
    """(repo_id, text): the closing line of a text report."""
    shown = {"files": "files_scanned", "imports": "imports_scanned", "findings": "findings_total"}
    line = [F.concat(F.lit(f"{k}="), v) for k, v in shown.items()]
    line.append(F.concat(F.lit("(error="), "findings_error", F.lit(" warning="), "findings_warning", F.lit(")")))
    line += [F.concat(F.lit(f"{k}="), k) for k in ("parse_errors", "files_skipped")]
    return summary.select("repo_id", F.concat(F.lit("Summary: "), F.concat_ws(" ", *line)).alias("text"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(repo_id, rule_id, json): a rule with its kind as description and the message of its first finding as help."""
    first = F.struct("severity", "file_path", "line", "column", "fingerprint")
    r = findings.groupBy("repo_id", "rule_id").agg(F.min_by("message", first).alias("message"), F.min_by("rule_kind", first).alias("rule_kind"))
    return r.select("repo_id", "rule_id", F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("rule_kind").alias("text")).alias("shortDescription"), F.when(F.trim("message") != "", F.struct(F.trim("message").alias("markdown"))).alias("help"))).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(repo_id, fingerprint, json): results of SARIF 2.1.0; lines and columns are 1 at least."""
    least = lambda c: F.greatest(F.lit(1), F.col(c))
    region = F.struct(least("line").alias("startLine"), least("column").alias("startColumn"))
    where = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.when(F.lower("severity") == "error", "error").otherwise("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(where).alias("locations"), F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints"),
    )
    return findings.select("repo_id", "fingerprint", F.to_json(result).alias("json"))


def mined_rules(candidates: DataFrame, no_cycle_severity: str = "warning") -> DataFrame:
    """Candidates as numbered rules of a configuration, in order of kind, scope and target for each repository: id and the rule's YAML block."""
    word = no_cycle_severity.strip().lower()
    word = word if word in ("error", "warning") else "warning"
    w = Window.partitionBy("repo_id").orderBy("kind", "scope", "target")
    c = candidates.withColumn("id", F.concat(F.lit("MINED-"), F.lpad(F.row_number().over(w).cast("string"), 3, "0")))
    severity = F.when(F.col("kind") == "no_cycle", word).otherwise(F.col("severity"))
    lines = [_line("  - id: ", F.col("id")), _line("    kind: ", F.col("kind")), _line("    severity: ", severity), F.lit("    scope:"), _line("      - ", quoted(F.col("scope")))]
    lines += [F.when(F.coalesce("target", F.lit("")) != "", F.concat(F.lit("    target:\n      - "), quoted(F.col("target")))), _line("    message: ", quoted(F.col("evidence")))]
    return c.withColumn("yaml", F.concat_ws("\n", *lines))


def _line(name: str, c: Column) -> Column:
    return F.concat(F.lit(name), c)


# Fixed: characters that have an escape of their own, and the others that are escaped by number.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r", "\a": "\\a", "\b": "\\b", "\f": "\\f", "\v": "\\v"} | {chr(n): f"\\x{n:02x}" for n in [*range(7), *range(14, 32), 127]}


def quoted(c: Column) -> Column:
    """A string in double quotes, with backslashes, quotes and control characters escaped."""
    plain = c.rlike("^[^\\x00-\\x1f\\x7f\"\\\\]*+$")
    every = c
    for raw, escaped in ESCAPES.items():
        every = F.replace(every, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(every), F.lit('"'))


def json_candidates(candidates: DataFrame) -> DataFrame:
    """(repo_id, kind, scope, target, json): a mined candidate as JSON; scope and target are lists."""
    some = F.when(F.coalesce("target", F.lit("")) != "", F.array("target"))
    fields = F.struct("kind", F.array("scope").alias("scope"), some.alias("target"), "severity", "support", "violations", "prevalence", "confidence", "evidence")
    return candidates.select("repo_id", "kind", "scope", "target", F.to_json(fields).alias("json"))


def adopted(scored: DataFrame, threshold: str = "high") -> DataFrame:
    """Matches of enough confidence; an unknown threshold counts as high."""
    return scored.where(F.col("confidence").isin(*ADOPTED.get(threshold.strip().lower(), ADOPTED["high"])))


# Fixed: what a starter configuration begins with.
HEADER = """version: 1
project:
  roots: ["."]
  include: ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.mjs", "**/*.cjs"]
  exclude: ["**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/coverage/**", "**/.git/**"]
rules:"""


def adopted_rules(matches: DataFrame) -> DataFrame:
    """(repo_id, id, yaml): the proposed rules of matches as blocks of a configuration."""
    rule = F.col("rule")
    listed = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"    {name}:\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("      - "), quoted(x))), "\n")))
    entries = F.transform(F.sort_array(F.map_entries(rule["params"])), lambda p: F.concat(F.lit("      "), p["key"], F.lit(": "), quoted(p["value"])))
    lines = [_line("  - id: ", rule["id"]), _line("    kind: ", rule["kind"]), _line("    severity: ", rule["severity"]), F.when(rule["template"] != "", _line("    template: ", rule["template"]))]
    scope = F.concat(F.lit("    scope:"), F.array_join(F.transform(rule["scope"], lambda x: F.concat(F.lit("\n      - "), quoted(x))), ""))
    lines += [scope, listed("target", rule["target"]), listed("except", rule["except"]), F.when(F.size(entries) > 0, F.concat(F.lit("    params:\n"), F.array_join(entries, "\n")))]
    lines += [F.when(rule["message"] != "", _line("    message: ", quoted(rule["message"])))]
    return matches.select("repo_id", rule["id"].alias("id"), F.concat_ws("\n", *lines).alias("yaml"))


def emitted_config(candidates: DataFrame, matches: DataFrame, threshold: str = "high", no_cycle_severity: str = "warning") -> DataFrame:
    """(repo_id, part, id, yaml): the blocks of each repository's starter configuration, to be read in order of part and id: the header, the mined rules, and the adopted ones."""
    mined = mined_rules(candidates, no_cycle_severity).select("repo_id", F.lit(1).alias("part"), "id", "yaml")
    taken = adopted_rules(adopted(matches, threshold)).select("repo_id", F.lit(2).alias("part"), "id", "yaml")
    heads = candidates.select("repo_id").union(matches.select("repo_id")).distinct().select("repo_id", F.lit(0).alias("part"), F.lit("").alias("id"), F.lit(HEADER).alias("yaml"))
    return heads.unionByName(mined).unionByName(taken)


def json_matches(matches: DataFrame) -> DataFrame:
    """(repo_id, catalog_id, proposed_rule_id, json): a match of the catalog as JSON; what is empty is left out, but for the rule's lists, which are null."""
    count = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    rule = F.col("rule")
    full = lambda c: F.when(F.size(rule[c]) > 0, rule[c])
    proposed = F.struct(rule["id"].alias("ID"), rule["kind"].alias("Kind"), rule["severity"].alias("Severity"), full("scope").alias("Scope"), full("target").alias("Target"), full("except").alias("Except"), rule["template"].alias("Template"), full("params").alias("Params"), rule["message"].alias("Message"))
    parts = F.struct("structural_fit", "prevalence_support", "naming_fit")
    first = F.struct("catalog_id", "name", "category", "score", "confidence", "evidence", "scoped_files", "eligible_files", "violating_files", "support", "prevalence", parts.alias("score_components"), count("resolved_count"), count("unresolved_count"), some("sample_locations"), some("resolved_examples"), some("unresolved_reasons"))
    joined = F.concat(F.regexp_replace(F.to_json(first), r"\}$", ',"proposed_rule":'), F.to_json(proposed, {"ignoreNullFields": "false"}), F.lit("}"))
    return matches.select("repo_id", "catalog_id", "proposed_rule_id", joined.alias("json"))


def text_matches(matches: DataFrame, debug: bool = False) -> DataFrame:
    """(repo_id, catalog_id, proposed_rule_id, block): a match of the catalog as text, with figures if debug."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    listed = lambda c, each=lambda x: x: F.concat(F.lit("["), F.array_join(F.transform(c, each), " "), F.lit("]"))
    shown = [line(c, F.col(c)) for c in ("catalog_id", "name", "category")] + [line("score", F.format_string("%.3f", "score"))] + [line(c, F.col(c)) for c in ("confidence", "evidence", "proposed_rule_id")]
    if debug:
        both = (F.col("resolved_count") > 0) | (F.col("unresolved_count") > 0)
        shown += [line(c, F.col(c)) for c in ("scoped_files", "eligible_files", "violating_files", "support")] + [line("prevalence", F.format_string("%.4f", "prevalence"))]
        shown += [F.format_string("score_components: structural_fit=%.3f prevalence_support=%.3f naming_fit=%.3f", "structural_fit", "prevalence_support", "naming_fit")]
        shown += [F.when(both, line(c, F.col(c))) for c in ("resolved_count", "unresolved_count")] + [F.when(F.size(c) > 0, line(c, listed(c))) for c in ("resolved_examples", "sample_locations")]
        shown += [F.when(F.size("unresolved_reasons") > 0, line("unresolved_reasons", listed("unresolved_reasons", lambda x: F.concat(F.lit("{"), x["reason"], F.lit(" "), x["count"], F.lit("}")))))]
    return matches.select("repo_id", "catalog_id", "proposed_rule_id", F.concat_ws("\n", *shown).alias("block"))


def in_workspaces(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """files (repo_id, path) with each workspace they lie in, nested ones too; workspaces are (repo_id, root).

    The ancestors of a path are its join keys, so that this is an equi-join and not a comparison with every root.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    every = files.withColumn("root", F.explode(F.array_union(F.array(F.lit(".")), above)))
    return every.join(workspaces.select("repo_id", "root").distinct(), ["repo_id", "root"])


def text_candidates(candidates: DataFrame) -> DataFrame:
    """One text block for each candidate of mining."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    listed = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    shown = [line("kind", F.col("kind")), line("scope", listed(F.col("scope"))), F.when(F.coalesce("target", F.lit("")) != "", line("target", listed(F.col("target")))), line("severity", F.col("severity")), line("support", F.col("support")), line("violations", F.col("violations"))]
    shown += [line("prevalence", F.format_string("%.4f", "prevalence")), line("confidence", F.col("confidence")), line("evidence", F.col("evidence"))]
    return candidates.select("repo_id", "kind", "scope", "target", F.concat_ws("\n", *shown).alias("block"))
