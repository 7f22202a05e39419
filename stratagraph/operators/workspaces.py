"""Workspace roots of repositories, from their manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.paths import basename, directory

DEPTH = 6
# The patterns of repositories that only have a task runner's file.
DEFAULT = ("apps/*", "packages/*")


def _cleaned(patterns: Column) -> Column:
    p = F.transform(patterns, lambda x: F.regexp_replace(F.replace(F.trim(x), F.lit("\\"), F.lit("/")), r"^(?:\./)+|/+$", ""))
    return F.filter(p, lambda x: x != "")


def workspace_patterns(entries: DataFrame) -> DataFrame:
    """(repo_id, pattern) of the root package.json, else of pnpm's file, else the default beside nx.json or turbo.json.

    entries: (repo_id, path, text); text is needed of those files only. Manifests that are no JSON name nothing.
    """
    text = lambda name: F.max(F.when(F.col("path") == name, F.col("text")))
    roots = entries.where(F.col("path").isin("package.json", "pnpm-workspace.yaml", "nx.json", "turbo.json")).groupBy("repo_id").agg(text("package.json").alias("npm"), text("pnpm-workspace.yaml").alias("pnpm"), F.bool_or(F.col("path").isin("nx.json", "turbo.json")).alias("runner"))
    named = F.get_json_object("npm", "$.workspaces")
    npm = _cleaned(F.from_json(F.when(named.startswith("["), named).otherwise(F.get_json_object("npm", "$.workspaces.packages")), "array<string>"))
    pnpm = _cleaned(F.transform(F.regexp_extract_all("pnpm", F.lit(r"(?m)^\s*-([^\r\n]*)"), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", "")))
    chosen = F.when(F.size(npm) > 0, npm).when(F.size(pnpm) > 0, pnpm).when(F.col("runner"), F.array(*map(F.lit, DEFAULT)))
    return roots.select("repo_id", F.explode(chosen).alias("pattern")).distinct()


def _regex(pattern: Column) -> Column:
    """The regular expression of a pattern column; ** stands for up to DEPTH segments."""
    p = F.regexp_replace(pattern, r"([.+()|\[\]{}^$])", r"\\$1")
    for plain, rx in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", f"(\x03:[^/]+/){{0,{DEPTH - 1}}}"), ("\x02", f"(\x03:[^/]+/){{0,{DEPTH - 1}}}[^/]+"), ("\x03", "?")):
        p = F.replace(p, F.lit(plain), F.lit(rx))
    return F.concat(F.lit("^"), p, F.lit("$"))


def workspace_roots(entries: DataFrame) -> DataFrame:
    """(repo_id, workspace): directories with a package.json that a pattern of their repository matches; none in node_modules."""
    held = entries.where((basename("path") == "package.json") & ~F.concat(F.lit("/"), "path").contains("/node_modules/")).select("repo_id", directory("path").alias("workspace")).where("workspace <> '.'").distinct()
    p = workspace_patterns(entries).withColumn("rx", _regex(F.col("pattern")))
    return held.join(p, "repo_id").where("workspace rlike rx").select("repo_id", "workspace").distinct()
