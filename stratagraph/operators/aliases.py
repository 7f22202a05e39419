"""Import aliases of repositories, from their own manifests, as rows.

entries: (repo_id, path, text); text is needed of the manifests only. A manifest
that is no JSON gives nothing. The base of alias targets is the folder that the
configuration names, of the repository's root where there is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.paths import directory, normalised

STRING = r'("(?:[^"\\]++|\\.)*+")'
TSCONFIG = "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"
MANIFEST = "autoload struct<`psr-4`: map<string, string>>, `autoload-dev` struct<`psr-4`: map<string, string>>"


def plain_json(text: Column) -> Column:
    """JSON from JSON with comments, commas before closing brackets and a byte-order mark; strings stay as they are."""
    t = F.regexp_replace(text, "^\ufeff", "")
    t = F.regexp_replace(t, STRING + r"|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)", "$1")
    return F.regexp_replace(t, STRING + r"|,(?=[ \n\r\t]*+[}\]])", "$1")


def joined(base: Column, path: Column) -> Column:
    """path below base, cleaned; absolute paths stay."""
    return F.when(path.startswith("/"), normalised(path)).otherwise(normalised(F.concat(base, F.lit("/"), path)))


def configurations(entries: DataFrame) -> DataFrame:
    """(repo_id, base, paths) of the root tsconfig.json, else jsconfig.json."""
    found = entries.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).groupBy("repo_id").agg(F.max_by("text", "path").alias("text"))
    c = found.select("repo_id", F.from_json(plain_json(F.col("text")), TSCONFIG).alias("c"))
    base = F.coalesce(F.nullif("c.compilerOptions.baseUrl", F.lit("")), F.lit("."))
    return c.where("c is not null").select("repo_id", joined(F.lit("."), base).alias("base"), F.col("c.compilerOptions.paths").alias("paths"))


def namespaces(entries: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """(repo_id, alias, position, target) of the PSR-4 namespaces of composer.json in the root and in the given roots."""
    wanted = ["composer.json", *(f"{r.strip().strip('/')}/composer.json" for r in roots if r.strip() not in ("", "."))]
    m = entries.where(F.col("path").isin(wanted)).select("repo_id", directory("path").alias("at"), F.from_json("text", MANIFEST).alias("m"))
    parts = [m.select("repo_id", "at", F.lit(k).alias("part"), F.explode(F.col("m")[a]["psr-4"]).alias("namespace", "value")) for k, a in enumerate(("autoload", "autoload-dev"))]
    n = reduce(DataFrame.unionByName, parts)
    name = F.trim(F.regexp_replace(F.trim("namespace"), r"\\$", ""))
    every = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    n = n.where(name != "").select("repo_id", "at", "part", F.concat(normalised(name), F.lit("/*")).alias("alias"), F.posexplode(every).alias("k", "target"))
    n = n.where(F.trim("target") != "")
    below = joined(F.col("at"), F.trim("target"))
    target = F.when(below == ".", F.lit("*")).otherwise(F.concat(below, F.lit("/*")))
    return n.select("repo_id", "alias", (F.lit(2_000_000) + F.col("part") * 1000 + F.col("k")).alias("position"), target.alias("target"))


def aliases(entries: DataFrame, configured: DataFrame | None = None, roots: tuple[str, ...] = ()) -> DataFrame:
    """(repo_id, alias, position, target): what an import may stand for; targets are below the repository's root.

    Targets of one alias are tried in order of position: those of the configuration
    file of compilers first, then of packages, then of configured (repo_id, alias, target).
    """
    c = configurations(entries)
    parts = [c.select("repo_id", F.explode("paths").alias("alias", "targets")).select("repo_id", "alias", F.posexplode("targets").alias("position", "target")), namespaces(entries, roots)]
    if configured is not None:
        parts.append(configured.select("repo_id", "alias", F.lit(9_000_000).alias("position"), "target"))
    every = reduce(DataFrame.unionByName, parts).where("alias is not null and target is not null")
    every = every.join(c.select("repo_id", "base"), "repo_id", "left")
    return every.select("repo_id", normalised("alias").alias("alias"), "position", joined(F.coalesce("base", F.lit(".")), F.col("target")).alias("target")).distinct()


def aliased_paths(imports: DataFrame, rows: DataFrame) -> DataFrame:
    """(repo_id, source_file, raw_import, aliased) of the distinct imports that an alias fits: the paths they stand for, longer aliases first, then by name and position.

    An alias fits by what stands before its star, so that is its join key; an import meets
    it with its prefixes, of the lengths that its repository's aliases have. A list holds the
    aliases of one import.
    """
    key = ["repo_id", "source_file", "raw_import"]
    star = F.col("alias").contains("*")
    a = rows.select("repo_id", "alias", "position", "target", star.alias("star"), F.substring_index("alias", "*", 1).alias("head"), F.regexp_extract("alias", r"\*([^*]*)", 1).alias("tail"))
    lengths = a.where("star").groupBy("repo_id").agg(F.collect_set(F.char_length("head")).alias("lengths"))
    r = imports.select(*key, F.regexp_replace(normalised(F.trim("raw_import")), "^/+", "").alias("r")).join(lengths, "repo_id", "left")
    fitting = F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: n <= F.char_length("r"))
    probes = F.concat(F.transform(fitting, lambda n: F.struct(F.substring(F.col("r"), F.lit(1), n).alias("head"), F.lit(True).alias("star"))), F.array(F.struct(F.col("r").alias("head"), F.lit(False).alias("star"))))
    met = r.select(*key, "r", F.inline(probes)).join(a, ["repo_id", "head", "star"]).where(~F.col("star") | F.col("r").endswith(F.col("tail")))
    rest, tail = F.substring(F.col("r"), F.char_length("head") + 1, F.char_length("r")), F.col("tail")
    middle = F.when(F.length(tail) == 0, rest).when(rest.endswith(tail), F.substring(rest, F.lit(1), F.char_length(rest) - F.char_length(tail))).otherwise(rest)
    target = F.col("target")
    value = F.when(~F.col("star"), target).when(target.contains("*"), F.replace(target, F.lit("*"), middle)).when(middle != "", F.concat(target, F.lit("/"), middle)).otherwise(target)
    order = F.struct((-F.length("alias")).alias("size"), "alias", "position", "target", value.alias("value"))
    found = met.groupBy(*key).agg(F.sort_array(F.collect_list(order)).alias("found"))
    return found.select(*key, F.transform("found", lambda x: x["value"]).alias("aliased"))
