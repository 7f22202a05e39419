"""Import resolution as a ranked equi-join with all entries of a repository.

An import is turned into candidate paths by its form; each path is tried as it
stands and, unless its extension is known, with the extensions in order and then
as a directory's index file. The first candidate that exists is the resolved
path. A local import that meets nothing is unresolved, not a package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.paths import cleaned, directory
from stratagraph.operators.aliases import aliased_paths

# Extensions in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".php")


def beside(folder: Column, raw: Column) -> Column:
    return cleaned(F.concat(folder, F.lit("/"), raw))


def named(imports: DataFrame) -> DataFrame:
    """imports with raw, php (whether a PHP file imports), near (whether what lies beside that file is tried first), and rooted: the path from the root that the import itself names, null if none."""
    raw, bare = F.col("raw"), lambda c: F.regexp_replace(c, "^/+", "")
    php_file = raw.contains("/") & F.lower(raw).endswith(".php") & ~raw.startswith("@") & ~raw.startswith("/") & F.col("php")
    rooted = F.when(raw.startswith("/"), bare(raw)).when(raw.startswith(".") | (raw.startswith("@") & F.col("php")), F.lit(None)).when(F.col("near"), raw).when(raw.contains("\\"), bare(F.replace(raw, F.lit("\\"), F.lit("/"))))
    told = imports.withColumns({"raw": F.trim("raw_import"), "php": F.lower("source_file").rlike(r"\.(php|phtml)$")})
    return told.withColumn("near", raw.startswith(".") | php_file).withColumn("rooted", rooted).withColumn("rooted", cleaned("rooted"))


def candidate_paths(aliased: Column, near: Column) -> Column:
    """Paths to try of what named gives, in order, before extensions; aliased are those that aliases give, near what lies beside the file."""
    local = F.col("raw").startswith(".") | F.col("raw").startswith("/")
    other = F.when(local, F.array().cast("array<string>")).otherwise(F.transform(aliased, lambda p: cleaned(p)))
    return F.concat(other, F.array_compact(F.array(near, "rooted")))


def stems(entries: DataFrame) -> DataFrame:
    """(repo_id, stem, found): for each path before extensions that meets an entry, the entry that is met first.

    An entry is met by itself and by what it has before an extension, or before /index and
    one, so it makes at most three rows, whatever the number of extensions tried.
    """
    path, known = F.col("path"), r"\.(ts|tsx|js|jsx|mjs|cjs|php)$"
    ends = ["", *EXTENSIONS, *("/index" + e for e in EXTENSIONS)]
    met = [F.when(path.endswith(e), F.struct(F.lit(k).alias("rank"), F.substring(path, F.lit(1), F.char_length(path) - len(e)).alias("stem"))) for k, e in enumerate(ends)]
    every = entries.select("repo_id", "path", F.inline(F.array(*met))).where((F.col("rank") == 0) | ~F.col("stem").rlike(known))
    return every.groupBy("repo_id", "stem").agg(F.min_by("path", "rank").alias("found"))


def top_directories(entries: DataFrame) -> DataFrame:
    return entries.where("path like '%/%'").select("repo_id", F.substring_index("path", "/", 1).alias("top")).distinct().where("top <> 'vendor'")


def first_segment() -> Column:
    return F.substring_index(F.regexp_replace(F.replace("raw", F.lit("\\"), F.lit("/")), "^/+", ""), "/", 1)


def is_local(in_top: Column) -> Column:
    """Whether an import that meets nothing is unresolved, not a package; in_top: whether its first segment is a directory of the root."""
    raw = F.col("raw")
    of_php = raw.startswith("@") | (raw.contains("/") & F.lower(raw).endswith(".php")) | raw.rlike("^[A-Za-z0-9_]+$")
    return raw.startswith(".") | raw.startswith("/") | (raw.contains("\\") & in_top) | (F.col("php") & of_php)


def resolve_imports(imports: DataFrame, entries: DataFrame, aliases: DataFrame | None = None, by_place: bool = True) -> DataFrame:
    """imports with resolved_path (null if none) and is_package; entries are all files (repo_id, path) under the root, aliases rows of aliases.aliases.

    Without by_place nothing beside the importing file is met, so the result holds for every
    file of its kind; found_beside tells the rest.
    """
    key = ["repo_id", "source_file", "raw_import"]
    distinct = imports.select(*key).distinct()
    none = F.array().cast("array<string>")
    if aliases is None:
        every, aliased = distinct, none
    else:
        every, aliased = distinct.join(aliased_paths(distinct, aliases), key, "left"), F.coalesce("aliased", none)
    near = F.when(F.col("near"), beside(directory("source_file"), F.col("raw"))) if by_place else F.lit(None).cast("string")
    every = named(every).withColumn("beside", near).select(*key, F.posexplode(candidate_paths(aliased, F.col("beside"))).alias("rank", "stem"))
    met = every.join(stems(entries), ["repo_id", "stem"]).groupBy(*key).agg(F.min_by("found", "rank").alias("resolved_path"))
    tops = entries.where("path like '%/%'").select("repo_id", F.substring_index("path", "/", 1).alias("top")).distinct().where("top <> 'vendor'").withColumn("is_top", F.lit(True))
    first = F.substring_index(F.regexp_replace(F.replace("raw", F.lit("\\"), F.lit("/")), "^/+", ""), "/", 1)
    d = named(distinct).select(*key, "raw", "php", "near", first.alias("top")).join(tops, ["repo_id", "top"], "left").join(met, key, "left")
    raw, php = F.col("raw"), F.col("php")
    local = F.col("near") | raw.startswith("/") | (php & raw.startswith("@")) | (php & raw.rlike("^[A-Za-z0-9_]+$")) | (raw.contains("\\") & F.coalesce("is_top", F.lit(False)))
    d = d.select(*key, "resolved_path", (F.col("resolved_path").isNull() & ~local).alias("is_package"))
    return imports.drop("resolved_path", "is_package").join(d, key)


def found_beside(imports: DataFrame, entries: DataFrame, group: str) -> DataFrame:
    """(group, held): what the near imports of a group find beside their files, as a map from the paths they name.

    imports: (group, repo_id, source_file, raw_import). Where they are dealt by group, only
    distinct names leave their partitions. One file stands for all of its directory and kind.
    """
    near = named(imports).where("near")
    names = near.select(group, "repo_id", beside(directory("source_file"), F.col("raw")).alias("stem")).distinct()
    met = names.join(stems(entries), ["repo_id", "stem"])
    return met.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("stem", "found"))).alias("held"))
