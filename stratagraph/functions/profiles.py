"""Framework profiles: paths that differ only by a route parameter or a platform get one name; all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions.paths import basename, directory, normalised

# For each profile, (pattern, replacement) of whole directory segments and of base names.
SEGMENTS = {
    "angular": [("^:.*$", "[param]")],
    "nextjs": [("^@.+$", "@slot"), (r"^\(.*\)$", "(group)"), (r"^\[.*\]$", "[param]")],
    "react": [("^__tests__$", "tests"), ("^__mocks__$", "mocks")],
    "react_native": [],
    "react_router": [("^_index$", "index"), ("^[:$].*$", "[param]"), (r"^\[.*\]$", "[param]")],
}
NAMES = {
    "angular": [("([-.])routing", "$1routes")],
    "nextjs": [],
    "react": [(r"\.(?:test|spec|stories|story)(\.[^.]*)$", "$1")],
    "react_native": [(r"\.(?:ios|android|native|web)(\.[^.]*)$", ".platform$1")],
    "react_router": [("_index", "index"), ("[$:][A-Za-z0-9_]+", "[param]")],
}
# Evidence of each framework, as (score, file names, directories, dependencies, endings).
NEXT_CONFIG = ["next.config.js", "next.config.mjs", "next.config.ts", "next.config.cjs"]
ROUTER = ["react-router", "react-router-dom", "@react-router/dev"]
NATIVE = ["react-native", "expo"]
EVIDENCE = {
    "angular": [(100, ["angular.json"], [], [], ""), (35, [], [], ["@angular/core"], "")],
    "nextjs": [(100, [*NEXT_CONFIG, "next-env.d.ts"], [], [], ""), (20, [], [], ["next"], "")],
    "react_native": [(40, [], [], NATIVE, ""), (100, [], [], [], r"\.(ios|android|native)\.tsx?$")],
    "react_router": [(100, [], ["app/routes", "src/routes"], [], ""), (30, [], [], ROUTER, "")],
}
REACT_VETO = [*NEXT_CONFIG, "angular.json"], ["next", *ROUTER, *NATIVE, "@angular/core"]
LEAST_SCORE = 30


def _replaced(c: Column, rules: list[tuple[str, str]], whole: bool) -> Column:
    if not whole:
        return reduce(lambda x, r: F.regexp_replace(x, *r), rules, c)
    return reduce(lambda done, r: F.when(c.rlike(r[0]), F.lit(r[1])).otherwise(done), reversed(rules), c)


def _once(value: Column, use) -> Column:
    """use(value), with value written into the plan once however often use names it."""
    return F.transform(F.array(value), use)[0]


def _named(profile: str, path: Column) -> Column:
    """A clean directory as the profile names it."""
    rules = SEGMENTS.get(profile)
    return F.array_join(F.transform(F.split(path, "/"), lambda s: _once(F.trim(s), lambda x: _replaced(x, rules, True))), "/") if rules else path


def normal_subtree(profile: str, path: Column) -> Column:
    """A directory as the profile names it; unknown profiles and 'generic' change nothing."""
    return _once(_once(F.trim(path), normalised), lambda p: _named(profile, p))


def normal_file(profile: str, path: Column) -> Column:
    def named(p: Column) -> Column:
        folder = _once(directory(p), lambda d: _named(profile, d))
        name = _replaced(basename(p), NAMES.get(profile, []), False)
        return _once(folder, lambda d: F.when(d == ".", name).otherwise(F.concat(d, F.lit("/"), name)))

    return _once(_once(path, normalised), named)


def by_profile(profile: Column, path: Column, normal) -> Column:
    """path by the profile that a column names; normal is normal_subtree or normal_file. What has no profile stays as it is."""
    return reduce(lambda done, p: F.when(profile == p, normal(p, path)).otherwise(done), SEGMENTS, path)


def detect(entries: DataFrame) -> DataFrame:
    """(repo_id, framework, score): the only best profile of score 30 or more, else generic.

    entries: all files (repo_id, path, text), text needed for package.json only;
    a dependency is one named there, at most two directories deep. One
    aggregation with flags for each repository, so nothing is gathered.
    """
    path = F.col("path")
    manifest = (basename(path) == "package.json") & (F.size(F.split(path, "/")) <= 3)
    held = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    depends = lambda names: reduce(lambda a, b: a | b, (F.col("text").contains(f'"{n}"') for n in names)) & manifest
    named = lambda names: basename(path).isin(names)
    under = lambda dirs: F.concat(F.lit("/"), path).rlike("/(" + "|".join(dirs) + ")/")
    flags: list[tuple[str, int, Column]] = []
    for profile, rules in EVIDENCE.items():
        for score, files, dirs, packages, ending in rules:
            parts = [make(given) for make, given in ((named, files), (under, dirs), (depends, packages), (path.rlike, ending)) if given]
            flags.append((profile, score, held(reduce(lambda a, b: a | b, parts))))
    react = ~held(named(REACT_VETO[0])) & ~held(depends(REACT_VETO[1])) & held(depends(["react"])) & held(under(["src"]) | path.rlike(r"\.[jt]sx$"))
    flags.append(("react", 30, react))
    found = F.array(*(F.when(c, F.struct(F.lit(s).alias("score"), F.lit(p).alias("framework"))) for p, s, c in flags))
    repos = entries.groupBy("repo_id").agg(F.array_compact(found).alias("found"))
    best = repos.select("repo_id", F.explode_outer("found").alias("f")).groupBy("repo_id", F.col("f.framework").alias("framework")).agg(F.max("f.score").alias("score"))
    w = Window.partitionBy("repo_id")
    top = best.withColumn("_top", F.max("score").over(w)).where("score is null or score = _top").withColumn("_n", F.count(F.lit(1)).over(w))
    clear = (F.col("_n") == 1) & (F.col("score") >= LEAST_SCORE)
    return top.groupBy("repo_id").agg(F.max(F.when(clear, F.col("framework"))).alias("framework"), F.max("score").alias("score")).select("repo_id", F.coalesce("framework", F.lit("generic")).alias("framework"), F.coalesce("score", F.lit(0)).alias("score"))
