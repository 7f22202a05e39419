"""The language of each repository, from its manifests and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.paths import basename

# Manifests, endings and reasons of the languages, in the order in which they are registered; the first is the default.
LANGUAGES = (
    ("javascript", ("tsconfig.json", "jsconfig.json"), r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", "tsconfig/jsconfig found", "js/ts files detected"),
    ("php", ("composer.json",), r"\.(?:php|phtml)$", "composer.json found", "php files detected"),
)


def languages(files: DataFrame, explicit: str = "") -> DataFrame:
    """(repo_id, language, reason, matched): the language a repository is analysed in.

    A named language is taken as it is, an unknown one gives null. Otherwise the
    one that matches; of several the default if `auto` is asked for, else the
    first; without any the default. matched has the languages with their reasons.
    """
    explicit = explicit.strip().lower()
    path = F.col("path")
    of = {}
    for name, manifests, ending, _, _ in LANGUAGES:
        of[f"{name}_named"] = F.bool_or(F.coalesce(basename(path).isin(*manifests), F.lit(False)))
        of[f"{name}_held"] = F.bool_or(F.coalesce(path.rlike(ending), F.lit(False)))
    seen = files.groupBy("repo_id").agg(*(c.alias(n) for n, c in of.items()))
    matched = F.array_compact(F.array(*(F.when(F.col(f"{n}_named"), F.struct(F.lit(n).alias("language"), F.lit(first).alias("reason"))).when(F.col(f"{n}_held"), F.struct(F.lit(n).alias("language"), F.lit(second).alias("reason"))) for n, _, _, first, second in LANGUAGES)))
    seen = seen.select("repo_id", matched.alias("matched"))
    default, known = LANGUAGES[0][0], [x[0] for x in LANGUAGES]
    if explicit not in ("", "auto"):
        chosen, reason = (explicit, "explicit") if explicit in known else (None, "explicit_unknown")
        return seen.select("repo_id", F.lit(chosen).cast("string").alias("language"), F.lit(reason).alias("reason"), "matched")
    many = F.size("matched")
    several = (F.lit(default), "auto_ambiguous_default") if explicit == "auto" else (F.get("matched", F.lit(0))["language"], "auto_ambiguous_first_selected")
    language = F.when(many == 0, default).when(many == 1, F.get("matched", F.lit(0))["language"]).otherwise(several[0])
    reason = F.when(many == 0, "auto_none_fallback_default").when(many == 1, "auto_detected").otherwise(several[1])
    return seen.select("repo_id", language.alias("language"), reason.alias("reason"), "matched")
