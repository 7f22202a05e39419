"""Which class each `new` expression constructs, as a chain of left joins with the first failing step as the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions.globs import matches_any
from stratagraph.functions.paths import construction_support, effective_support, score_confidence, weighted_score


def resolve_constructions(files: DataFrame, news: DataFrame, bindings: DataFrame, classes: DataFrame, exports: DataFrame, service_globs: list[str], name_regex: str = ".*Service$") -> DataFrame:
    """news with resolved_file, resolved_class, is_resolved, is_service and unresolved_reason.

    bindings carry the resolved path of their module; exports name the local class of
    each exported name, 'default' for the default export.
    """
    own = classes.select("repo_id", "file", F.col("name").alias("class_name"), F.lit(True).alias("is_local")).distinct()
    bound = bindings.where("resolved_path is not null").groupBy("repo_id", "file", F.col("local").alias("class_name")).agg(F.min(F.struct(F.col("resolved_path").alias("target"), "imported")).alias("b")).select("repo_id", "file", "class_name", "b.target", "b.imported")
    known = files.select("repo_id", F.col("path").alias("target"), F.lit(True).alias("is_known")).distinct()
    exported = exports.select("repo_id", F.col("file").alias("target"), F.col("export_name").alias("imported"), "local_class").distinct()
    declared = classes.select("repo_id", F.col("file").alias("target"), F.col("name").alias("local_class"), F.lit(True).alias("is_class")).distinct()
    n = news.join(own, ["repo_id", "file", "class_name"], "left").join(bound, ["repo_id", "file", "class_name"], "left").join(known, ["repo_id", "target"], "left").join(exported, ["repo_id", "target", "imported"], "left").join(declared, ["repo_id", "target", "local_class"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(~F.col("is_identifier"), "dynamic_constructor")
        .when(yes("is_local"), None)
        .when(F.col("target").isNotNull() & ~yes("is_known"), "import_target_not_parsed")
        .when(F.col("target").isNotNull() & ~yes("is_class"), F.when(F.col("imported") == "default", "default_export_not_class").otherwise("imported_symbol_not_class"))
        .when(F.col("target").isNotNull(), None)
        .otherwise("symbol_not_resolved")
    )
    n = n.withColumn("unresolved_reason", reason).withColumn("is_resolved", F.col("unresolved_reason").isNull())
    n = n.withColumn("resolved_file", F.when(F.col("is_resolved"), F.when(yes("is_local"), F.col("file")).otherwise(F.col("target")))).withColumn("resolved_class", F.when(F.col("is_resolved"), F.when(yes("is_local"), F.col("class_name")).otherwise(F.col("local_class"))))
    service = F.col("is_resolved") & matches_any(F.col("resolved_file"), service_globs) & F.col("resolved_class").rlike(name_regex)
    return n.select(*news.columns, "resolved_file", "resolved_class", "is_resolved", F.coalesce(service, F.lit(False)).alias("is_service"), "unresolved_reason")


def least_three(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(repo_id, name): the three smallest different values of a repository; no task passes on more than three."""
    first = F.row_number().over(Window.partitionBy("repo_id").orderBy(value))
    d = rows.select("repo_id", value).where(F.col(value).isNotNull()).distinct().withColumn("_n", first).where("_n <= 3")
    return d.groupBy("repo_id").agg(F.array_sort(F.collect_list(value)).alias(name))


def construction_match(constructions: DataFrame, files: DataFrame, scope: list[str], allowed: list[str], min_support: int = 20) -> DataFrame:
    """One row a repository: how often services are constructed outside the allowed roots, and the score of a rule against it."""
    inside = matches_any(F.col("file"), scope) & ~matches_any(F.col("file"), allowed)
    bad = F.col("is_resolved") & F.col("is_service")
    place = F.concat("file", F.lit(":"), "line")
    c = constructions.where(inside).groupBy("repo_id").agg(
        F.countDistinct("file").alias("eligible_files"), F.countDistinct(F.when(bad, F.col("file"))).alias("violating_files"), F.count_if(bad).alias("events"), F.count_if("is_resolved").alias("resolved_count"), F.count_if(~F.col("is_resolved")).alias("unresolved_count"),
    )
    found = constructions.where(inside & bad).select("repo_id", place.alias("place"), F.concat(place, F.lit(":new "), "class_name").alias("example"))
    for name, value in (("sample_locations", "place"), ("resolved_examples", "example")):
        c = c.join(least_three(found, value, name), "repo_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    reasons = constructions.where(inside & ~F.col("is_resolved") & F.col("unresolved_reason").isNotNull()).groupBy("repo_id", F.col("unresolved_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "reason")))  # one for each reason there is, six at most
    c = c.join(reasons.groupBy("repo_id").agg(F.transform(order, lambda x: F.struct(x["reason"].alias("reason"), (-x["order"]).alias("count"))).alias("unresolved_reasons")), "repo_id", "left")
    scoped = files.where(matches_any(F.col("path"), scope)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("scoped_files"))
    d = scoped.join(c, "repo_id", "left").fillna(0)
    prevalence = F.when(F.col("eligible_files") > 0, F.col("violating_files") / F.col("eligible_files")).otherwise(0.0)
    structural = F.when(F.col("resolved_count") > 0, F.col("resolved_count") / (F.col("resolved_count") + F.col("unresolved_count"))).otherwise(0.5)
    naming = F.when((F.col("unresolved_count") > 0) & (F.col("resolved_count") == 0), 0.3).otherwise(0.6)
    support = construction_support(F.col("prevalence"), F.col("eligible_files"), effective_support(min_support, F.col("scoped_files")))
    d = d.withColumn("prevalence", prevalence).withColumn("structural_fit", structural).withColumn("prevalence_support", support).withColumn("naming_fit", naming)
    return d.withColumn("score", weighted_score(F.col("structural_fit"), F.col("prevalence_support"), F.col("naming_fit"))).withColumn("confidence", score_confidence(F.col("score")))


def reason_counts(constructions: DataFrame) -> DataFrame:
    """Unresolved constructions by reason, most frequent first."""
    c = constructions.where("not is_resolved").groupBy("repo_id", F.col("unresolved_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy("repo_id", F.desc("n"), "reason")
