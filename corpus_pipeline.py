"""A corpus pipeline: quality, boilerplate lines, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of documents; the last returns the packed pieces. Null texts stay null
until they are packed, as empty documents; rows with a null doc_id are scored,
cleaned and redacted like others, are never near duplicates, and are packed as
documents of their own. Empty tables give empty ones; extra columns stay until
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import boilerplate, neardup, packing, pii, quality
from stratagraph.llm.common import cut, release, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, does not reject."""
    return quality.accepted(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    d = boilerplate.without_boilerplate(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return d.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the smallest by doc_id and hash of text: shingles of five words, similarity 0.8.

    Rows that repeat a doc_id are judged by their own texts; of rows with equal
    doc_id and text one stays. Rows with a null doc_id all stay.
    """
    gone = neardup.near_duplicate_rows(docs).where("not first").select("doc_id", "text_key")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), neardup.text_key(), F.col("text").isNull().alias("empty"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row"))
    rows = rows.join(gone.hint("merge"), ["doc_id", "text_key"], "left_anti").dropDuplicates(["doc_id", "text_key", "empty", "row"])
    return rows.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    d = pii.redacted(docs, pii.fitted(docs))
    return d.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.packed(docs)


STAGES = [("quality", reject_low_quality), ("lines", drop_boilerplate), ("near_duplicates", drop_near_duplicates), ("personal_data", redact), ("packing", pack)]

#: SQL has no tokenizer, trained classifier or trained span model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, past = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*past)
        past = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
