"""Boilerplate lines by site-relative frequency, with DataFrame functions only.

For every host and line, the pages of the host that contain the line are divided
by the host's pages; a line over `ratio`, on at least `min_pages` pages, is
boilerplate of that host and is dropped from all its pages. Pages of equal text
count once in both counts, so the lines of a page with many copies are not taken
for boilerplate. Blank lines are never dropped.

Lines and texts are counted by 64-bit hashes with map-side combining. A host
has at most (mean lines a page) / ratio boilerplate lines; they are broadcast
when there are at most `broadcast_rows` in all and joined otherwise.

Null texts have no lines and stay null; an empty text is one blank line. A null
host is a host of its own. Rows that repeat are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.common import cut, table

RATIO, MIN_PAGES, BROADCAST_ROWS = 0.05, 5, 200_000


def lines(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and line_hash of all boilerplate lines."""
    d = docs.select(F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")).where("text is not null")
    d = d.select("host", F.xxhash64("text").alias("page"), "text")
    pages = d.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    line = d.select("host", "page", F.explode(F.transform(F.filter(F.array_distinct(lines("text")), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))).alias("line_hash"))
    found = line.groupBy("host", "line_hash").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= min_pages)
    return found.join(pages.withColumnRenamed("host", "page_host"), F.col("host").eqNullSafe(F.col("page_host"))).where(F.col("n") > F.col("pages") * ratio).select("host", "line_hash")


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc (the row of docs), n_lines, n_dropped and kept_text."""
    found = cut(boilerplate_lines(docs, host, ratio, min_pages), "boilerplate")
    by_host = found.groupBy("host").agg(F.collect_list("line_hash").alias("hashes"))
    if found.count() <= broadcast_rows:
        by_host = F.broadcast(by_host)
    d = docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("of"))
    joined = d.join(by_host, F.col("of").eqNullSafe(F.col("host")), "left")
    every = lines("text")
    kept = F.filter(every, lambda x: (F.trim(x) == "") | ~F.array_contains("hashes", F.xxhash64(x)))
    out = joined.withColumn("kept", F.when(F.col("hashes").isNull(), every).otherwise(kept))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(every))
    dropped = F.when(F.col("text").isNull(), 0).otherwise(n - F.size("kept"))
    return out.select("doc", n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), F.when(dropped == 0, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return without_boilerplate(docs).select("doc.doc_id", "n_lines", "n_dropped", "kept_text")


def line_sql(documents: str) -> dict[str, str]:
    """Named parts of a WITH that end in cleaned: the columns of documents, kept_text, n_lines and n_dropped."""
    return {
        "line_pages": f"SELECT source AS host, count(DISTINCT text) AS pages FROM {documents} GROUP BY 1",
        "line_of": f"SELECT source AS host, text, unnest(string_split(text, chr(10))) AS line FROM {documents}",
        "boiler": f"SELECT o.host, o.line FROM (SELECT host, line, count(DISTINCT text) AS n FROM line_of WHERE trim(line) <> '' GROUP BY 1, 2 HAVING count(DISTINCT text) >= {MIN_PAGES}) o JOIN line_pages p ON o.host IS NOT DISTINCT FROM p.host WHERE o.n > p.pages * {RATIO}",
        "boiler_of": "SELECT host, list(line) AS dropped FROM boiler GROUP BY 1",
        "cleaned": f"SELECT d.*, CASE WHEN b.dropped IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(b.dropped, x)), chr(10)) END AS kept_text, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(list_filter(string_split(d.text, chr(10)), lambda x: trim(x) <> '' AND list_contains(b.dropped, x))), 0)::BIGINT AS n_dropped FROM {documents} d LEFT JOIN boiler_of b ON d.source IS NOT DISTINCT FROM b.host",
    }


OP6_SQL = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in line_sql("documents").items()) + " SELECT doc_id, n_lines, n_dropped, kept_text FROM cleaned"
