"""Files of repositories in a store that Spark reads, and which of them are analysed."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.globs import matches_any
from stratagraph.sources.written import cut

# Endings of the languages' files.
ENDINGS = {"javascript": r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", "php": r"\.(?:php|phtml)$"}


def entries(spark: SparkSession, root: str, repo_id: str = "") -> DataFrame:
    """(repo_id, path, content) of every file under root, path relative to root; read by the executors. Spark's reader lists empty files but makes no rows of them, so their names are taken from its listing."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    listed = spark.createDataFrame([(unquote(x),) for x in d.inputFiles()], "path string")
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    d = d.select(bare("path").alias("path"), "content")
    names = d.select("path")
    full = F.col("path")
    d = d.unionByName(listed.select(bare("path").alias("path")).join(names, "path", "left_anti").withColumn("content", F.lit(b"")))
    return d.select(F.lit(repo_id).alias("repo_id"), F.substring(full, len(base) + 1, F.length(full)).alias("path"), "content")


def _store(root: str):
    """The file system of a root and the root's place in it, as a task sees them."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return store, at.rstrip("/")


def walked(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), repo_id: str = "") -> DataFrame:
    """(repo_id, path, size) of every file under root outside excluded directories; paths are relative to root.

    A round lists the directories of one level, on the executors, and drops those that are
    excluded or begin with a dot before the next; so what lies in them is never listed, no name
    passes through the driver, and there are as many rounds as levels. root is a folder
    that all executors see, or an address that pyarrow's file systems read; for other
    stores there is entries.
    """

    def listed(batches):
        from pyarrow import fs

        store, base = _store(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{base}/{path}".rstrip("/") or "/"))
                names = [f"{path}/{x.base_name}".lstrip("/") for x in found]
                for i in range(0, len(names), 10000):
                    part = found[i : i + 10000]
                    yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 10000], pa.string()), pa.array([x.type == fs.FileType.Directory for x in part], pa.bool_()), pa.array([x.size or 0 for x in part], pa.int64())], ["path", "is_dir", "size"])

    level, parts = spark.createDataFrame([("",)], "path string"), []
    keep = ~F.col("path").rlike(r"(?:^|/)\.[^/]+$")
    if exclude:
        keep &= ~matches_any(F.col("path"), list(exclude))
    while True:
        seen = Observation()
        got = level.mapInArrow(listed, "path string, is_dir boolean, size long").where(~F.col("is_dir") | keep)
        got = cut(got.observe(seen, F.count_if("is_dir").alias("dirs")), "walk")
        parts.append(got.where("not is_dir"))
        if not seen.get["dirs"]:
            break
        level = got.where("is_dir").select("path").repartition(F.col("path"))
    return reduce(DataFrame.unionByName, parts).select(F.lit(repo_id).alias("repo_id"), "path", "size")


def contents(files: DataFrame, root: str) -> DataFrame:
    """(repo_id, path, content) of walked files, read where they are needed."""

    def read(batches):
        store, base = _store(root)
        for batch in batches:
            for k in range(batch.num_rows):
                with store.open_input_stream(f"{base}/{batch.column(1)[k].as_py()}") as f:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([f.read()], pa.binary())], ["repo_id", "path", "content"])

    return files.select("repo_id", "path").mapInArrow(read, "repo_id string, path string, content binary")


def supported(path: Column, language: str) -> Column:
    return path.rlike(ENDINGS[language]) & (~path.contains(".gen.") if language == "javascript" else F.lit(True))


def discovered(files: DataFrame, include: list[str], exclude: list[str], language: str | None = None, roots: tuple[str, ...] = (".",)) -> DataFrame:
    """The files under a root that are supported, included and not excluded, each once.

    Nothing below a directory that is excluded or whose name starts with a dot is
    taken. Files without a path are none; no include pattern takes every file.
    """
    path = F.col("path")
    keep = path.isNotNull() & ~path.rlike(r"(?:^|/)\.[^/]+/")
    if "." not in roots:
        keep &= path.rlike("^(?:" + "|".join(f"\\Q{r.strip('/')}\\E" for r in roots) + ")/")
    if language:
        keep &= supported(path, language)
    if include:
        keep &= matches_any(path, include)
    if exclude:
        parents = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i), "/"))
        keep &= ~F.exists(parents, lambda p: matches_any(p, exclude))
    return files.where(keep).dropDuplicates(["repo_id", "path"])
