"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from stratagraph.sources.written import cut, release, scratch, shared_dir

__all__ = ["cut", "release", "scratch", "shared_dir", "table", "text_bytes", "wider"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def wider(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of df with one more column."""
    return StructType([*df.schema.fields, StructField(name, DataType.fromDDL(kind))])
