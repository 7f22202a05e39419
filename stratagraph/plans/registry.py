"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratagraph.plans import commerce, reports, source_forms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = commerce.QUERIES | reports.QUERIES | source_forms.QUERIES
SQL: dict[str, str] = commerce.SQL | reports.SQL | source_forms.SQL
