"""All queries of the library by name, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import core, files, scores, tables, texts  # noqa: F401  each registers its queries
from .bindings import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
