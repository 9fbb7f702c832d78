"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import pairs, records
from .queries.common import QUERIES, SQL, Query

MODULES = (records, pairs)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs by compound keys."""
    return QUERIES["d14_block"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
