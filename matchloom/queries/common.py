"""What queries share: registration, and plain types for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(f(spark, sf_dir))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, fractions at nine digits, arrays joined by blanks."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            c = c.cast("long")
        elif kind in ("double", "float"):
            c = F.round(c + F.lit(1e-12), 9) + F.lit(0.0)  # no negative zero
        elif kind == "array<string>":
            c = F.array_join(c, " ")
        cols.append(c.alias(name))
    return df.select(*cols)


def r(x: str) -> str:
    return f"(round({x} + 1e-12, 9) + 0.0)"
