"""What the operators share: durable cuts in a plan, names of their own, and counts of words."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, written


#: Rows of an Arrow batch where tables are written: fewer texts at a time in the JVM's buffers and in Python. No row goes.
BATCH_ROWS = 500


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for what is run within; the session's own setting is back afterwards, and holds if it is smaller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: lineage ends here, and lost executors cost nothing. The session owns it."""
    with text_batches(df.sparkSession):
        return written(df)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() for small intermediate results of loops; Spark's cleaner may remove its files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder with the columns named; others, whatever their names, play no part."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def words_count(text: str) -> F.Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` of a text column, null and empty: 0, in the JVM."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.size(F.filter(F.split(t, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")
