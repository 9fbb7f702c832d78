"""Tables of a job's own in the folder that all executors share: written once, read often, and removed by their owner."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_swept: dict[str, Tables] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one set on the context; executors and driver see it.

    Where neither is set, only a local master may have a temporary folder: elsewhere each machine would write to its own.
    """
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="matchloom-")
    if not own.isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Tables:
    """Tables of one job. They cut a plan: what is read from them is not computed again, and lost executors cost nothing.

    drop() removes them all, also as a context manager. Results that still read them must be written before.
    """

    def __init__(self, spark: SparkSession, name: str = "job"):
        self.spark, self.folder, self.used = spark, f"{shared_dir(spark)}/matchloom/{name}-{uuid.uuid4().hex}", False

    def path(self, name: str = "t") -> str:
        self.used = True
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        if self.used:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.used = False

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def session_tables(spark: SparkSession) -> Tables:
    """Tables behind results that are returned unwritten: they go by sweep(), or when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _swept:
        _swept[app] = Tables(spark, f"session-{app}")
        atexit.register(_sweep_quietly, app)
    return _swept[app]


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """The same rows as a table of the session."""
    return session_tables(df.sparkSession).write(df, name)


def sweep(spark: SparkSession) -> None:
    """Removes the session's tables; results that read them can't be read any more."""
    if tables := _swept.get(spark.sparkContext.applicationId):
        tables.drop()


def _sweep_quietly(app: str) -> None:
    tables = _swept.pop(app, None)
    if tables and tables.spark.sparkContext._jsc is not None:
        try:
            tables.drop()
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass
