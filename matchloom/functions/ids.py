"""Record ids: "S<source>-<number>" and source * 10^10 + number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 10_000_000_000


def encode(text: Column) -> Column:
    return F.substring(text, 2, 1).cast("long") * BASE + F.substring(text, 4, 20).cast("long")


def decode(number: Column) -> Column:
    return F.concat(F.lit("S"), F.floor(number / BASE).cast("string"), F.lit("-"), (number % BASE).cast("string"))


def sample_hash(number: Column, seed: int) -> Column:
    """The hash that folds, samples and shuffles use; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def fold(number: Column, folds: int = 4) -> Column:
    return (sample_hash(number, 11) % folds).cast("int")


def kept(number: Column, permille: int = 814) -> Column:
    return sample_hash(number, 2024) % 1000 < permille


def shuffled(df: DataFrame, number: Column, seed: int) -> DataFrame:
    """df in the order of a hash, which is its column h."""
    return df.withColumn("h", sample_hash(number, seed)).orderBy("h")


def train_eval(df: DataFrame, key: str, n_train: int, n_eval: int, seed: int = 17) -> DataFrame:
    """Rows (key, part): of distinct keys in the order of a hash, the first n_train to train on and the last n_eval to evaluate;
    each is a sorted head of bounded size."""
    x = df.select(key).withColumn("_h", sample_hash(F.col(key), seed))
    first = x.orderBy("_h", key).limit(n_train).select(key, F.lit("train").alias("part"))
    return first.unionByName(x.orderBy(F.desc("_h"), F.desc(key)).limit(n_eval).select(key, F.lit("eval").alias("part")))
