"""Expensive pair scorers: who is scored, by which half's model, and how new scores join old ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import fold, shuffled


def gate(pairs: DataFrame, p: str = "p1", low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Pairs that a cheap score leaves open, with their half: the cheap filter runs before any Python."""
    return pairs.where(F.col(p).between(low, high)).withColumn("half", F.floor(fold(F.col("s1")) / 2).cast("int"))


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], name: str = "ce") -> DataFrame:
    """Rows (s1, t, name) by any scorer over batches of serialised pairs (text_1, text_2). Pairs of a partition are sorted by
    length in the JVM, spilling if they must, so a batch's pairs are of like length and padding is small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s1": b["s1"], "t": b["t"], name: scorer(b)})

    rows = pairs.select("s1", "t", "text_1", "text_2").withColumn("_n", F.length("text_1") + F.length("text_2")).sortWithinPartitions("_n").drop("_n")
    return rows.mapInPandas(run, f"s1 long, t long, {name} double")


def assemble(scores: list[DataFrame], gated: DataFrame, name: str = "ce") -> DataFrame:
    """Each half's pairs with the score of the other half's model: no model scores a query it was trained on."""
    out = None
    for h, s in enumerate(scores):  # s: by the model of half h
        part = gated.where(F.col("half") == 1 - h).select("s1", "t").join(s.select("s1", "t", name), ["s1", "t"])
        out = part if out is None else out.unionByName(part)
    return out


def mean_of(scores: list[DataFrame], name: str = "ce") -> DataFrame:
    """Mean of what scorers gave a pair. A pair that one of them lacks, or has twice, ends the job: tables that don't hold
    the same pairs are of different data."""
    out = None
    for i, s in enumerate(scores):
        x = s.select("s1", "t", name, F.lit(1 << i).cast("long").alias("_k"))
        out = x if out is None else out.unionByName(x)
    g = out.groupBy("s1", "t").agg(F.avg(name).alias(name), F.sum("_k").alias("_k"), F.count("*").alias("_n"))
    sound = (F.col("_k") == (1 << len(scores)) - 1) & (F.col("_n") == len(scores))
    return g.withColumn(name, F.when(sound, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("not scored once by each: "), "s1", F.lit(", "), "t")).cast("double"))).select("s1", "t", name)


def band_training(pairs: DataFrame, truth: DataFrame, p: str = "p1", seed: int = 7) -> DataFrame:
    """Rows (s1, t, y, h): the pairs that the gate leaves open, with labels, in the order of a hash."""
    g = gate(pairs, p).select("s1", "t").join(truth.select("s1", "t", F.lit(1).alias("y")), ["s1", "t"], "left").na.fill(0, ["y"])
    return shuffled(g, F.col("t") * 1_000_003 + F.col("s1"), seed)


def without_stale(pairs: DataFrame, queries: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with columns made null where the query (s1) or the target (t) has changed since they were computed."""
    gone = lambda d, k: d.select(k, F.lit(True).alias(f"_{k}")).distinct()
    x = pairs.join(gone(queries, "s1"), "s1", "left").join(gone(targets, "t"), "t", "left")
    old = F.col("_s1").isNotNull() | F.col("_t").isNotNull()
    return x.withColumns({c: F.when(~old, F.col(c)) for c in columns}).drop("_s1", "_t")


def newly_gated(gated: DataFrame, scored: DataFrame) -> DataFrame:
    """Gated pairs without a score yet: only they are scored again."""
    return gated.join(scored.select("s1", "t"), ["s1", "t"], "left_anti")


def merged(old: DataFrame, new: DataFrame, gated: DataFrame, name: str = "ce") -> DataFrame:
    """Scores of gated pairs, old ones first."""
    both = old.select("s1", "t", name, F.lit(0).alias("o")).unionByName(new.select("s1", "t", name, F.lit(1).alias("o")))
    one = both.groupBy("s1", "t").agg(F.min_by(name, "o").alias(name))
    return gated.select("s1", "t").join(one, ["s1", "t"], "left")


def training_pairs(pairs: DataFrame, seed: int = 5, negatives: int = 6) -> DataFrame:
    """Up to 4 true pairs, the `negatives` best false ones and one more false one by hash, of each query."""
    from pyspark.sql import Window

    from ..functions.ids import sample_hash

    w = lambda *o: F.row_number().over(Window.partitionBy("s1", "y").orderBy(*o))
    x = pairs.withColumn("h", sample_hash(F.col("t") * 1_000_003 + F.col("s1"), seed)).withColumns({"rp": w("h", "t"), "rn": w(F.desc("p1"), "t")})
    low = Window.partitionBy("s1", "y", F.col("rn") > negatives).orderBy("h", "t")
    x = x.withColumn("rl", F.row_number().over(low))
    return x.where(F.when(F.col("y") == 1, F.col("rp") <= 4).otherwise((F.col("rn") <= negatives) | (F.col("rl") == 1))).select("s1", "t", "y")
