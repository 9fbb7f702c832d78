"""Vectors of records by a plugged-in encoder, and exact nearest neighbours within a country."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors of a block: a task holds two blocks, and similarities of STRIPE queries with one block at a time.
BLOCK, STRIPE = 8192, 512


def encode(lines: DataFrame, encoder: Callable[[list[str]], np.ndarray], dims: int, batch_chars: int = 1 << 16) -> DataFrame:
    """Rows (id, source, country, v) of rows (id, source, country, x): unit vectors of the encoder's first `dims` numbers.

    Texts go to the encoder in batches of like length, of so many characters, padding counted, at most; a longer text goes
    alone. Null texts are empty. A vector of zeros stays one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out, at = b["x"].tolist(), [], 0
            while at < len(texts):
                upto, longest = at, 0
                while upto < len(texts) and (upto == at or (upto - at + 1) * max(longest, len(texts[upto])) <= batch_chars):
                    longest = max(longest, len(texts[upto]))
                    upto += 1
                m = np.asarray(encoder(texts[at:upto]), np.float64)[:, :dims]
                out += list((m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).astype(np.float32))
                at = upto
            yield b[["id", "source", "country"]].assign(v=out)

    rows = lines.select("id", "source", "country", F.coalesce("x", F.lit("")).alias("x")).withColumn("n", F.length("x")).sortWithinPartitions("n").drop("n")
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, source {dict(rows.dtypes)['source']}, country string, v array<float>")


def matrices(spark: SparkSession, *paths: str) -> DataFrame:
    """Several stored matrices of vectors as one."""
    return spark.read.parquet(*paths)


def top_k_cosine(vectors: DataFrame, k: int = 10, queries: DataFrame | None = None, block: int = BLOCK, digits: int = 9) -> DataFrame:
    """Rows (s1, t, dscore, drank): each query's (source 1) k targets of its country with the largest cosine, ties by t.

    Exact: every query meets every target of its country that can be among its best. Of targets with one vector only the k
    smallest ids can; they are cut before the shuffle, so copies of any number cost k rows. A country's queries and targets
    are dealt into as many blocks of `block` vectors as their counts ask for; a task multiplies the different vectors of one
    block of queries with one block of targets, some queries at a time, and returns its best k of each; the best of those are
    the result. So a task's memory depends on `block` alone, and a vector is sent once per block of the other side. queries
    (id): only these. Scores are rounded to `digits`; vectors of zeros have cosine 0 with all, null vectors no row.
    """
    v = vectors.where(F.col("v").isNotNull()).select("id", "source", "country", "v")
    asked = v.where("source = 1")
    if queries is not None:
        asked = asked.join(queries.select("id"), "id", "left_semi").select(v.columns)
    alike = Window.partitionBy("country", F.xxhash64("v"), "v").orderBy("id")  # the hash is what is mostly compared
    v = asked.unionByName(v.where("source > 1").withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k).drop("_n"))
    side = lambda c: F.ceil(F.sum(F.when(c, 1).otherwise(0)) / block).cast("int")
    sizes = v.groupBy("country").agg(side(F.col("source") == 1).alias("nq"), side(F.col("source") > 1).alias("nt")).where("nq > 0 AND nt > 0")
    v = v.join(sizes, "country")  # as few rows as countries
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = v.where("source = 1").select("id", "source", "country", "v", own("nq").alias("qb"), every("nt").alias("tb"))
    t = v.where("source > 1").select("id", "source", "country", "v", every("nq").alias("qb"), own("nt").alias("tb"))
    both = q.unionByName(t)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["source"] == 1], g[g["source"] > 1].sort_values("id")
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        matrix = lambda x: np.stack(x.to_numpy()).astype(np.float64)
        if not len(a) or not len(b):
            return pd.DataFrame({"s1": [], "t": [], "dscore": []}).astype({"s1": "int64", "t": "int64"})
        left, at = np.unique(matrix(a["v"]), axis=0, return_inverse=True)
        left, right, targets, at, out = unit(left), unit(matrix(b["v"])).T, b["id"].to_numpy(), at.ravel(), []
        for i in range(0, len(left), STRIPE):
            out.append(_best(left[i : i + STRIPE] @ right, k, digits))
        best, score = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"s1": np.repeat(a["id"].to_numpy(), best.shape[1]), "t": targets[best[at]].ravel(), "dscore": score[at].ravel()})

    found = both.groupBy("country", "qb", "tb").applyInPandas(run, "s1 long, t long, dscore double")
    w = Window.partitionBy("s1").orderBy(F.desc("dscore"), "t")
    return found.withColumn("drank", F.row_number().over(w)).where(F.col("drank") <= k)


def _best(sims: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rounded values of each row's k largest after rounding to `digits`, equal ones by column; NaN is last.

    Value and column are one whole number, so that no two are equal and a partition finds the k without sorting the row.
    """
    m, scale = sims.shape[1], 10**digits
    key = np.rint(np.where(np.isnan(sims), -2.0, sims) * -scale).astype(np.int64) * m + np.arange(m)
    if k < m:
        key = np.partition(key, k - 1, axis=1)[:, :k]
    key.sort(axis=1)
    score = -(key // m) / scale
    return key % m, np.where(score < -1.5, np.nan, score)
