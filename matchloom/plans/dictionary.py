"""Dictionaries learned from true pairs: each native word votes for the word that stands at its place in the pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import INDIC


def learn_words(pairs: DataFrame, native_only: bool = True) -> DataFrame:
    """Rows (word, latin, votes): the commonest counterpart of each word, from pairs (native, latin) of equal length; ties by word."""
    z = pairs.where(F.size("native") == F.size("latin")).select(F.explode(F.arrays_zip("native", "latin")).alias("z")).select(F.col("z.native").alias("word"), F.col("z.latin").alias("latin"))
    z = z.where(F.col("word").rlike(INDIC) & ~F.col("latin").rlike(INDIC)) if native_only else z
    votes = z.groupBy("word", "latin").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("word").orderBy(F.desc("votes"), "latin")
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def learn_components(pairs: DataFrame) -> DataFrame:
    """Rows (word, latin, votes): the same for address parts, each native part voting for every part of the pair's other side."""
    z = pairs.select(F.explode("native").alias("word"), "latin").select("word", F.explode("latin").alias("latin"))
    votes = z.where(F.col("word").rlike(INDIC) & ~F.col("latin").rlike(INDIC)).groupBy("word", "latin").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("word").orderBy(F.desc("votes"), "latin")
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
