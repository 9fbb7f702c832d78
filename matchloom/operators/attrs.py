"""Attributes of records: keys of names, addresses and numbers, how often they occur, and rarity of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbers


def record_view(prepared: DataFrame) -> DataFrame:
    """Joined and concatenated token views of records, their numbers and flags."""
    core = F.when(F.size("core") > 0, F.col("core")).otherwise(F.col("nt"))
    r = prepared.withColumn("core", core)
    return r.select(
        "id", "source", "country", "nt", "core", "at", "acore", "al_pre", "al_post", "ncomp", "oov", F.array_join("nt", " ").alias("ns"), F.array_join("core", " ").alias("cs"),
        F.array_join("core", "").alias("cc"), F.array_join("nt", "").alias("nc"), F.array_join("at", " ").alias("as"), F.array_join("acore", " ").alias("acs"),
        numbers(F.col("acore")).alias("nums"), (F.trim(F.coalesce("address", F.lit(""))) == "").alias("aempty"), F.coalesce(F.col("name").rlike(r"(?i)\.com|www\.|^@"), F.lit(False)).alias("dom"),
        F.coalesce(F.col("name").rlike("[ऀ-෿]"), F.lit(False)).alias("ind"),
    )


def record_attrs(view: DataFrame) -> DataFrame:
    """Rows (id, cc, acs, hn, nums_k, cc_fs1, cc_ft, acs_fs1, acs_ft): comparable keys and their counts among queries and targets.

    acs is null without address words, nums_k without numbers; hn is "" then, so that two records without numbers agree.
    """
    acs = F.array_join("acore", " ")
    r = view.select(
        "id", "source", "country", "cc", F.when(F.size("acore") > 0, acs).alias("acs"), F.coalesce(F.try_element_at("nums", F.lit(1)), F.lit("")).alias("hn"),
        F.when(F.size("nums") > 0, F.array_join(F.array_sort("nums"), " ")).alias("nums_k"),
    )
    side = lambda want: F.sum(F.when(want, 1).otherwise(0))
    out = r
    for k in ("cc", "acs"):
        f = r.where(F.col(k).isNotNull()).groupBy("country", k).agg(side(F.col("source") == 1).alias(f"{k}_fs1"), side(F.col("source") > 1).alias(f"{k}_ft"))
        out = out.join(f, ["country", k], "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("cc_fs1", "cc_ft", "acs_fs1", "acs_ft")}
    return out.withColumns(counts).select("id", "country", "cc", "acs", "hn", "nums_k", *counts)


def idf(view: DataFrame, column: str = "nt") -> DataFrame:
    """Rows (t, df, idf) over all targets, whatever their country."""
    t = view.where("source > 1")
    n = float(max(1, t.count()))
    d = t.select(F.explode(F.array_distinct(column)).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    return d.withColumn("idf", F.ln(F.lit(n) / F.col("df")))


def weighed(view: DataFrame, n_targets: int) -> DataFrame:
    """view with wn and wa: maps from a record's name words and address tokens to their rarity over all targets, ln N for words
    that no target has. Weights are looked up once per record, not per pair: pairs are many times as many. A row per record is
    merged, not broadcast, whatever size its files have."""
    of = lambda kind, c: F.transform(F.array_distinct(c), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("t")))
    rows = view.select("id", "source", F.inline(F.concat(of("n", "nt"), of("a", "at"))))
    df = rows.where("source > 1").groupBy("kind", "t").agg(F.count("*").alias("df"))
    x = F.ln(F.lit(float(max(1, n_targets))) / F.coalesce("df", F.lit(1)))
    pairs = lambda kind, name: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("t", x.alias("x"))))).alias(name)
    g = rows.join(df, ["kind", "t"], "left").groupBy("id").agg(pairs("n", "wn"), pairs("a", "wa"))
    none = F.create_map().cast("map<string,double>")
    return view.join(g.hint("merge"), "id", "left").withColumns({c: F.coalesce(c, none) for c in ("wn", "wa")})
