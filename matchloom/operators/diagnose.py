"""Diagnostics of drift, clusters and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_by = Window.partitionBy


def band(p: Column) -> Column:
    return F.when(p < 0.1, "a<0.1").when(p < 0.5, "b0.1-0.5").when(p < 0.7, "c0.5-0.7").when(p < 0.9, "d0.7-0.9").otherwise("e>0.9")


def density(a: DataFrame, b: DataFrame, n_a: DataFrame, n_b: DataFrame, p: str = "p2") -> DataFrame:
    """Pairs per 1000 queries by (country, band, st) in two data sets, and their ratio; cells of either (full join)."""
    def side(d, n, x):
        return d.withColumn("band", band(F.col(p))).groupBy("country", "band", "st").agg(F.count("*").alias("n"), F.avg(p).alias(f"p_{x}")).join(n.withColumnRenamed("n", "q"), "country").select("country", "band", "st", (F.col("n") * 1000 / F.col("q")).alias(f"per1k_{x}"), f"p_{x}")

    return side(a, n_a, "a").join(side(b, n_b, "b"), ["country", "band", "st"], "full").withColumn("ratio", F.col("per1k_b") / F.col("per1k_a"))


def link_density(a: DataFrame, b: DataFrame, n_a: DataFrame, n_b: DataFrame, by: list[str]) -> DataFrame:
    """Links per 1000 queries of a country by columns, of two sets of links side by side (full join)."""
    def side(d, n, x):
        return d.groupBy("country", *by).agg(F.count("*").alias("n")).join(n.withColumnRenamed("n", "q"), "country").select("country", *by, (F.col("n") * 1000 / F.col("q")).alias(f"per1k_{x}"))

    return side(a, n_a, "a").join(side(b, n_b, "b"), ["country", *by], "full")


def cluster_rates(pairs: DataFrame, key: str, p: str = "p2", least: float = 0.3, most: int = 6) -> DataFrame:
    """Rows (size, key, n, true_rate): the true rate of pairs by how many of the query's candidates of the same key score at
    least so much; sizes from `most` on are one."""
    size = F.least(F.sum(F.when(F.col(p) >= least, 1).otherwise(0)).over(_by("s1", key)), F.lit(most))
    return pairs.withColumn("size", size).groupBy("size", key).agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("true_rate"))


def cluster_signature(pairs: DataFrame, key: str, p: str = "p2", at: float = 0.7) -> DataFrame:
    """pairs with clus (candidates of the query that share the key) and eqacc (one of them is accepted)."""
    w = _by("s1", key)
    return pairs.withColumns({"clus": F.count("*").over(w), "eqacc": F.max(F.when(F.col(p) >= at, 1).otherwise(0)).over(w) == 1})


def copy_count(links: DataFrame, candidates: DataFrame, group: str) -> DataFrame:
    """Rows (group, n_s1, mean_links): how many links queries with a candidate of a group have."""
    n = links.groupBy("s1").agg(F.count("*").alias("k"))
    x = candidates.select("s1", group).distinct().join(n, "s1", "left").na.fill(0, ["k"])
    return x.groupBy(group).agg(F.count("*").alias("n_s1"), F.avg("k").alias("mean_links"))


def acceptance(pairs: DataFrame, by: list[str], p: str = "p2", at: float = 0.7) -> DataFrame:
    """Rows (by, n, accepted, true_rate): share accepted and true by columns."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(p) >= at).cast("double")).alias("accepted"), F.avg(F.col("y").cast("double")).alias("true_rate"))


def edit_type(nt1: Column, nt2: Column) -> Column:
    """Whether the target's words are the same, add, drop, or both."""
    add, drop = F.size(F.array_except(nt2, nt1)) > 0, F.size(F.array_except(nt1, nt2)) > 0
    return F.when(add & drop, "drop+add").when(add, "add").when(drop, "drop").otherwise("same")


def medians(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows (by, feature, median): exact medians, one row per feature."""
    g = df.groupBy(*by).agg(*[F.median(c).alias(c) for c in columns])
    return g.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("median")) for c in columns])))


def pivot_bands(df: DataFrame, rows: str, p: str, value: Column, name: str) -> DataFrame:
    """One row per value of `rows`, one column per band."""
    return df.withColumn("band", band(F.col(p))).groupBy(rows).pivot("band", ["a<0.1", "b0.1-0.5", "c0.5-0.7", "d0.7-0.9", "e>0.9"]).agg(value.alias(name))


def drift(a: DataFrame, b: DataFrame, key: str, least: int) -> DataFrame:
    """Rows (key, rate_a, rate_b, gap): true rate in a against acceptance in b, of keys of at least so many rows in both."""
    x = a.groupBy(key).agg(F.count("*").alias("n_a"), F.avg(F.col("y").cast("double")).alias("rate_a"))
    z = b.groupBy(key).agg(F.count("*").alias("n_b"), F.avg((F.col("p2") >= 0.7).cast("double")).alias("rate_b"))
    return x.join(z, key).where((F.col("n_a") >= least) & (F.col("n_b") >= least)).withColumn("gap", F.col("rate_b") - F.col("rate_a"))


def rejection(pairs: DataFrame, p: str = "p2", at: float = 0.7) -> DataFrame:
    """pairs with why they aren't links: accepted, lost to another query, low score, or near the threshold."""
    r = F.row_number().over(_by("t").orderBy(F.desc(p), "s1"))
    x = pairs.withColumn("_r", r)
    return x.withColumn("why", F.when((F.col(p) >= at) & (F.col("_r") == 1), "accepted").when(F.col(p) >= at, "lost").when(F.col(p) >= at - 0.2, "near").otherwise("low")).drop("_r")


def impact(everyone: DataFrame, truth: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (change, n, true_share, df): links added and removed, and what the mean F0.5 of their queries changes by."""
    from .evaluate import per_query
    from .shift import decision_diff

    d = decision_diff(old, new).join(truth.select("s1", "t", F.lit(1).alias("y")), ["s1", "t"], "left").na.fill(0, ["y"])
    f = per_query(everyone, truth, old).select("s1", F.col("f").alias("fo")).join(per_query(everyone, truth, new).select("s1", F.col("f").alias("fn")), "s1")
    q = d.groupBy("s1", "change").agg(F.count("*").alias("n"), F.sum("y").alias("y")).join(f, "s1")
    return q.groupBy("change").agg(F.sum("n").alias("n"), (F.sum("y") / F.sum("n")).alias("true_share"), F.avg(F.col("fn") - F.col("fo")).alias("df"))


def copy_profile(everyone: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (country, k, n, share): how many queries of a country have k links."""
    x = everyone.join(links.groupBy("s1").agg(F.count("*").alias("k")), "s1", "left").na.fill(0, ["k"])
    return x.groupBy("country", "k").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(_by("country")))


def moments(everyone: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (country, ...): predicted and true empty queries and means, and wrong and missed links per query."""
    from .evaluate import per_query

    q = per_query(everyone, truth, links)
    mean = lambda c: F.avg(c.cast("double"))
    return q.groupBy("country").agg(
        mean(F.col("k") == 0).alias("empty_pred"), mean(F.col("g") == 0).alias("empty_true"), F.avg("k").alias("mean_pred"), F.avg("g").alias("mean_true"),
        F.avg(F.col("k") - F.col("tp")).alias("fp"), F.avg(F.col("g") - F.col("tp")).alias("fn"),
    )


def rescue_bands(everyone: DataFrame, links: DataFrame, scored: DataFrame, p: str = "p2") -> DataFrame:
    """Rows (country, band, n): queries without links by the band of their best score; null without candidates."""
    best = scored.groupBy("s1").agg(F.max(p).alias("m"))
    x = everyone.join(links.select("s1"), "s1", "left_anti").join(best, "s1", "left")
    return x.groupBy("country", F.when(F.col("m").isNotNull(), band(F.col("m"))).alias("band")).agg(F.count("*").alias("n"))


def duplicate_report(targets: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (members, linked, queries, n): groups of equal targets by size, linked members and queries that own them."""
    k = targets.select(F.col("id").alias("t"), F.concat_ws("|", F.lower(F.trim("name")), F.lower(F.trim("address")), "country").alias("k"))
    g = k.join(links.select("s1", "t"), "t", "left").groupBy("k").agg(F.count("*").alias("members"), F.count("s1").alias("linked"), F.count_distinct("s1").alias("queries"))
    return g.where("members > 1").groupBy("members", "linked", "queries").agg(F.count("*").alias("n"))


def id_leak(df: DataFrame, order: str, group: str) -> DataFrame:
    """One row (corr, mean_gap): correlation of rows' order and ids, and the gap between successive members of a group."""
    gap = F.col(order) - F.lag(order).over(_by(group).orderBy(order))
    return df.withColumn("gap", gap).agg(F.corr(F.col(order).cast("double"), F.col("x").cast("double")).alias("corr"), F.avg("gap").alias("mean_gap"))


def ensemble(a: DataFrame, b: DataFrame, p: str = "p") -> DataFrame:
    """Mean of two score tables over equal pairs."""
    return a.select("s1", "t", F.col(p).alias("pa")).join(b.select("s1", "t", F.col(p).alias("pb")), ["s1", "t"]).select("s1", "t", ((F.col("pa") + F.col("pb")) / 2).alias(p))


def alias_chain(view: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (s1, t, via): a candidate t whose alias is the full name of another candidate of the same query."""
    c = pairs.select("s1", "t")
    v = view.select(F.col("id").alias("t"), "ns", F.col("al_post").alias("alias"))
    a = c.join(v, "t")
    return a.where("alias <> ''").select("s1", "t", F.col("alias").alias("ns")).join(a.select("s1", F.col("t").alias("via"), "ns"), ["s1", "ns"]).where("t <> via").select("s1", "t", "via")


def address_class(acore1: Column, acore2: Column, hn1: Column, hn2: Column) -> Column:
    """Tempty, nonum, same (equal number, half of the words) or diff."""
    overlap = F.size(F.array_intersect(acore1, acore2)) / F.greatest(F.size(acore1), F.lit(1))
    return F.when(F.size(acore2) == 0, "Tempty").when(hn1.isNull() | hn2.isNull(), "nonum").when((hn1 == hn2) & (overlap >= 0.5), "same").otherwise("diff")


def transferred(new: DataFrame, old: DataFrame, links: DataFrame) -> DataFrame:
    """Links (s1, t) of new records that have the names and addresses of linked old ones: of a pair's texts, the least new query
    with the first and all new targets with the second."""
    k = ["name", "address"]
    text = lambda d, key, n: d.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}{n}") for c in k])
    told = links.join(text(old, "s1", "1"), "s1").join(text(old, "t", "2"), "t").select("name1", "address1", "name2", "address2").distinct()
    queries = new.where("source = 1").groupBy(F.col("name").alias("name1"), F.col("address").alias("address1")).agg(F.min("id").alias("s1"))
    return told.join(queries, ["name1", "address1"]).join(text(new.where("source > 1"), "t", "2"), ["name2", "address2"]).select("s1", "t")


def merge_rescored(old: DataFrame, new: DataFrame, country: str, p: str = "p") -> DataFrame:
    """Rows (s1, t, p, side): old pairs with one country's replaced by new ones; side tells of which table a pair is."""
    o, n = (d.select("s1", "t", F.col("country").alias(f"c_{x}"), F.col(p).alias(f"p_{x}")) for d, x in ((old, "o"), (new, "n")))
    x = o.join(n, ["s1", "t"], "full").where(F.col("c_n").isNotNull() | ~F.col("c_o").eqNullSafe(F.lit(country)))
    side = F.when(F.col("c_o").isNull() & F.col("p_o").isNull(), "new").when(F.col("c_n").isNull() & F.col("p_n").isNull(), "old").otherwise("both")
    return x.select("s1", "t", F.coalesce("p_n", "p_o").alias(p), side.alias("side"))
