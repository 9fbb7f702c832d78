"""From scored pairs (s1, t, p) to match sets: thresholds, exclusivity, expected scores, duplicates, rescue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import poisson, strings, vocab
from ..functions.text import ascii_fold, in_list

TH = 0.7
_by = Window.partitionBy


def target_rank(p: str = "p", tie: str = "s1") -> Column:
    return F.row_number().over(_by("t").orderBy(F.desc(p), tie))


def query_rank(p: str = "p") -> Column:
    return F.row_number().over(_by("s1").orderBy(F.desc(p), "t"))


def threshold(df: DataFrame, p: str = "p", at: float = TH) -> DataFrame:
    return df.where(F.col(p) >= at)


def exclusive(df: DataFrame, p: str = "p", at: float = TH) -> DataFrame:
    """Pairs that are their target's best and reach the threshold: a target belongs to one query at most."""
    return df.withColumn("_r", target_rank(p)).where((F.col("_r") == 1) & (F.col(p) >= at)).drop("_r")


def top_relative(df: DataFrame, p: str = "p", first: float = 0.6, at: float = 0.4, share: float = 0.7) -> DataFrame:
    """Pairs of at least `at` and `share` of the query's best, if that reaches `first`."""
    best = F.max(p).over(_by("s1"))
    return df.withColumn("_m", best).where((F.col("_m") >= first) & (F.col(p) >= at) & (F.col(p) >= share * F.col("_m"))).drop("_m")


def two_thresholds(df: DataFrame, p: str = "p", top: float = 0.6, rest: float = 0.75) -> DataFrame:
    """One threshold for a query's best pair, another for the others."""
    return df.withColumn("_r", query_rank(p)).where(F.col(p) >= F.when(F.col("_r") == 1, top).otherwise(rest)).drop("_r")


def _chosen(df: DataFrame, p: str, count) -> DataFrame:
    """The first k pairs of each query, k by a UDF over its descending scores; a query's candidates are bounded by top-K."""
    lists = df.groupBy("s1").agg(F.sort_array(F.collect_list(F.struct((-F.col(p)).alias("k"), "t"))).alias("x"))
    lists = lists.withColumn("c", count(F.transform("x", lambda e: -e["k"])))
    return lists.select("s1", F.col("c.e").alias("e"), F.posexplode("x").alias("pos", "x"), F.col("c.k").alias("k")).where("pos < k").select("s1", F.col("x.t").alias("t"), (-F.col("x.k")).alias(p))


def expected_best(df: DataFrame, p: str = "p", mu: float = 0.1, least: float = 0.005, most: int = 25) -> DataFrame:
    """The choice of largest expected F0.5 among a query's `most` best pairs, with a Poisson number of true links that are no
    candidates. The best are cut by rank first, so no list is longer."""
    best = df.where(F.col(p) >= least).withColumn("_r", query_rank(p)).where(F.col("_r") <= most)
    return _chosen(best, p, poisson.best_count_udf(poisson.poisson(mu, 3)))


def eligible(df: DataFrame, p: str = "p", least: float = 0.02) -> DataFrame:
    """Pairs that are their target's best, over all queries, and not hopeless."""
    return df.withColumn("_r", target_rank(p)).where((F.col("_r") == 1) & (F.col(p) >= least)).drop("_r")


def _decoded(el: DataFrame, p: str, low: float, high: float) -> DataFrame:
    unsure = el.where((F.col(p) >= low) & (F.col(p) < high)).select("s1").distinct()
    plain = el.where(F.col(p) >= TH).join(unsure, "s1", "left_anti")
    return plain.select("s1", "t", p).unionByName(_chosen(el.join(unsure, "s1", "left_semi"), p, poisson.best_count_udf()))


def expected_decode(df: DataFrame, p: str = "p", least: float = 0.02, low: float = 0.3, high: float = 0.95) -> DataFrame:
    """Exclusive pairs, chosen by expected F0.5 for queries with a pair in [low, high), by the threshold for the others."""
    return _decoded(eligible(df, p, least), p, low, high)


def decode_seen(df: DataFrame, p: str = "p", seen: str = "seen", least: float = 0.02, low: float = 0.3, high: float = 0.95) -> DataFrame:
    """expected_decode for countries with labels, the threshold for the others; targets belong to one query over both."""
    el = eligible(df, p, least)
    return _decoded(el.where(seen), p, low, high).unionByName(el.where(~F.col(seen) & (F.col(p) >= TH)).select("s1", "t", p))


def route(main: DataFrame, other: DataFrame, seen: DataFrame, p: str = "p") -> DataFrame:
    """Scores of main for countries in seen (country), of other for the rest."""
    return main.join(seen, "country", "left_semi").select("s1", "t", "country", p).unionByName(other.join(seen, "country", "left_anti").select("s1", "t", "country", p))


def duplicate_links(targets: DataFrame, links: DataFrame) -> DataFrame:
    """Links (s1, t) to add: unlinked members of groups of equal targets whose linked members all belong to one query."""
    norm = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    k = targets.select(F.col("id").alias("t"), F.concat_ws("|", norm("name"), norm("address"), "country").alias("k"))
    g = k.join(links.select("s1", "t"), "t", "left")
    one = g.groupBy("k").agg(F.count_distinct("s1").alias("n"), F.min("s1").alias("s1"), F.sum(F.when(F.col("s1").isNull(), 1).otherwise(0)).alias("free"), F.count_distinct("t").alias("size"))
    fix = one.where("n = 1 AND free > 0 AND size > 1").select("k", "s1")
    return g.where("s1 IS NULL").select("t", "k").join(fix, "k").select("s1", "t")


def _words(name: Column) -> Column:
    s = F.regexp_replace(ascii_fold(name), r"(?<=\b[a-z])\.(?=[a-z]\b)", "")
    return F.filter(F.array_distinct(F.split(F.replace(s, F.lit("."), F.lit("")), "[^a-z0-9]+")), lambda w: w != "")


def edit_kind(name1: Column, name2: Column) -> Column:
    """How the target's name differs: lf_change, lf_add, same_name, nooverlap, filler or other."""
    form, fill = in_list(vocab.RESCUE_FORMS), in_list(vocab.RESCUE_FILLERS)
    a, c = _words(name1), _words(name2)
    la, lc = F.filter(a, form), F.filter(c, form)
    a2, c2 = F.filter(a, lambda w: ~form(w)), F.filter(c, lambda w: ~form(w))
    same = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)
    return (
        F.when((F.size(la) > 0) & (F.size(lc) > 0) & ~same(la, lc), "lf_change").when(same(a2, c2), F.when((F.size(lc) > 0) & (F.size(la) == 0), "lf_add").otherwise("same_name"))
        .when(F.size(F.array_intersect(a2, c2)) == 0, "nooverlap").when(F.size(F.filter(F.array_except(c2, a2), lambda w: ~fill(w))) == 0, "filler").otherwise("other")
    )


def low_band_ok(name1: Column, name2: Column) -> Column:
    """The target's name adds nothing but fillers and legal letters, none of the banned ones, and shares a word."""
    words = lambda n: F.filter(F.array_distinct(F.split(ascii_fold(n), "[^a-z0-9]+")), lambda w: w != "")
    a, c = words(name1), words(name2)
    form, fill, ban = in_list(vocab.LOW_FORMS), in_list(vocab.LOW_FILLERS), in_list(vocab.LOW_BANNED)
    core = lambda x: F.filter(x, lambda w: ~form(w))
    new = F.array_except(c, a)
    return (F.size(F.array_intersect(core(a), core(c))) > 0) & (F.size(F.filter(new, lambda w: ~form(w) & ~fill(w))) == 0) & ~F.exists(new, ban)


def rescue(scores: DataFrame, links: DataFrame, records: DataFrame, view: DataFrame, p: str = "p") -> DataFrame:
    """Links (s1, t, p, kind) to add for queries without any: see the conditions in turn.

    The query's best pair; its target is nobody's and has no better query; equal first numbers; half of the query's address
    words shared; every street word close to a word of the target's address; p at least 0.2, or 0.05 for harmless edits; an
    edit of kind filler, lf_add or same_name; each target and query once, by p.
    """
    from ..functions.text import street_words

    empty = records.where("source = 1").select(F.col("id").alias("s1")).join(links.select("s1"), "s1", "left_anti")
    best_t = scores.groupBy("t").agg(F.max(p).alias("tmax"))
    b = scores.join(empty, "s1", "left_semi").withColumn("_r", query_rank(p)).where("_r = 1").drop("_r")
    b = b.join(links.select("t"), "t", "left_anti").join(best_t, "t").where((F.col(p) >= F.col("tmax")) & (F.col(p) >= 0.05)).select("s1", "t", p)
    words = F.filter("acore", lambda x: ~x.rlike("^[0-9]+$"))
    v = view.select("id", F.coalesce(F.try_element_at("nums", F.lit(1)), F.lit("")).alias("hn"), words.alias("st"), F.size("acore").alias("alen"))
    r = records.select("id", "name", "address").join(v, "id")
    for key, n in (("s1", "1"), ("t", "2")):
        b = b.join(r.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}{n}") for c in ("name", "address", "hn", "st", "alen")]), key)
    overlap = F.size(F.array_intersect("st1", "st2")) / F.greatest(F.size("st1"), F.lit(1))
    b = b.where((F.col("alen2") > 0) & (F.col("hn1") == F.col("hn2")) & (overlap >= 0.5))
    tw = F.filter(F.split(F.regexp_replace(ascii_fold(F.col("address2")), "[^a-z0-9]", " "), " +"), lambda w: w != "")
    b = b.withColumns({"ws": street_words(F.col("address1")), "tw": tw}).where("size(ws) > 0 AND size(tw) > 0")
    close = b.select("s1", "t", F.explode(F.array_distinct("ws")).alias("w"), "tw").select("s1", "t", "w", F.explode(F.array_distinct("tw")).alias("x"))
    close = close.withColumn("q", strings.udf(strings.ratio)(F.col("w"), F.col("x"))).groupBy("s1", "t", "w").agg(F.max("q").alias("q")).groupBy("s1", "t").agg(F.min("q").alias("q")).where("q >= 75")
    b = b.join(close.select("s1", "t"), ["s1", "t"], "left_semi").withColumns({"kind": edit_kind(F.col("name1"), F.col("name2")), "low": low_band_ok(F.col("name1"), F.col("name2"))})
    b = b.where((F.col(p) >= 0.2) | F.col("low")).where(F.col("kind").isin("filler", "lf_add", "same_name"))
    for key, tie in (("t", "s1"), ("s1", "t")):
        b = b.withColumn("_r", F.row_number().over(_by(key).orderBy(F.desc(p), tie))).where("_r = 1").drop("_r")
    return b.select("s1", "t", p, "kind")


def recall_rule(df: DataFrame, same: Column, p: str = "p", floor: float = 0.3) -> DataFrame:
    """p raised to just over the threshold for best pairs of the target for which `same` holds, from a floor."""
    up = same & (F.col(p) >= floor) & (target_rank(p) == 1)
    return df.withColumn("_u", up).withColumn(p, F.when(F.col("_u"), F.greatest(F.col(p), F.lit(TH + 0.0001))).otherwise(F.col(p))).drop("_u")
