"""Evaluation: F0.5 per query and its mean, sweeps, slices, attribution of losses, recall of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from .decide import TH, exclusive, target_rank


def f05(tp: Column, k: Column, g: Column) -> Column:
    """5 TP / (G + 4 K); nothing wanted and nothing chosen is right, one of them wrong."""
    return F.when((g == 0) & (k == 0), 1.0).when((g == 0) | (k == 0), 0.0).otherwise(5.0 * tp / (g + 4.0 * k))


def per_query(everyone: DataFrame, truth: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (s1, ..., g, k, tp, f) for each query of everyone; truth and chosen are pairs (s1, t), each once."""
    g = truth.groupBy("s1").agg(F.count("*").alias("g"))
    hits = chosen.select("s1", "t").join(truth.select("s1", "t", F.lit(1).alias("y")), ["s1", "t"], "left")
    k = hits.groupBy("s1").agg(F.count("*").alias("k"), F.coalesce(F.sum("y"), F.lit(0)).alias("tp"))
    out = everyone.join(g, "s1", "left").join(k, "s1", "left").na.fill(0, ["g", "k", "tp"])
    return out.withColumn("f", f05(F.col("tp"), F.col("k"), F.col("g")))


def sweep(everyone: DataFrame, truth: DataFrame, scored: DataFrame, p: str, thresholds: list[float]) -> DataFrame:
    """Rows (th, excl, f, precision, recall): every threshold, with and without exclusivity, in one pass over the pairs."""
    marked = scored.join(truth.select("s1", "t", F.lit(1).alias("y_")), ["s1", "t"], "left").withColumn("r", target_rank(p))
    rows = marked.withColumn("th", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("excl", F.explode(F.array(F.lit(True), F.lit(False)))).where((F.col(p) >= F.col("th")) & (~F.col("excl") | (F.col("r") == 1)))
    k = rows.groupBy("th", "excl", "s1").agg(F.count("*").alias("k"), F.coalesce(F.sum("y_"), F.lit(0)).alias("tp"))
    g = everyone.select("s1").join(truth.groupBy("s1").agg(F.count("*").alias("g")), "s1", "left").na.fill(0, ["g"])
    grid = g.withColumn("th", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("excl", F.explode(F.array(F.lit(True), F.lit(False))))
    x = grid.join(k, ["th", "excl", "s1"], "left").na.fill(0, ["k", "tp"])
    return x.groupBy("th", "excl").agg(F.avg(f05(F.col("tp"), F.col("k"), F.col("g"))).alias("f"), (F.sum("tp") / F.sum("k")).alias("precision"), (F.sum("tp") / F.sum("g")).alias("recall"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both means, their difference, its standard error, and how many queries improved and worsened."""
    d = a.select("s1", F.col("f").alias("fa")).join(b.select("s1", F.col("f").alias("fb")), "s1").withColumn("d", F.col("fb") - F.col("fa"))
    sign = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return d.agg(F.avg("fa").alias("fa"), F.avg("fb").alias("fb"), F.avg("d").alias("delta"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"), sign(F.col("d") > 0).alias("improved"), sign(F.col("d") < 0).alias("worsened"))


def bootstrap(a: DataFrame, b: DataFrame, rounds: int = 200, seed: int = 0) -> DataFrame:
    """One row (delta, se, low, high): a Poisson bootstrap of the difference. Each query draws its weights by hash, in its row."""
    d = a.select("s1", F.col("f").alias("fa")).join(b.select("s1", F.col("f").alias("fb")), "s1").select("s1", (F.col("fb") - F.col("fa")).alias("d"))
    u = F.pmod(F.xxhash64("s1", "r", F.lit(seed)), F.lit(1_000_000)) / 1e6
    w = F.lit(0)
    total, edge = 0.36787944, 0.36787944
    for k in range(1, 8):  # inverse of the Poisson distribution with mean 1
        w = F.when(u >= total, k).otherwise(w)
        edge /= k
        total += edge
    rows = d.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", w)
    means = rows.groupBy("r").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("delta"), F.stddev_samp("m").alias("se"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def slices(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (slice, value, n, fa, fb, contrib): both means by each column's values, and the value's part in the difference."""
    j = a.select("s1", *columns, F.col("f").alias("fa")).join(b.select("s1", F.col("f").alias("fb")), "s1")
    total = float(max(1, a.count()))
    long = j.select("fa", "fb", F.inline(F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in columns])))
    return long.groupBy("slice", "value").agg(F.count("*").alias("n"), F.avg("fa").alias("fa"), F.avg("fb").alias("fb"), (F.sum(F.col("fb") - F.col("fa")) / F.lit(total)).alias("contrib"))


def size_bucket(g: Column) -> Column:
    return F.when(g == 0, "0").when(g == 1, "1").when(g <= 3, "2-3").otherwise("4+")


def attribution(everyone: DataFrame, truth: DataFrame, scored: DataFrame, p: str) -> DataFrame:
    """One row (actual, no_fp, all_tp): the mean as it is, without wrong links, and with all true candidates too."""
    chosen = exclusive(scored, p, TH)
    right = truth.select("s1", "t")
    a = per_query(everyone, truth, chosen).select("s1", F.col("f").alias("actual"))
    b = per_query(everyone, truth, chosen.join(right, ["s1", "t"], "left_semi")).select("s1", F.col("f").alias("no_fp"))
    c = per_query(everyone, truth, scored.join(right, ["s1", "t"], "left_semi")).select("s1", F.col("f").alias("all_tp"))
    return a.join(b, "s1").join(c, "s1").agg(*[F.avg(x).alias(x) for x in ("actual", "no_fp", "all_tp")])


def recall_at(truth: DataFrame, candidates: DataFrame, rank: str, ks: list[int]) -> DataFrame:
    """Rows (k, recall, complete): the share of true pairs, and of queries with all their pairs, among the first k candidates."""
    j = truth.select("s1", "t").join(candidates.select("s1", "t", F.col(rank).alias("r")), ["s1", "t"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.coalesce(F.col("r") <= F.col("k"), F.lit(False))
    q = j.groupBy("k", "s1").agg(F.sum(hit.cast("int")).alias("n"), F.count("*").alias("g"))
    return q.groupBy("k").agg((F.sum("n") / F.sum("g")).alias("recall"), F.avg((F.col("n") == F.col("g")).cast("double")).alias("complete"))


def missed(truth: DataFrame, candidates: DataFrame, prepared: DataFrame, name_like: Column | None = None, address_like: Column | None = None) -> DataFrame:
    """Rows (s1, t, cat): true pairs that are no candidates, by what their target looks like and how like the query it is.

    *_like: a similarity from 0 to 100 of columns that end in _1 and _2; else the token set score of the words' lines.
    """
    m = truth.select("s1", "t").join(candidates.select("s1", "t"), ["s1", "t"], "left_anti")
    r = prepared.select("id", "name", "address", "nt", "at", "acore", F.array_join("nt", " ").alias("nl"), F.array_join("acore", " ").alias("al"))
    for key, n in (("s1", "1"), ("t", "2")):
        m = m.join(r.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{n}") for c in r.columns[1:]]), key)
    if name_like is None or address_like is None:
        m = m.withColumn("_like", strings.scores({"n": ("tset", F.col("nl_1"), F.col("nl_2")), "a": ("tset", F.col("al_1"), F.col("al_2"))}))
    name_like = F.col("_like.n") if name_like is None else name_like
    address_like = F.col("_like.a") if address_like is None else address_like
    cat = (
        F.when(F.trim(F.coalesce("address_2", F.lit(""))) == "", "empty address").when(F.col("name_2").rlike("[ऀ-෿]"), "native script").when(F.col("name_2").rlike(r"(?i)\.com|www\.|^@"), "domain")
        .when(name_like < 50, "renamed").when(address_like < 50, "other address").otherwise("similar")
    )
    return m.select("s1", "t", cat.alias("cat"))


def channel_recall(truth: DataFrame, lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """One row: shares of true pairs that the lexical, the dense and either channel has, and new dense pairs per query."""
    mark = lambda d, n: d.select("s1", "t").distinct().withColumn(n, F.lit(1))
    j = truth.select("s1", "t").join(mark(lexical, "l"), ["s1", "t"], "left").join(mark(dense, "d"), ["s1", "t"], "left").na.fill(0, ["l", "d"])
    new = dense.select("s1", "t").join(lexical.select("s1", "t"), ["s1", "t"], "left_anti").agg(F.count("*").alias("new_pairs"))
    return j.agg(F.avg("l").alias("lexical"), F.avg("d").alias("dense"), F.avg(F.greatest("l", "d")).alias("either")).join(new, F.lit(True))


def readout(everyone: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (country, empty_a, empty_b, mean_a, mean_b, jaccard, changed_1k) of two decisions, without labels."""
    n = lambda d, c: d.groupBy("s1").agg(F.count("*").alias(c))
    both = a.select("s1", "t").join(b.select("s1", "t"), ["s1", "t"], "left_semi")
    x = everyone.join(n(a, "ka"), "s1", "left").join(n(b, "kb"), "s1", "left").join(n(both, "kc"), "s1", "left").na.fill(0, ["ka", "kb", "kc"])
    mean = lambda c: F.avg(c.cast("double"))
    same = (F.col("ka") == F.col("kc")) & (F.col("kb") == F.col("kc"))
    return x.groupBy("country").agg(
        mean(F.col("ka") == 0).alias("empty_a"), mean(F.col("kb") == 0).alias("empty_b"), F.avg("ka").alias("mean_a"), F.avg("kb").alias("mean_b"),
        (F.sum("kc") / (F.sum("ka") + F.sum("kb") - F.sum("kc"))).alias("jaccard"), (1000 * mean(~same)).alias("changed_1k"),
    )


def score_quantiles(scores: DataFrame, p: str, cut: float = 0.0) -> DataFrame:
    """Rows (country, n, mean, positive, q10, q50, q90) of scores (country, p), without labels: exact quantiles."""
    q = lambda x: F.percentile(p, x).alias(f"q{round(100 * x)}")
    return scores.where(F.col(p).isNotNull()).groupBy("country").agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.avg((F.col(p) > cut).cast("double")).alias("positive"), q(0.1), q(0.5), q(0.9))


def expected_f(everyone: DataFrame, scored: DataFrame, p: str) -> DataFrame:
    """Rows (s1, k, e): the F0.5 that the scores themselves promise for the exclusive choice."""
    x = scored.withColumn("sel", (target_rank(p) == 1) & (F.col(p) >= TH))
    g = x.groupBy("s1").agg(F.sum(p).alias("all"), F.sum(F.when(F.col("sel"), F.col(p)).otherwise(0.0)).alias("chosen"), F.sum(F.col("sel").cast("int")).alias("k"), F.sum(F.ln(F.lit(1.0) - F.least(F.col(p), F.lit(0.999999)))).alias("none"))
    x = everyone.select("s1").join(g, "s1", "left")
    e = F.when(F.col("k").isNull(), 1.0).when(F.col("k") == 0, F.exp("none")).otherwise(5.0 * F.col("chosen") / (F.col("all") + 4.0 * F.col("k")))
    return x.select("s1", F.coalesce("k", F.lit(0)).alias("k"), e.alias("e"))


def auc(df: DataFrame, p: str, y: str = "y") -> DataFrame:
    """One row (auc, logloss, accuracy): exact, ties as half. Any scores have an auc; the others take them for probabilities.

    Scores are counted first, and ranks run over distinct scores. A score's block is the first bits of its number in an order
    that keeps that of the scores, so there are some thousands at most whatever the scale: a running sum over blocks, and
    one within each.
    """
    c = df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    size = F.abs(F.col("p"))
    place = F.when(size == 0, 0).otherwise(F.floor(16 * (F.log2(size) + 64)).cast("int") + 1)  # sixteen blocks per power of two
    parts = c.withColumn("b", F.when(F.col("p") < 0, -F.greatest(F.lit(1), F.least(place, F.lit(4096)))).otherwise(F.greatest(F.lit(0), F.least(place, F.lit(4096)))))
    blocks = parts.groupBy("b").agg(F.sum("neg").alias("bneg"))
    run = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # over 8,193 blocks at most
    before = blocks.select("b", F.coalesce(F.sum("bneg").over(run), F.lit(0)).alias("below"))
    w = Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    r = parts.join(before, "b").withColumn("lower", F.col("below") + F.coalesce(F.sum("neg").over(w), F.lit(0)))
    q = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-7)), F.lit(1e-7))
    n = F.sum("pos") + F.sum("neg")
    return r.agg(
        (F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))).alias("auc"),
        (-(F.sum(F.col("pos") * F.ln(q)) + F.sum(F.col("neg") * F.ln(1 - q))) / n).alias("logloss"), (F.sum(F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(F.col("neg"))) / n).alias("accuracy"),
    )
