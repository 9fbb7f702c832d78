"""Candidate pairs: compound keys of rare tokens, weighted by rarity, joined and ranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import in_list
from ..storage import written

#: Adds rs, a score by which a query's pool is cut, to a pool of pairs.
Ranker = Callable[[DataFrame], DataFrame]

#: Rarest name words, address words and numbers of a record that make keys, for queries and targets.
RAREST = {"s1": (4, 7, 3), "t": (4, 5, 2)}
KEY_TYPES = ["N1", "AA", "NP", "NA", "NN", "HA", "NH", "C"]
KEY_CAP, TOP_K = 300, 30


def base_view(prepared: DataFrame) -> DataFrame:
    """Records with bt (name words that can block), ntok (core or all name words), noaddr (no address word of 3 letters)."""
    stop = in_list(vocab.LEGAL | vocab.HONOR | vocab.BLOCK_STOP)
    bt = F.filter("nt", lambda t: ~stop(t))
    return prepared.select(
        "id", "source", "country", "nt", "core", "acore", F.when(F.size(bt) > 0, bt).otherwise(F.col("nt")).alias("bt"),
        F.when(F.size("core") > 0, F.col("core")).otherwise(F.col("nt")).alias("ntok"), (F.size(F.filter("acore", lambda t: F.length(t) >= 3)) == 0).alias("noaddr"),
    )


def _token_rows(view: DataFrame, *columns: str) -> DataFrame:
    """Rows (columns, dk, t): each distinct name word (n) and address token (a) of a record, in one pass over the records."""
    of = lambda kind, c: F.transform(F.array_distinct(c), lambda t: F.struct(F.lit(kind).alias("dk"), t.alias("t")))
    return view.select(*columns, F.inline(F.concat(of("n", "bt"), of("a", "acore"))))


def token_df(targets: DataFrame) -> DataFrame:
    """Rows (country, kind, t, df): how many targets have a name word (n) or address token (a). Counts combine before the shuffle."""
    return _token_rows(targets, "country").groupBy("country", F.col("dk").alias("kind"), "t").agg(F.count("*").alias("df"))


def rarest_tokens(view: DataFrame, dfs: DataFrame) -> DataFrame:
    """Rows (id, source, country, noaddr, n, a, h): each record's rarest words, address words and numbers, rarest first; unseen
    ones are rarest. Records without any have no row.

    A record's own tokens, which it held in one row before, are gathered once and cut: no window sorts them.
    """
    rows = _token_rows(view, "id", "source", "country", "noaddr")
    number = F.col("t").rlike("^[0-9]+$")
    rows = rows.withColumn("kind", F.when(F.col("dk") == "n", "n").when(number, "h").otherwise("a"))
    rows = rows.where(F.when(F.col("kind") == "n", F.length("t") >= 2).when(F.col("kind") == "h", F.col("t") != "0").otherwise(F.length("t") >= 3))
    rows = rows.join(dfs.withColumnRenamed("kind", "dk"), ["country", "dk", "t"], "left")
    kept = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t")))).alias(k)
    most = lambda i: F.when(F.col("source") == 1, RAREST["s1"][i]).otherwise(RAREST["t"][i])
    g = rows.groupBy("id", "source", "country", "noaddr").agg(*map(kept, "nah"))
    return g.select("id", "source", "country", "noaddr", *[F.transform(F.slice(k, F.lit(1), most(i)), lambda e: e["t"]).alias(k) for i, k in enumerate("nah")])


def keys(view: DataFrame, dfs: DataFrame) -> DataFrame:
    """Rows (id, source, country, noaddr, k, ty): each record's blocking keys, each once.

    Keys are made in place from the few tokens that rarest_tokens leaves a record. A key names its type, so only a record's
    keys of one type can be equal, and those are made distinct in the row: nothing is shuffled after the tokens.
    """
    key = lambda ty, x: F.struct(F.lit(KEY_TYPES.index(ty)).alias("ty"), F.concat(F.lit(ty), x).alias("k"))
    bar = F.lit("|")
    pairs = lambda ty, a, b, f: F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: f(x, y)), lambda y: key(ty, F.concat(x, bar, y)))))
    less, any_ = (lambda x, y: x < y), (lambda x, y: F.lit(True))
    cut4 = lambda ty, a: F.flatten(F.transform(a, lambda x: F.transform(F.filter(a, lambda y: x < y), lambda y: key(ty, F.concat(F.substring(x, 1, 4), bar, F.substring(y, 1, 4))))))
    n, a, h = map(F.col, "nah")
    single = F.when((F.col("source") == 1) | F.col("noaddr"), F.transform(n, lambda x: key("N1", x))).otherwise(F.array().cast("array<struct<ty:int,k:string>>"))
    every = F.concat(single, pairs("AA", a, a, less), cut4("NP", n), pairs("NA", n, a, any_), pairs("NN", n, n, less), pairs("HA", h, a, any_), pairs("NH", n, h, any_))
    own = ["id", "source", "country", "noaddr"]
    made = rarest_tokens(view, dfs).select(*own, F.inline(F.array_distinct(every)))
    whole = view.select(*own, F.inline(F.array_distinct(F.array(key("C", F.array_join("ntok", "")), key("C", F.array_join("nt", ""))))))
    return made.unionByName(whole).select(*own, "k", "ty")


def weighted_keys(target_keys: DataFrame, n_targets: int, cap: int = KEY_CAP) -> DataFrame:
    """Rows (country, k, df, w): keys of at most `cap` targets with their rarity ln N - ln df. What a key can join is bounded."""
    d = target_keys.groupBy("country", "k").agg(F.count("*").alias("df")).where(F.col("df") <= cap)
    return d.select("country", "k", "df", (F.ln(F.lit(float(n_targets))) - F.ln("df")).alias("w"))


def target_index(target_keys: DataFrame, n_targets: int, cap: int = KEY_CAP) -> DataFrame:
    """Rows (country, k, t, noaddr, w): what queries' keys are looked up in."""
    w = weighted_keys(target_keys, n_targets, cap).select("country", "k", "w")
    return target_keys.select("country", "k", F.col("id").alias("t"), "noaddr").join(w, ["country", "k"])


def candidate_pairs(query_keys: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (s1, t, bscore, nkeys, wmax, noaddr, w0 .. w7) of pairs that share a key; noaddr is the target's."""
    pairs = query_keys.select("country", "k", "ty", F.col("id").alias("s1")).join(index, ["country", "k"])
    by = [F.sum(F.when(F.col("ty") == i, F.col("w")).otherwise(0.0)).alias(f"w{i}") for i in range(len(KEY_TYPES))]
    return pairs.groupBy("s1", "t").agg(F.sum("w").alias("bscore"), F.count("*").alias("nkeys"), F.max("w").alias("wmax"), F.max(F.col("noaddr").cast("int")).alias("noaddr"), *by)


def ranked(pairs: DataFrame, score: str = "bscore") -> DataFrame:
    """pairs with brank, npool and brel within the query; equal scores by t. Scores are ranked at nine digits."""
    w, all_ = Window.partitionBy("s1").orderBy(F.desc(F.round(score, 9)), "t"), Window.partitionBy("s1")
    return pairs.withColumns({"brank": F.row_number().over(w), "npool": F.count("*").over(all_), "brel": F.col(score) / F.max(score).over(all_)})


def top_k(pairs: DataFrame, k: int = TOP_K, rank: str = "brank") -> DataFrame:
    return pairs.where(F.col(rank) <= k)


def reranked(pool: DataFrame, ranker: Ranker | None = None) -> DataFrame:
    """pool with rs, the ranker's score of a pair (without one, bscore), and rrank, its rank within the query, ties by t."""
    if ranker is None:
        return pool.withColumns({"rs": F.col("bscore"), "rrank": F.col("brank")})
    w = Window.partitionBy("s1").orderBy(F.desc(F.round("rs", 9)), "t")
    return ranker(pool).withColumn("rrank", F.row_number().over(w))


def competition(pairs: DataFrame) -> DataFrame:
    """pairs with t_ns1, and how each stands among its target's by the ranker (t_best, t_rank) and by rarity (t_bbest, t_brank)."""
    all_ = Window.partitionBy("t")
    rank = lambda c: F.row_number().over(all_.orderBy(F.desc(F.round(c, 9)), "s1"))
    return pairs.withColumns({"t_ns1": F.count("*").over(all_), "t_best": F.max("rs").over(all_), "t_rank": rank("rs"), "t_bbest": F.max("bscore").over(all_), "t_brank": rank("bscore")})


def raw_pool(prepared: DataFrame, queries: Column | None = None, cap: int = KEY_CAP) -> DataFrame:
    """All pairs that share a key, ranked within the query and uncut; of the queries (source 1) that the condition on id holds for.

    The view and the keys are written once each: weights, targets and queries read them, and nothing is prepared again.
    """
    view = written(base_view(prepared), "view")
    t = view.where("source > 1")
    asked = view if queries is None else view.where((F.col("source") > 1) | queries)
    every = written(keys(asked, token_df(t)), "keys")
    return ranked(candidate_pairs(every.where("source = 1"), target_index(every.where("source > 1"), t.count(), cap)))


def block(prepared: DataFrame, cap: int = KEY_CAP, k: int = TOP_K, ranker: Ranker | None = None, keep: DataFrame | None = None) -> DataFrame:
    """Candidate pairs of the queries (source 1) and targets (others) of prepared records: the best k of each query by the
    ranker, and their competition within targets. Without a ranker raw bscore ranks. keep (id): only these queries."""
    if keep is not None:
        prepared = prepared.where("source > 1").unionByName(prepared.where("source = 1").join(keep.select("id"), "id", "left_semi").select(prepared.columns))
    return competition(top_k(reranked(raw_pool(prepared, cap=cap), ranker), k, "rrank"))


def dense_union(lexical: DataFrame, dense: DataFrame, k: int = 10) -> DataFrame:
    """lexical pairs, then dense ones of rank k or better that aren't among them, with dense_only."""
    new = dense.where(F.col("drank") <= k).join(lexical.select("s1", "t"), ["s1", "t"], "left_anti").withColumn("dense_only", F.lit(1))
    old = lexical.join(dense.select("s1", "t", "dscore", "drank"), ["s1", "t"], "left").withColumn("dense_only", F.lit(0))
    return old.unionByName(new, allowMissingColumns=True)


def unassigned(targets: DataFrame, scored: DataFrame, score: str = "p2", at: float = 0.7) -> DataFrame:
    """Targets (t) that no query owns: none of their pairs is the target's best and reaches the threshold."""
    best = Window.partitionBy("t").orderBy(F.desc(score), "s1")
    owned = scored.withColumn("r", F.row_number().over(best)).where((F.col("r") == 1) & (F.col(score) >= at))
    return targets.join(owned.select("t"), "t", "left_anti")


def rare_address_pairs(view: DataFrame, known: DataFrame, pool: int = 15) -> DataFrame:
    """Pairs of equal country and first number that share an address word of at most `pool` targets, and aren't known yet."""
    rows = view.select("id", "source", "country", F.try_element_at(F.filter("acore", lambda t: t.rlike("^[0-9]+$")), F.lit(1)).alias("hn"), F.explode(F.array_distinct(F.filter("acore", lambda t: ~t.rlike("^[0-9]+$")))).alias("w")).where("hn IS NOT NULL")
    t = rows.where("source > 1").select("country", "hn", "w", F.col("id").alias("t"))
    few = t.groupBy("country", "hn", "w").agg(F.count("*").alias("pool")).where(F.col("pool") <= pool)
    s = rows.where("source = 1").select("country", "hn", "w", F.col("id").alias("s1"))
    found = s.join(t.join(few, ["country", "hn", "w"]), ["country", "hn", "w"]).groupBy("s1", "t").agg(F.count("*").alias("n_shared"))
    return found.join(known.select("s1", "t"), ["s1", "t"], "left_anti")


def same_name_number_pairs(view: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of equal country, core name and first number whose address words overlap by the share of the query's."""
    words = F.array_distinct(F.filter("acore", lambda t: ~t.rlike("^[0-9]+$")))
    rows = view.select("id", "source", "country", F.array_join("ntok", "").alias("cc"), F.try_element_at(F.filter("acore", lambda t: t.rlike("^[0-9]+$")), F.lit(1)).alias("hn"), words.alias("w")).where("hn IS NOT NULL")
    a = rows.where("source = 1").select(F.col("id").alias("s1"), "country", "cc", "hn", F.col("w").alias("w1"))
    b = rows.where("source > 1").select(F.col("id").alias("t"), "country", "cc", "hn", F.col("w").alias("w2"))
    overlap = F.size(F.array_intersect("w1", "w2")) / F.greatest(F.size("w1"), F.lit(1))
    return a.join(b, ["country", "cc", "hn"]).select("s1", "t", overlap.alias("overlap")).where(F.col("overlap") >= least)
