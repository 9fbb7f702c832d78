"""Queries of context, scorers, decisions, shift, evaluation and diagnostics over scored pairs (groups G to N)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import poisson, text, vocab
from ..operators import attrs, blocking, context, decide, dense, diagnose, evaluate, shift
from ..plans import models, scorers
from ..storage import written
from .common import query, r
from .records import BASE_SQL, DOCS, KEYS_SQL, PAIRS_SQL, PARTS, RANKER_SQL, RARE_SQL, RS, VIEW_SQL, part_pairs, prepared_sql

SP = fx.SCORED_PAIRS


def sp(spark, sf_dir):
    return fx.scored_pairs(spark, sf_dir)


def everyone(spark, sf_dir):
    """All customers with their nation."""
    n = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"), (F.col("n_regionkey") <= 2).alias("seen"))
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s1"), "c_nationkey").join(n, "c_nationkey").drop("c_nationkey")


EV = "ev AS (SELECT c_custkey AS s1, n_name AS country, n_regionkey <= 2 AS seen FROM customer JOIN nation ON n_nationkey = c_nationkey)"
EXCL = """rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p2 DESC, s1) AS rt, row_number() OVER (PARTITION BY s1 ORDER BY p2 DESC, t) AS rs FROM scored_pairs),
ex AS MATERIALIZED (SELECT * FROM rk WHERE rt = 1 AND p2 >= 0.7)"""
F05 = "CASE WHEN g = 0 AND k = 0 THEN 1.0 WHEN g = 0 OR k = 0 THEN 0.0 ELSE 5.0 * tp / (g + 4.0 * k) END"
PER = f"""gg AS (SELECT s1, count(*) AS g FROM scored_pairs WHERE y = 1 GROUP BY s1), kk AS (SELECT s1, count(*) AS k, sum(y) AS tp FROM ex GROUP BY s1),
per AS MATERIALIZED (SELECT ev.*, coalesce(g, 0) AS g, coalesce(k, 0) AS k, coalesce(tp, 0) AS tp, {F05.replace('g ', 'coalesce(g, 0) ').replace('k ', 'coalesce(k, 0) ').replace('k)', 'coalesce(k, 0))').replace('(g ', '(coalesce(g, 0) ')} AS f FROM ev LEFT JOIN gg USING (s1) LEFT JOIN kk USING (s1))"""


# --- G ---------------------------------------------------------------------------------------------------------------------

CTX_ATTRS = "at_ AS (SELECT id, coalesce(nums[1], '') AS hn, cc, CASE WHEN len(acore) > 0 THEN acs END AS acs, CASE WHEN len(nums) > 0 THEN array_to_string(list_sort(nums), ' ') END AS nums_k FROM view_)"


@query(fx.sql(*PARTS, VIEW_SQL, BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL, RANKER_SQL, CTX_ATTRS, """f AS (SELECT k.*, p.bscore, a.hn AS hs, b.hn AS ht, a.cc AS cs, b.cc AS ct, b.acs AS ac, b.nums_k AS nk FROM cut k JOIN pairs p USING (s1, t) JOIN at_ a ON a.id = s1 JOIN at_ b ON b.id = t)""",
    body=f"""SELECT s1, t, count(*) OVER (PARTITION BY s1) AS s1_ncand, {r('bscore / max(bscore) OVER (PARTITION BY s1)')} AS b_s1rel, {r('max(bscore) OVER (PARTITION BY t) - bscore')} AS t_bgap, {r('rs / max(rs) OVER (PARTITION BY s1)')} AS rs_s1rel, {r('max(rs) OVER (PARTITION BY t) - rs')} AS t_gap, (hs = ht)::BIGINT AS hn_hash_eq,
count(*) OVER (PARTITION BY s1, ht) - 1 AS cnt_same_hn, count(*) OVER (PARTITION BY s1, ct) - 1 AS cnt_same_cc, count(*) OVER (PARTITION BY s1, ac) - 1 AS cnt_same_acs, count(*) OVER (PARTITION BY s1, nk) - 1 AS cnt_same_nums,
(sum((hs = ht)::INT) OVER (PARTITION BY s1))::BIGINT AS s1_hn_support, (sum((cs = ct)::INT) OVER (PARTITION BY s1))::BIGINT AS s1_cc_support FROM f"""))
def g1_stage1_context(spark, sf_dir):
    """G1: context of candidate pairs by shared attributes, and by rarity's and a ranker's scores."""
    p = written(text.prepared(fx.part_records(spark, sf_dir)))
    pairs = blocking.block(p, k=5, ranker=lambda pool: pool.withColumn("rs", F.expr(RS)))
    out = context.stage1(pairs, attrs.record_attrs(attrs.record_view(p)))
    return out.select("s1", "t", "s1_ncand", "b_s1rel", "t_bgap", "rs_s1rel", "t_gap", "hn_hash_eq", "cnt_same_hn", "cnt_same_cc", "cnt_same_acs", "cnt_same_nums", "s1_hn_support", "s1_cc_support")


@query(fx.sql(SP, "x AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p1 DESC, s1) AS rt FROM scored_pairs), z AS (SELECT *, max(CASE WHEN rt = 1 THEN p1 END) OVER (PARTITION BY t) AS m1, coalesce(max(CASE WHEN rt = 2 THEN p1 END) OVER (PARTITION BY t), 0) AS m2 FROM x)",
    body=f"""SELECT s1, t, row_number() OVER (PARTITION BY s1 ORDER BY p1 DESC, t) AS p_rank_s1, {r('sum(p1) OVER (PARTITION BY s1)')} AS p_sum_s1, (sum((p1 >= 0.5)::INT) OVER (PARTITION BY s1))::BIGINT AS p_n50_s1, rt AS p_rank_t, count(*) OVER (PARTITION BY t) AS n_s1_t,
{r('sum(p1) OVER (PARTITION BY t)')} AS p_sum_t, {r('sum(p1) OVER (PARTITION BY s1, st) - p1')} AS p_same_st, {r('CASE WHEN rt = 1 THEN m2 ELSE m1 END')} AS p_t_other, {r('p1 - CASE WHEN rt = 1 THEN m2 ELSE m1 END')} AS p_t_margin, {r('p1 - max(p1) OVER (PARTITION BY s1)')} AS p_s1_gap, {r('sum(p1) OVER (PARTITION BY s1) - p1')} AS p_s1_others, {r('sum(CASE WHEN st = $$eq$$ THEN p1 ELSE 0 END) OVER (PARTITION BY s1)')} AS p_s1hn_support FROM z"""))
def g2_stage2_context(spark, sf_dir):
    """Context by scores, with the best score of the target elsewhere."""
    out = context.stage2(sp(spark, sf_dir).withColumn("eq", (F.col("st") == "eq").cast("int")), "p1", ("st",), "eq")
    return out.select("s1", "t", "p_rank_s1", "p_sum_s1", "p_n50_s1", "p_rank_t", "n_s1_t", "p_sum_t", "p_same_st", "p_t_other", "p_t_margin", "p_s1_gap", "p_s1_others", "p_s1hn_support")


@query(fx.sql(SP, """x AS (SELECT s1, t, CASE WHEN p1 BETWEEN 0.2 AND 0.8 THEN p2 END AS ce FROM scored_pairs), z AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ce DESC NULLS LAST, s1) AS rt, row_number() OVER (PARTITION BY s1 ORDER BY ce DESC NULLS LAST, t) AS rs FROM x),
w AS (SELECT *, max(CASE WHEN rt = 1 THEN ce END) OVER (PARTITION BY t) AS m1, coalesce(max(CASE WHEN rt = 2 THEN ce END) OVER (PARTITION BY t), 0) AS m2 FROM z)""",
    body=f"""SELECT s1, t, CASE WHEN ce IS NOT NULL THEN rs END AS ce_rank_s1_b, {r('CASE WHEN ce IS NOT NULL THEN max(ce) OVER (PARTITION BY s1) END')} AS ce_max_s1_b, CASE WHEN ce IS NOT NULL THEN (sum((ce >= 0.5)::INT) OVER (PARTITION BY s1))::BIGINT END AS ce_npos_s1_b,
{r('CASE WHEN ce IS NOT NULL THEN CASE WHEN rt = 1 THEN m2 ELSE m1 END END')} AS ce_t_other_b, {r('ce - CASE WHEN rt = 1 THEN m2 ELSE m1 END')} AS ce_t_margin_b FROM w"""))
def g4_scorer_context(spark, sf_dir):
    """Context of a score that only gated pairs have, with a suffix for its block."""
    x = sp(spark, sf_dir).select("s1", "t", F.when(F.col("p1").between(0.2, 0.8), F.col("p2")).alias("ce"))
    return context.scorer_context(x, "ce", "_b").select("s1", "t", "ce_rank_s1_b", "ce_max_s1_b", "ce_npos_s1_b", "ce_t_other_b", "ce_t_margin_b")


# --- H, I --------------------------------------------------------------------------------------------------------------------

FEATURES = ["p1", "p_rank_s1", "p_sum_s1", "p_rank_t", "p_t_margin"]


@query(fx.sql(SP, "x AS (SELECT s1, t, CASE WHEN p1 BETWEEN 0.2 AND 0.8 THEN p2 END AS a, CASE WHEN p1 >= 0.5 THEN 1 - p2 END AS b FROM scored_pairs), z AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY a DESC NULLS LAST, t) AS ra, row_number() OVER (PARTITION BY s1 ORDER BY b DESC NULLS LAST, t) AS rb FROM x)",
    body=f"""SELECT s1, t, {r('a')} AS ce, {r('b')} AS ce_x, CASE WHEN a IS NOT NULL THEN ra END AS ce_rank_s1, CASE WHEN b IS NOT NULL THEN rb END AS ce_rank_s1_x, {r('a - max(a) OVER (PARTITION BY s1)')} AS ce_gap_s1, {r('b - max(b) OVER (PARTITION BY s1)')} AS ce_gap_s1_x FROM z"""))
def g6_scorer_blocks(spark, sf_dir):
    """Two scorers' blocks of context within the query joined to the pairs, of which none is lost or repeated."""
    from ..plans.linkage import with_scorers

    x = sp(spark, sf_dir).select("s1", "t", "p1", "p2")
    one, two = x.where(F.col("p1").between(0.2, 0.8)).select("s1", "t", F.col("p2").alias("ce")), x.where("p1 >= 0.5").select("s1", "t", (1 - F.col("p2")).alias("ce"))
    out = written(with_scorers(x.select("s1", "t"), {"": one, "_x": two}))
    models.same_rows(x, out)
    return out.select("s1", "t", "ce", "ce_x", "ce_rank_s1", "ce_rank_s1_x", "ce_gap_s1", "ce_gap_s1_x")


@query()
def h1_out_of_fold(spark, sf_dir):
    """H1, H2: a second stage of trees on score context, each query scored by a model that didn't see it."""
    x = written(context.stage2(sp(spark, sf_dir), "p1", ("st",)).select("s1", "t", "y", *FEATURES))
    out, _ = models.out_of_fold(x, FEATURES, "p_oof", rounds=3, depth=3)
    return out.select("s1", "t", "fold", "p_oof")


@query()
def h3_fold_average(spark, sf_dir):
    """Models of all folds stored, loaded, and averaged over pairs that none of them saw."""
    from .records import scratch

    x = written(context.stage2(sp(spark, sf_dir), "p1", ("st",)).select("s1", "t", "y", "seen", *FEATURES))
    _, ms = models.out_of_fold(x.where("seen"), FEATURES, "p_oof", folds=2, rounds=3, depth=3)
    path = scratch(spark, "models")
    models.save(spark, path, ms, FEATURES)
    loaded, names = models.load(spark, path)
    return models.fold_average(loaded, x.where("NOT seen"), names, "p").select("s1", "t", "p")


@query(fx.sql(SP, body=f"SELECT s1, t, p1, ({fx.h_sql(11, 's1')} % 4) // 2 AS half FROM scored_pairs WHERE p1 BETWEEN 0.005 AND 0.995"))
def i1_gate(spark, sf_dir):
    """Pairs that a cheap score leaves open, with their half."""
    return scorers.gate(sp(spark, sf_dir)).select("s1", "t", "p1", "half")


@query(fx.sql(SP, f"g AS (SELECT *, ({fx.h_sql(11, 's1')} % 4) // 2 AS half FROM scored_pairs WHERE p1 BETWEEN 0.005 AND 0.995)", body=f"SELECT s1, t, {r('CASE WHEN half = 0 THEN (p1 + p2) / 2 ELSE p2 END')} AS ce FROM g"))
def i2_cross_fitted(spark, sf_dir):
    """Each half's pairs with the other half's model's score."""
    g = scorers.gate(sp(spark, sf_dir))
    return scorers.assemble([g.select("s1", "t", F.col("p2").alias("ce")), g.select("s1", "t", ((F.col("p1") + F.col("p2")) / 2).alias("ce"))], g)


@query(fx.sql(SP, body=f"SELECT s1, t, {r('CASE WHEN p1 BETWEEN 0.1 AND 0.9 THEN p2 ELSE p1 END')} AS ce FROM scored_pairs WHERE p2 BETWEEN 0.005 AND 0.995"))
def i3_regate(spark, sf_dir):
    """Only newly gated pairs are scored; old scores stay."""
    x = sp(spark, sf_dir)
    old = scorers.gate(x, "p1", 0.1, 0.9).select("s1", "t", F.col("p2").alias("ce"))
    gated = scorers.gate(x, "p2")
    new = scorers.newly_gated(gated, old).select("s1", "t", F.col("p1").alias("ce"))
    return scorers.merged(old, new, gated)


PAIRED = (*PARTS, BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL)
WORDS = "list_distinct(string_split(name || ' ; ' || address, ' '))"


@query(fx.sql(*PAIRED, body=f"SELECT s1, t, {r('len(list_intersect(a.w, b.w)) / len(a.w)')} AS ce FROM topk JOIN (SELECT id, {WORDS} AS w FROM part_records) a ON a.id = s1 JOIN (SELECT id, {WORDS} AS w FROM part_records) b ON b.id = t"))
def i4_pair_scorer(spark, sf_dir):
    """A plugged-in scorer over serialised candidate pairs, in batches of like length (here, the share of equal words)."""
    rec = fx.part_records(spark, sf_dir).select("id", F.concat_ws(" ; ", "name", "address").alias("x"))
    p = part_pairs(spark, sf_dir).select("s1", "t").join(rec.select(F.col("id").alias("s1"), F.col("x").alias("text_1")), "s1").join(rec.select(F.col("id").alias("t"), F.col("x").alias("text_2")), "t")
    share = lambda d: [len(set(a.split()) & set(b.split())) / len(set(a.split())) for a, b in zip(d.text_1, d.text_2)]
    return scorers.score_pairs(p, share)


DENSE_SQL = """s AS (SELECT q.id AS s1, t.id AS t, q.country, round(list_cosine_similarity(q.v::DOUBLE[], t.v::DOUBLE[]), 9) AS d FROM dense_vectors q JOIN dense_vectors t ON q.source = 1 AND t.source = 2 AND q.country = t.country),
dt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY d DESC, t) AS drank FROM s)"""


@query(fx.sql(fx.DENSE_VECTORS, DENSE_SQL, body="SELECT s1, t, drank, (round(d + 1e-12, 9) + 0.0) AS dscore FROM dt WHERE drank <= 10"))
def i8_dense_top_k(spark, sf_dir):
    """Exact nearest targets by cosine within a country."""
    return dense.top_k_cosine(fx.dense_vectors(spark, sf_dir), 10)


ENCODED = "s0 AS (SELECT id, source, country, string_split(name, ' ') AS w FROM part_records), s AS (SELECT q.id AS s1, t.id AS t, round(list_cosine_similarity(list_transform(range(1, 17), lambda i: len(list_filter(q.w, lambda x: ascii(x) % 16 = i - 1))::DOUBLE), list_transform(range(1, 17), lambda i: len(list_filter(t.w, lambda x: ascii(x) % 16 = i - 1))::DOUBLE)), 6) AS d FROM s0 q JOIN s0 t ON q.source = 1 AND t.source > 1 AND q.country = t.country), dt AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY d DESC, t) AS drank FROM s)"


@query(fx.sql(fx.PART_RECORDS, f"k AS (SELECT id FROM part_records WHERE source = 1 AND {fx.h_sql(2024, 'id')} % 1000 < 814)", ENCODED, body="SELECT s1, t, drank, (round(d + 1e-12, 9) + 0.0) AS dscore FROM dt WHERE drank <= 5 AND s1 IN (SELECT id FROM k)"))
def i7_encoded_search(spark, sf_dir):
    """Names encoded by a plugged-in encoder, stored as two matrices, and searched for the queries of a keep list."""
    import numpy as np

    from ..functions import ids
    from .records import scratch

    def letters(batch: list[str]) -> np.ndarray:
        return np.array([np.bincount([ord(w[0]) % 16 for w in x.split(" ")], minlength=16) for x in batch], float)

    rec = fx.part_records(spark, sf_dir)
    lines = rec.select("id", "source", "country", F.col("name").alias("x"))
    paths = [scratch(spark, f"matrix-{k}") for k in "ab"]
    for k, path in enumerate(paths):
        dense.encode(lines.where(F.col("id") % 2 == k), letters, 16).write.parquet(path)
    keep = rec.where("source = 1").where(ids.kept(F.col("id"))).select("id")
    found = dense.top_k_cosine(dense.matrices(spark, *paths), 5, keep, digits=6)
    return found.select("s1", "t", "drank", "dscore")


@query(fx.sql(fx.DENSE_VECTORS, DENSE_SQL, body="SELECT s1, t, CASE WHEN drank <= 2 THEN 0 ELSE 1 END::BIGINT AS dense_only, drank FROM dt WHERE drank <= 5"))
def d23_dense_union(spark, sf_dir):
    """Dense pairs that aren't among the lexical ones (here, the first two) added to them."""
    d = dense.top_k_cosine(fx.dense_vectors(spark, sf_dir), 10)
    return blocking.dense_union(d.where("drank <= 2").select("s1", "t"), d, 5).select("s1", "t", "dense_only", "drank")


@query(fx.sql(SP, body="SELECT p_partkey AS t FROM part WHERE p_partkey NOT IN (SELECT t FROM scored_pairs GROUP BY t HAVING max(p2) >= 0.97)"))
def d24_unassigned(spark, sf_dir):
    """Targets that nobody owns, at a threshold that many miss."""
    return blocking.unassigned(fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("t")), sp(spark, sf_dir), at=0.97)


@query(fx.sql(SP, "c AS (SELECT p2 AS p, sum(y) AS pos, sum(1 - y) AS neg FROM scored_pairs GROUP BY p2), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM c), q AS (SELECT *, greatest(least(p, 1 - 1e-7), 1e-7) AS q FROM w)",
    body=f"SELECT {r('sum(pos * (lower + neg / 2.0)) / (sum(pos) * sum(neg))')} AS auc, {r('-(sum(pos * ln(q)) + sum(neg * ln(1 - q))) / (sum(pos) + sum(neg))')} AS logloss, {r('sum(CASE WHEN p >= 0.5 THEN pos ELSE neg END) / (sum(pos) + sum(neg))')} AS accuracy FROM q"))
def i6_auc(spark, sf_dir):
    """Exact AUC, log loss and accuracy."""
    return evaluate.auc(sp(spark, sf_dir), "p2")


@query(fx.sql(SP, body=f"SELECT s1, t, {r('(p1 + p2) / 2')} AS ce FROM scored_pairs"))
def i9_mean_of_scorers(spark, sf_dir):
    """The mean of two scorers, which must have scored the same pairs."""
    x = sp(spark, sf_dir)
    return scorers.mean_of([x.select("s1", "t", F.col("p1").alias("ce")), x.select("s1", "t", F.col("p2").alias("ce"))])


@query(fx.sql(SP, body=f"SELECT s1, t, {r('CASE WHEN p1 < 0.6 THEN p1 WHEN p1 >= 0.4 THEN p2 END')} AS ce FROM scored_pairs WHERE p2 BETWEEN 0.005 AND 0.995"))
def i10_second_scorer(spark, sf_dir):
    """A second scorer's scores put together from those it has and new ones, each pair once; null where neither has it."""
    x = sp(spark, sf_dir)
    return scorers.merged(x.where("p1 < 0.6").select("s1", "t", F.col("p1").alias("ce")), x.where("p1 >= 0.4").select("s1", "t", F.col("p2").alias("ce")), scorers.gate(x, "p2"))


@query(fx.sql(SP, f"g AS (SELECT s1, t, y, {fx.h_sql(7, '(t * 1000003 + s1)')} AS h FROM scored_pairs WHERE p1 BETWEEN 0.005 AND 0.995)", body="SELECT s1, t, y::BIGINT AS y, h FROM g"))
def i11_gated_training(spark, sf_dir):
    """Gated pairs with labels, shuffled by hash, for training on the band that a cheap score leaves open."""
    return scorers.band_training(sp(spark, sf_dir), sp(spark, sf_dir).where("y = 1").select("s1", "t"))


@query(fx.sql(SP, body=f"SELECT s1, t, {r('CASE WHEN s1 % 7 = 0 OR t % 11 = 0 THEN NULL ELSE p1 END')} AS ce FROM scored_pairs"))
def i12_stale_scores(spark, sf_dir):
    """Scores of pairs of which a record has changed since are made null."""
    x = sp(spark, sf_dir).select("s1", "t", F.col("p1").alias("ce"))
    return scorers.without_stale(x, x.select("s1").distinct().where("s1 % 7 = 0"), x.select("t").distinct().where("t % 11 = 0"), ["ce"])


@query(fx.sql(SP, f"q AS (SELECT DISTINCT s1, {fx.h_sql(17, 's1')} AS h FROM scored_pairs), a AS (SELECT s1, 'train' AS part FROM q ORDER BY h, s1 LIMIT 40), b AS (SELECT s1, 'eval' AS part FROM q ORDER BY h DESC, s1 DESC LIMIT 10)", body="SELECT s1, part FROM a UNION ALL SELECT s1, part FROM b"))
def b11_train_eval(spark, sf_dir):
    """The first queries by hash to train on, the last to evaluate."""
    from ..functions import ids

    return ids.train_eval(sp(spark, sf_dir).select("s1").distinct(), "s1", 40, 10)


# --- J -------------------------------------------------------------------------------------------------------------------------


@query(fx.sql(SP, body="SELECT s1, t, p2 FROM scored_pairs WHERE p2 >= 0.7"))
def j1_threshold(spark, sf_dir):
    """Pairs over a threshold."""
    return decide.threshold(sp(spark, sf_dir), "p2").select("s1", "t", "p2")


@query(fx.sql(SP, EXCL, body="SELECT s1, t, p2 FROM ex"))
def j2_exclusive(spark, sf_dir):
    """Pairs over a threshold that are their target's best."""
    return decide.exclusive(sp(spark, sf_dir), "p2").select("s1", "t", "p2")


@query(fx.sql(SP, "x AS (SELECT *, max(p2) OVER (PARTITION BY s1) AS m FROM scored_pairs)", body="SELECT s1, t FROM x WHERE m >= 0.6 AND p2 >= 0.4 AND p2 >= 0.7 * m"))
def j3_top_relative(spark, sf_dir):
    """Pairs close to the query's best."""
    return decide.top_relative(sp(spark, sf_dir), "p2").select("s1", "t")


@query(fx.sql(SP, EXCL, body="SELECT s1, t FROM rk WHERE p2 >= CASE WHEN rs = 1 THEN 0.6 ELSE 0.75 END"))
def j4_two_thresholds(spark, sf_dir):
    """One threshold for the first pair, another for the rest."""
    return decide.two_thresholds(sp(spark, sf_dir), "p2").select("s1", "t")


PMF = "list_reduce(list_prepend([1.0::DOUBLE], list_transform(ps, lambda p: [p])), lambda d, q: list_transform(range(1, len(d) + 2), lambda i: coalesce(d[i], 0) * (1 - q[1]) + CASE WHEN i > 1 THEN d[i - 1] ELSE 0 END * q[1]))"


@query(fx.sql(SP, f"x AS (SELECT s1, list(p2 ORDER BY t) AS ps FROM scored_pairs WHERE p2 >= 0.9 GROUP BY s1), d AS (SELECT s1, len(ps) AS n, {PMF} AS d FROM x)", body=f"SELECT s1, n, {r('d[1]')} AS none, {r('d[-1]')} AS every, {r('list_max(d)')} AS mode FROM d"))
def j5_pmf(spark, sf_dir):
    """Distribution of the number of true pairs of a query, in the JVM."""
    x = sp(spark, sf_dir).where("p2 >= 0.9").groupBy("s1").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "p2"))), lambda e: e["p2"]).alias("ps"))
    d = x.withColumn("d", poisson.pmf_column(F.col("ps")))
    return d.select("s1", F.size("ps").alias("n"), F.element_at("d", 1).alias("none"), F.element_at("d", -1).alias("every"), F.array_max("d").alias("mode"))


def _pmf(ps: str) -> str:
    return PMF.replace("list_transform(ps,", f"list_transform({ps},")


def choice_sql(lists: str, missed: str) -> str:
    """CTEs from lists (s1, ps, ts) to ch (s1, k): the count of largest expected F0.5, by brute force over counts of hits."""
    e = "list_sum(list_transform(range(0, len(d)), lambda a: d[a + 1] * list_sum(list_transform(range(0, len(rr)), lambda b: rr[b + 1] * list_sum(list_transform(range(0, len(ms)), lambda m: ms[m + 1] * 5.0 * a / (a + b + m + 4 * k)))))))"
    return f"""ck AS (SELECT s1, unnest(range(0, len(ps) + 1)) AS k, ps, {missed} AS ms FROM {lists}),
cd AS (SELECT s1, k, ms, {_pmf('list_slice(ps, 1, k)')} AS d, {_pmf('list_slice(ps, k + 1, len(ps))')} AS rr FROM ck),
ce AS (SELECT s1, k, CASE WHEN k = 0 THEN rr[1] * ms[1] ELSE {e} END AS e FROM cd),
ch AS (SELECT s1, min(k) AS k FROM ce JOIN (SELECT s1, max(e) AS m FROM ce GROUP BY s1) USING (s1) WHERE e >= m - 1e-12 GROUP BY s1)"""


J6_SQL = ["x0 AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p2 DESC, t) AS rs FROM scored_pairs WHERE p2 >= 0.005)", "li AS (SELECT s1, list(p2 ORDER BY p2 DESC, t) AS ps FROM x0 WHERE rs <= 25 GROUP BY s1)", choice_sql("li", "[exp(-0.1), exp(-0.1) * 0.1, exp(-0.1) * 0.1 * 0.1 / 2, exp(-0.1) * 0.1 * 0.1 / 2 * 0.1 / 3]")]
J7_SQL = ["el AS MATERIALIZED (SELECT s1, t, seen, p2 FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p2 DESC, s1) AS rt FROM scored_pairs) WHERE rt = 1 AND p2 >= 0.02)", "un AS (SELECT DISTINCT s1 FROM el WHERE p2 >= 0.3 AND p2 < 0.95)",
    "li AS (SELECT s1, list(p2 ORDER BY p2 DESC, t) AS ps FROM el WHERE s1 IN (SELECT s1 FROM un) GROUP BY s1)", choice_sql("li", "[1.0::DOUBLE]"),
    "de AS (SELECT s1, t, p2, seen FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p2 DESC, t) AS rs FROM el) JOIN ch USING (s1) WHERE rs <= k UNION ALL SELECT s1, t, p2, seen FROM el WHERE p2 >= 0.7 AND s1 NOT IN (SELECT s1 FROM un))"]


@query(fx.sql(SP, *J6_SQL, body=f"SELECT s1, t, {r('p2')} AS p2 FROM x0 JOIN ch USING (s1) WHERE rs <= k"))
def j6_expected_best(spark, sf_dir):
    """The choice of largest expected F0.5, with links outside the candidates."""
    return decide.expected_best(sp(spark, sf_dir), "p2")


@query(fx.sql(SP, *J7_SQL, body=f"SELECT s1, t, {r('p2')} AS p2 FROM de"))
def j7_expected_decode(spark, sf_dir):
    """Exclusive pairs by expected F0.5 where a query is unsure, by threshold elsewhere."""
    return decide.expected_decode(sp(spark, sf_dir), "p2")


@query(fx.sql(SP, *J7_SQL, body=f"SELECT s1, t, {r('p2')} AS p2 FROM de WHERE seen UNION ALL SELECT s1, t, {r('p2')} FROM el WHERE NOT seen AND p2 >= 0.7"))
def j8_decode_seen(spark, sf_dir):
    """Expected decoding for labelled countries only."""
    return decide.decode_seen(sp(spark, sf_dir), "p2")


@query(fx.sql(SP, body=f"SELECT s1, t, country, {r('CASE WHEN seen THEN p2 ELSE p1 END')} AS p FROM scored_pairs"))
def j9_route(spark, sf_dir):
    """One model's scores for labelled countries, another's for the rest."""
    x = sp(spark, sf_dir)
    seen = everyone(spark, sf_dir).where("seen").select("country").distinct()
    return decide.route(x.select("s1", "t", "country", F.col("p2").alias("p")), x.select("s1", "t", "country", F.col("p1").alias("p")), seen)


LINKED = "lk AS (SELECT s1, t FROM doc_truth WHERE " + fx.h_sql(41, "t") + " % 2 = 0)"


@query(fx.sql(fx.DOC_RECORDS, fx.DOC_TRUTH, LINKED, "k AS (SELECT id AS t, concat_ws('|', trim(lower(coalesce(name, ''))), trim(lower(coalesce(address, ''))), country) AS k FROM doc_records WHERE source > 1), g AS (SELECT k.t, k.k, lk.s1 FROM k LEFT JOIN lk USING (t)), o AS (SELECT k, min(s1) AS s1 FROM g GROUP BY k HAVING count(DISTINCT s1) = 1 AND count(*) FILTER (s1 IS NULL) > 0 AND count(DISTINCT t) > 1)",
    body="SELECT o.s1, g.t FROM g JOIN o USING (k) WHERE g.s1 IS NULL"))
def j10_duplicates(spark, sf_dir):
    """Unlinked copies of targets linked to one query get its link."""
    rec = fx.doc_records(spark, sf_dir)
    links = fx.doc_truth(rec).where(fx.h(41, F.col("t")) % 2 == 0)
    return decide.duplicate_links(rec.where("source > 1"), links)


@query()
def j12_rescue(spark, sf_dir):
    """Links for queries without any, under the rescue's conditions, among candidates of equal numbers."""
    rec = fx.part_records(spark, sf_dir)
    v = written(attrs.record_view(text.prepared(rec)))
    scores = written(part_pairs(spark, sf_dir).select("s1", "t", (fx.h(51, F.col("s1"), F.col("t")) % 1_000_000 / 1e6).alias("p")))
    return decide.rescue(scores, decide.exclusive(scores, "p", 0.95), rec, v)


@query(fx.sql(*PAIRED, "w AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part_records)",
    body="""SELECT s1, topk.t, CASE WHEN len(list_intersect(a.w, b.w)) = len(a.w) AND len(a.w) = len(b.w) THEN 'same_name' WHEN len(list_intersect(a.w, b.w)) = 0 THEN 'nooverlap' WHEN len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) = 0 THEN 'filler' ELSE 'other' END AS kind
FROM topk JOIN w a ON a.id = s1 JOIN w b ON b.id = topk.t"""))
def j13_edit_kind(spark, sf_dir):
    """How candidates' names differ from the query's."""
    p = _joined(spark, sf_dir, fx.part_records(spark, sf_dir), {"name": "n"})
    return p.select("s1", "t", decide.edit_kind(F.col("n1"), F.col("n2")).alias("kind"))


@query(fx.sql(SP, EXCL, body=f"SELECT s1, t, {r('CASE WHEN st = $$eq$$ AND p2 >= 0.3 AND rt = 1 THEN greatest(p2, 0.7001) ELSE p2 END')} AS p2 FROM rk"))
def j15_recall_rule(spark, sf_dir):
    """Best pairs at the same address raised over the threshold."""
    return decide.recall_rule(sp(spark, sf_dir), F.col("st") == "eq", "p2").select("s1", "t", "p2")


# --- K -------------------------------------------------------------------------------------------------------------------------

BIN = lambda p: "CASE " + " ".join(f"WHEN {p} >= {b} THEN {b}::DOUBLE" for b in reversed(shift.BINS)) + " ELSE 0.0 END"
CELLS = f"""nq AS (SELECT country, seen, count(*) AS q FROM ev GROUP BY ALL), tot AS (SELECT sum(q)::DOUBLE AS q FROM nq WHERE seen),
lab AS (SELECT country, st, {BIN('p1')} AS bin, y FROM scored_pairs WHERE seen AND p1 >= 0.3), a AS (SELECT country, st, bin, count(*) AS n, sum(y) AS pos FROM lab GROUP BY ALL), pool AS (SELECT st, bin, sum(n) AS n, sum(pos) AS pos FROM a GROUP BY ALL),
b AS (SELECT country, seen, st, {BIN('p2')} AS bin, count(*) AS pairs_new FROM scored_pairs WHERE p2 >= 0.3 GROUP BY ALL),
c0 AS (SELECT b.country, b.st, b.bin, b.seen, pairs_new, CASE WHEN b.seen THEN a.n ELSE pool.n END AS n, CASE WHEN b.seen THEN a.pos ELSE pool.pos END AS pos, pairs_new / nq.q AS density_new, CASE WHEN b.seen THEN nq.q::DOUBLE ELSE tot.q END AS q
  FROM b JOIN nq USING (country) LEFT JOIN a ON a.country = b.country AND a.st = b.st AND a.bin = b.bin LEFT JOIN pool ON pool.st = b.st AND pool.bin = b.bin, tot),
c1 AS (SELECT country, st, bin, seen, pairs_new, coalesce(n, 0)::BIGINT AS pairs, coalesce(pos, 0)::BIGINT AS trues, density_new, n / q AS density, pos / q AS truth, (coalesce(pos, 0) + 1) / (coalesce(n, 0) + 2) AS precision FROM c0),
cells AS MATERIALIZED (SELECT *, density_new / (density + 1e-9) AS excess, least(1.0, (truth + 1e-7) / density_new / precision) AS factor FROM c1)"""
SIG = "sg AS (SELECT country, sum(density_new) / sum(density) AS scale FROM cells WHERE NOT seen AND bin = 0.95 AND st IN ('r1', 'r2', 'r6') GROUP BY country)"
MULT = """mu AS (SELECT country, st, bin, NOT seen AND st IN ('r4', 'r5', 'r7') AS everywhere, CASE WHEN pairs_new < 5 THEN 1.0 WHEN NOT seen AND st IN ('r4', 'r5', 'r7') THEN least(1.0, coalesce(scale, 1.0) * (truth + 1e-7) / density_new / precision)
  WHEN st IN ('r5', 'r7') AND excess >= 1.0 THEN factor ELSE 1.0 END AS m FROM cells LEFT JOIN sg USING (country))"""
CORR = f"""cr0 AS (SELECT s1, t, country, st, y, p1, p2, {BIN('p2')} AS bin FROM scored_pairs),
cr AS MATERIALIZED (SELECT s1, t, country, st, y, p2, CASE WHEN p2 >= 0.5 AND (p2 < 0.95 OR coalesce(everywhere, false)) THEN p2 * coalesce(m, 1.0) ELSE p2 END AS p2n FROM cr0 LEFT JOIN mu USING (country, st, bin))"""


def _cells(spark, sf_dir):
    x = sp(spark, sf_dir)
    n = everyone(spark, sf_dir).groupBy("country", "seen").agg(F.count("*").alias("n"))
    lab = x.where("seen").select("country", "st", "y", F.col("p1").alias("p2"))
    return shift.cells(lab, x, n.where("seen").drop("seen"), n.drop("seen"))


def _corrected(spark, sf_dir):
    c = written(_cells(spark, sf_dir))
    return shift.corrected(sp(spark, sf_dir), shift.multipliers(c, shift.typo_scale(c), least_excess=1.0, least_pairs=5))


@query(fx.sql(SP, EV, CELLS, body="SELECT country, st, bin, seen, pairs_new, pairs, trues, " + ", ".join(f"{r(c)} AS {c}" for c in ("density_new", "density", "truth", "precision", "excess", "factor")) + " FROM cells"))
def k3_cells(spark, sf_dir):
    """K2, K3: densities and expected precision by country, stratum and bin."""
    return _cells(spark, sf_dir)


@query(fx.sql(SP, EV, CELLS, SIG, body=f"SELECT country, {r('scale')} AS scale FROM sg"))
def k4_typo_scale(spark, sf_dir):
    """K4: how much more typos unlabelled countries have."""
    return shift.typo_scale(_cells(spark, sf_dir))


FORMS = ("''", "'inc'", "'llc'")
FORM_SQL = f"(['', 'inc', 'llc'])[{fx.h_sql(61, 's1')} % 3 + 1] AS f1, (['', 'inc', 'llc'])[{fx.h_sql(61, 't')} % 3 + 1] AS f2"


def _forms(x):
    k = F.array(F.lit(""), F.lit("inc"), F.lit("llc"))
    pick = lambda c: F.element_at(k, (fx.h(61, F.col(c)) % 3 + 1).cast("int"))
    return x.withColumns({"f1": pick("s1"), "f2": pick("t")})


@query(fx.sql(SP, f"x AS (SELECT *, {FORM_SQL} FROM scored_pairs WHERE p2 >= 0.5), z AS (SELECT *, (f1 <> '' AND f2 <> '' AND f1 <> f2)::INT::DOUBLE AS chg FROM x)",
    body=f"SELECT country, {r('coalesce(avg(chg) FILTER (st = $$eq$$ AND p2 >= 0.95), 0)')} AS c_true, {r('coalesce(avg(chg) FILTER (st IN ($$r5$$, $$r7$$)), 0)')} AS c_sib, coalesce(avg(chg) FILTER (st = 'eq' AND p2 >= 0.95), 0) < 0.005 AND coalesce(avg(chg) FILTER (st IN ('r5', 'r7')), 0) > 0.2 AS ok FROM z GROUP BY country"))
def k5_form_gate(spark, sf_dir):
    """K5: whether copies never change the legal form while neighbours do."""
    return shift.form_gate(_forms(sp(spark, sf_dir)))


GATE = f"""gx AS (SELECT *, {FORM_SQL} FROM scored_pairs WHERE p2 >= 0.5), gz AS (SELECT country, (f1 <> '' AND f2 <> '' AND f1 <> f2)::INT::DOUBLE AS chg, st, p2 FROM gx),
gt AS (SELECT country, coalesce(avg(chg) FILTER (st = 'eq' AND p2 >= 0.95), 0) < 0.4 AND coalesce(avg(chg) FILTER (st IN ('r5', 'r7')), 0) > 0.2 AS ok FROM gz GROUP BY country)"""


@query(fx.sql(SP, EV, CELLS, SIG, GATE, MULT.replace("USING (country))", "USING (country) LEFT JOIN gt USING (country) WHERE seen OR coalesce(ok, false))"), CORR, body=f"SELECT s1, t, {r('p2n')} AS p2n FROM cr"))
def k6_gated(spark, sf_dir):
    """K6: the correction held back in countries without labels that fail the gate (with a limit that some of them pass)."""
    x = sp(spark, sf_dir)
    c = written(_cells(spark, sf_dir))
    gate = shift.form_gate(_forms(x), most_true=0.4)
    return shift.corrected(x, shift.multipliers(c, shift.typo_scale(c), gate, least_excess=1.0, least_pairs=5)).select("s1", "t", "p2n")


@query(fx.sql(SP, EV, CELLS, SIG, MULT, CORR, body=f"SELECT s1, t, {r('p2n')} AS p2n FROM cr"))
def k7_corrected(spark, sf_dir):
    """K7: scores corrected by their cells' multipliers."""
    return _corrected(spark, sf_dir).select("s1", "t", "p2n")


@query(fx.sql(SP, EV, CELLS, SIG, MULT, CORR, EXCL, "nw AS (SELECT s1, t FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p2n DESC, s1) AS rt FROM cr) WHERE rt = 1 AND p2n >= 0.7)",
    body="SELECT s1, t, 'removed' AS change FROM ex WHERE (s1, t) NOT IN (SELECT (s1, t) FROM nw) UNION ALL SELECT s1, t, 'added' FROM nw WHERE (s1, t) NOT IN (SELECT (s1, t) FROM ex)"))
def k8_decision_diff(spark, sf_dir):
    """K8: links that the correction adds and removes."""
    x = _corrected(spark, sf_dir)
    return shift.decision_diff(decide.exclusive(x, "p2"), decide.exclusive(x, "p2n"))


@query(fx.sql(SP, body=f"SELECT s1, t, {r('CASE WHEN f1 <> $$$$ AND f2 <> $$$$ AND f1 <> f2 AND NOT seen THEN 0.0 ELSE p2 END')} AS p2n FROM (SELECT *, {FORM_SQL} FROM scored_pairs)"))
def k9_form_veto(spark, sf_dir):
    """K9: pairs of unlabelled countries that change the legal form get no score."""
    x = _forms(sp(spark, sf_dir)).withColumn("p2n", F.col("p2"))
    return shift.vetoed(x, shift.form_change(x.where("NOT seen"))).select("s1", "t", "p2n")


ADD_SQL = ",\n".join([BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL]) + """,
w AS (SELECT id, source, country, nt, CASE WHEN len(core) > 0 THEN core ELSE nt END AS core FROM prepared),
ad0 AS (SELECT s1, topk.t, a.country, list_distinct(list_filter(b.core, lambda x: NOT list_contains(a.nt, x) AND length(x) >= 2)) AS added, list_filter(list_distinct(a.core), lambda x: NOT list_contains(b.nt, x) AND length(x) >= 2) AS dropped
  FROM topk JOIN w a ON a.id = topk.s1 JOIN w b ON b.id = topk.t),
ad AS MATERIALIZED (SELECT s1, t, country, added[1] AS a, len(dropped) AS nd, dropped[1] AS d FROM ad0 WHERE len(added) = 1),
voc AS (SELECT country, a, count(*) AS n, count(*) FILTER (nd = 0) AS n_add, count(*) FILTER (nd > 0) AS n_repl FROM ad WHERE length(a) >= 4 GROUP BY ALL HAVING count(*) >= 20 AND count(*) FILTER (nd > 0) >= 10 * count(*) FILTER (nd = 0))"""


def _additions(spark, sf_dir):
    v = attrs.record_view(text.prepared(fx.part_records(spark, sf_dir)))
    return shift.single_additions(_joined(spark, sf_dir, v, {"nt": "nt", "core": "c", "country": "country"}).withColumn("country", F.col("country1")))


def _joined(spark, sf_dir, v, names):
    """Candidate pairs of the part records with columns of both records' view, ending in 1 and 2."""
    p = part_pairs(spark, sf_dir).select("s1", "t")
    for key, n in (("s1", "1"), ("t", "2")):
        p = p.join(v.select(F.col("id").alias(key), *[F.col(c).alias(f"{new}{n}") for c, new in names.items()]), key)
    return p


@query(fx.sql(*PARTS, ADD_SQL, body="SELECT country, a, n, n_add, n_repl FROM voc"))
def k10_type_words(spark, sf_dir):
    """Words that replace others far more often than they are added."""
    return shift.type_words(_additions(spark, sf_dir), 20)


@query(fx.sql(*PARTS, ADD_SQL, body="SELECT DISTINCT s1, t FROM ad JOIN voc USING (country, a) WHERE nd <= 1 AND NOT coalesce(starts_with(ad.a, d) OR starts_with(d, ad.a) OR levenshtein(ad.a, d) <= 2, false)"))
def k11_type_word_veto(spark, sf_dir):
    """Pairs whose added type word is no variant of what it replaces."""
    x = _additions(spark, sf_dir)
    return shift.type_word_veto(x, shift.type_words(x, 20))


@query(fx.sql(SP, EV, CELLS.replace("WHERE seen AND p1", "WHERE seen AND country <> 'NATION_2' AND p1").replace("SELECT country, seen, count(*) AS q FROM ev", "SELECT country, seen AND country <> 'NATION_2' AS seen, count(*) AS q FROM ev").replace("b AS (SELECT country, seen,", "b AS (SELECT country, seen AND country <> 'NATION_2' AS seen,"), SIG, MULT, CORR,
    "nw AS (SELECT s1, t, y FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p2n DESC, s1) AS rt FROM cr) WHERE rt = 1 AND p2n >= 0.7)",
    body="SELECT count(*) AS links, sum(y)::BIGINT AS right_links FROM nw JOIN ev USING (s1) WHERE country = 'NATION_2'"))
def k13_negative_control(spark, sf_dir):
    """A labelled country played as one without labels: what the correction does to its links."""
    x = sp(spark, sf_dir).withColumn("seen", F.col("seen") & (F.col("country") != "NATION_2"))
    n = everyone(spark, sf_dir).withColumn("seen", F.col("seen") & (F.col("country") != "NATION_2")).groupBy("country", "seen").agg(F.count("*").alias("n"))
    c = shift.cells(x.where("seen").select("country", "st", "y", F.col("p1").alias("p2")), x, n.where("seen").drop("seen"), n.drop("seen"))
    y = shift.corrected(x, shift.multipliers(c, shift.typo_scale(c), least_excess=1.0, least_pairs=5))
    return decide.exclusive(y, "p2n").where("country = 'NATION_2'").agg(F.count("*").alias("links"), F.sum("y").alias("right_links"))


@query(fx.sql(*PAIRED, "w AS (SELECT id, source, country, nt, CASE WHEN len(core) > 0 THEN core ELSE nt END AS core FROM prepared), " + f"x AS (SELECT unnest(list_filter(list_distinct(b.core), lambda e: NOT list_contains(a.nt, e))) AS w, ({fx.h_sql(71, 'a.id', 'b.id')} % 100 < 1)::INT AS y FROM topk JOIN w a ON a.id = topk.s1 JOIN w b ON b.id = topk.t)",
    body=f"SELECT w, count(*) AS n, {r('avg(y)')} AS rate FROM x GROUP BY w HAVING count(*) >= 20 AND avg(y) < 0.02"))
def k14_sibling_words(spark, sf_dir):
    """Extra words of targets that hardly ever stand in true pairs."""
    p = _joined(spark, sf_dir, attrs.record_view(text.prepared(fx.part_records(spark, sf_dir))), {"nt": "n", "core": "c"})
    p = p.select(F.array_except("c2", "n1").alias("extra"), (fx.h(71, F.col("s1"), F.col("t")) % 100 < 1).cast("int").alias("y"))
    return shift.sibling_words(p, 20, 0.02)


# --- L ---------------------------------------------------------------------------------------------------------------------------


def _truth(x):
    return x.where("y = 1").select("s1", "t")


@query(fx.sql(SP, EV, EXCL, PER, body=f"SELECT s1, country, g, k, tp::BIGINT AS tp, {r('f')} AS f FROM per"))
def l1_f05(spark, sf_dir):
    """L1: F0.5 of each query."""
    x = sp(spark, sf_dir)
    return evaluate.per_query(everyone(spark, sf_dir), _truth(x), decide.exclusive(x, "p2")).select("s1", "country", "g", "k", "tp", "f")


@query(fx.sql(SP, EV, EXCL, """grid AS (SELECT s1, th, excl FROM ev, (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS th), (SELECT unnest([true, false]) AS excl)), gg AS (SELECT s1, count(*) AS g FROM scored_pairs WHERE y = 1 GROUP BY s1),
kk AS (SELECT th, excl, rk.s1, count(*) AS k, sum(y) AS tp FROM rk, (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS th), (SELECT unnest([true, false]) AS excl) WHERE p2 >= th AND (NOT excl OR rt = 1) GROUP BY ALL),
x AS (SELECT th, excl, coalesce(g, 0) AS g, coalesce(k, 0) AS k, coalesce(tp, 0) AS tp FROM grid LEFT JOIN gg USING (s1) LEFT JOIN kk USING (th, excl, s1))""", body=f"SELECT th, excl, {r('avg(' + F05 + ')')} AS f, {r('sum(tp) / sum(k)')} AS precision, {r('sum(tp) / sum(g)')} AS recall FROM x GROUP BY th, excl"))
def l2_sweep(spark, sf_dir):
    """L2: thresholds with and without exclusivity."""
    x = sp(spark, sf_dir)
    return evaluate.sweep(everyone(spark, sf_dir), _truth(x), x.select("s1", "t", "p2"), "p2", [0.5, 0.7, 0.9])


def _two(spark, sf_dir):
    x, e = sp(spark, sf_dir), everyone(spark, sf_dir)
    one = lambda p: evaluate.per_query(e, _truth(x), decide.exclusive(x, p))
    return one("p1"), one("p2")


TWO = PER.replace("per AS", "per2 AS").replace("kk AS", "k2 AS").replace("JOIN kk", "JOIN k2") + ", ex1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p1 DESC, s1) AS r1 FROM scored_pairs) WHERE r1 = 1 AND p1 >= 0.7), " + PER.split("), ", 1)[1].replace("per AS", "per1 AS").replace("kk AS", "k1 AS").replace("JOIN kk", "JOIN k1").replace("FROM ex ", "FROM ex1 ") + ", j AS (SELECT a.s1, a.country, a.g, a.f AS fa, b.f AS fb FROM per1 a JOIN per2 b USING (s1))"


@query(fx.sql(SP, EV, EXCL, TWO, body=f"SELECT {r('avg(fa)')} AS fa, {r('avg(fb)')} AS fb, {r('avg(fb - fa)')} AS delta, {r('stddev_samp(fb - fa) / sqrt(count(*))')} AS se, count(*) FILTER (fb > fa) AS improved, count(*) FILTER (fb < fa) AS worsened FROM j"))
def l3_paired(spark, sf_dir):
    """L3: two scores compared on the same queries."""
    return evaluate.paired(*_two(spark, sf_dir))


@query(fx.sql(SP, EV, EXCL, PER, "o AS (SELECT s1, sum(y) AS o FROM scored_pairs GROUP BY s1), q AS (SELECT per.*, CASE WHEN g = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 5.0 * tp / (g + 4.0 * tp) END AS nf, CASE WHEN g = 0 THEN 1.0 WHEN coalesce(o, 0) = 0 THEN 0.0 ELSE 5.0 * o / (g + 4.0 * o) END AS al FROM per LEFT JOIN o USING (s1))",
    body=f"SELECT {r('avg(f)')} AS actual, {r('avg(nf)')} AS no_fp, {r('avg(al)')} AS all_tp FROM q"))
def l4_attribution(spark, sf_dir):
    """L4: what wrong and missed links cost."""
    x = sp(spark, sf_dir)
    return evaluate.attribution(everyone(spark, sf_dir), _truth(x), x.select("s1", "t", "p2"), "p2")


@query()
def l5_bootstrap(spark, sf_dir):
    """A bootstrap of the difference of two scores."""
    return evaluate.bootstrap(*_two(spark, sf_dir))


@query(fx.sql(SP, EV, EXCL, TWO, "z AS (SELECT 'country' AS slice, country AS value, fa, fb FROM j UNION ALL SELECT 'gb', CASE WHEN g = 0 THEN '0' WHEN g = 1 THEN '1' WHEN g <= 3 THEN '2-3' ELSE '4+' END, fa, fb FROM j)",
    body=f"SELECT slice, value, count(*) AS n, {r('avg(fa)')} AS fa, {r('avg(fb)')} AS fb, {r('sum(fb - fa) / (SELECT count(*) FROM j)')} AS contrib FROM z GROUP BY slice, value"))
def l6_slices(spark, sf_dir):
    """Two scores by country and number of true pairs."""
    a, b = _two(spark, sf_dir)
    return evaluate.slices(a.withColumn("gb", evaluate.size_bucket(F.col("g"))), b, ["country", "gb"])


@query(fx.sql(*DOCS, fx.DOC_TRUTH, BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL, "x AS (SELECT d.s1, k, coalesce(brank <= k, false)::INT AS h FROM doc_truth d LEFT JOIN topk USING (s1, t), (SELECT unnest([1, 5, 10, 20, 30]) AS k)), q AS (SELECT k, s1, sum(h) AS n, count(*) AS g FROM x GROUP BY ALL)",
    body=f"SELECT k::BIGINT AS k, {r('sum(n) / sum(g)')} AS recall, {r('avg((n = g)::INT)')} AS complete FROM q GROUP BY k"))
def l7_recall_at_k(spark, sf_dir):
    """Recall of blocking by rank."""
    rec = fx.doc_records(spark, sf_dir)
    return evaluate.recall_at(fx.doc_truth(rec), blocking.block(text.prepared(rec)), "brank", [1, 5, 10, 20, 30])


@query()
def l8_missed(spark, sf_dir):
    """True pairs that candidates lack (here, those of half the targets), by kind; names and addresses compared by token sets."""
    rec = fx.doc_records(spark, sf_dir)
    truth = fx.doc_truth(rec)
    return evaluate.missed(truth, truth.where(fx.h(81, F.col("t")) % 2 == 1), text.prepared(rec))


@query(fx.sql(SP, "l AS (SELECT * FROM scored_pairs WHERE p1 >= 0.3), d AS (SELECT * FROM scored_pairs WHERE p2 >= 0.6), t AS (SELECT s1, t, (p1 >= 0.3)::INT AS l, (p2 >= 0.6)::INT AS d FROM scored_pairs WHERE y = 1)",
    body=f"SELECT {r('avg(l)')} AS lexical, {r('avg(d)')} AS dense, {r('avg(greatest(l, d))')} AS either, (SELECT count(*) FROM d WHERE p1 < 0.3) AS new_pairs FROM t"))
def l9_channel_recall(spark, sf_dir):
    """Recall of two channels and of both."""
    x = sp(spark, sf_dir)
    return evaluate.channel_recall(_truth(x), x.where("p1 >= 0.3"), x.where("p2 >= 0.6"))


@query(fx.sql(fx.DENSE_VECTORS, DENSE_SQL, body=f"SELECT country, count(DISTINCT s1) AS queries, {r('avg(d) FILTER (drank = 1)')} AS best, {r('avg(d) FILTER (drank = 10)')} AS tenth FROM dt WHERE drank <= 10 GROUP BY country"))
def l10_dense_readout(spark, sf_dir):
    """Similarity of the first and tenth neighbour by country, without labels."""
    v = fx.dense_vectors(spark, sf_dir)
    d = dense.top_k_cosine(v, 10).join(v.select(F.col("id").alias("s1"), "country"), "s1")
    at = lambda k: F.avg(F.when(F.col("drank") == k, F.col("dscore")))
    return d.groupBy("country").agg(F.count_distinct("s1").alias("queries"), at(1).alias("best"), at(10).alias("tenth"))


@query(fx.sql(SP, EV, EXCL, "a AS (SELECT s1, t FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p1 DESC, s1) AS r1 FROM scored_pairs) WHERE r1 = 1 AND p1 >= 0.7), x AS (SELECT country, s1, (SELECT count(*) FROM a WHERE a.s1 = ev.s1) AS ka, (SELECT count(*) FROM ex WHERE ex.s1 = ev.s1) AS kb, (SELECT count(*) FROM a JOIN ex USING (s1, t) WHERE a.s1 = ev.s1) AS kc FROM ev)",
    body=f"SELECT country, {r('avg((ka = 0)::INT)')} AS empty_a, {r('avg((kb = 0)::INT)')} AS empty_b, {r('avg(ka)')} AS mean_a, {r('avg(kb)')} AS mean_b, {r('sum(kc) / (sum(ka) + sum(kb) - sum(kc))')} AS jaccard, {r('1000 * avg((NOT (ka = kc AND kb = kc))::INT)')} AS changed_1k FROM x GROUP BY country"))
def l11_readout(spark, sf_dir):
    """Two decisions compared without labels."""
    x = sp(spark, sf_dir)
    return evaluate.readout(everyone(spark, sf_dir), decide.exclusive(x, "p1"), decide.exclusive(x, "p2"))


@query(fx.sql(SP, body=f"SELECT country, count(*) AS n, {r('avg(p2)')} AS mean, {r('avg((p2 > 0.5)::INT)')} AS positive, {r('quantile_cont(p2, 0.1)')} AS q10, {r('quantile_cont(p2, 0.5)')} AS q50, {r('quantile_cont(p2, 0.9)')} AS q90 FROM scored_pairs WHERE p1 BETWEEN 0.005 AND 0.995 GROUP BY country"))
def l11_score_quantiles(spark, sf_dir):
    """Scores of gated pairs by country, without labels."""
    x = scorers.gate(sp(spark, sf_dir))
    return evaluate.score_quantiles(x, "p2", 0.5)


EXPF = f"""xf AS (SELECT s1, sum(p2) AS al, sum(CASE WHEN rt = 1 AND p2 >= 0.7 THEN p2 ELSE 0 END) AS ch, count(*) FILTER (rt = 1 AND p2 >= 0.7) AS k, sum(ln(1 - least(p2, 0.999999))) AS no FROM rk GROUP BY s1),
ef AS (SELECT ev.s1, ev.country, coalesce(k, 0) AS k, CASE WHEN k IS NULL THEN 1.0 WHEN k = 0 THEN exp(no) ELSE 5.0 * ch / (al + 4.0 * k) END AS e FROM ev LEFT JOIN xf USING (s1))"""


@query(fx.sql(SP, EV, EXCL, EXPF, body=f"SELECT s1, k, {r('e')} AS e FROM ef"))
def l12_expected_f(spark, sf_dir):
    """The F0.5 that the scores promise."""
    return evaluate.expected_f(everyone(spark, sf_dir), sp(spark, sf_dir), "p2")


BAND = "CASE WHEN p2 < 0.1 THEN 'a<0.1' WHEN p2 < 0.5 THEN 'b0.1-0.5' WHEN p2 < 0.7 THEN 'c0.5-0.7' WHEN p2 < 0.9 THEN 'd0.7-0.9' ELSE 'e>0.9' END"


@query(fx.sql(SP, body="SELECT country, " + ", ".join(f"count(*) FILTER ({BAND} = '{b}') AS \"{b}\"" for b in ("a<0.1", "b0.1-0.5", "c0.5-0.7", "d0.7-0.9", "e>0.9")) + " FROM scored_pairs GROUP BY country"))
def l13_band_pivot(spark, sf_dir):
    """L13, M7, N: pairs by country and band of score."""
    return diagnose.pivot_bands(sp(spark, sf_dir), "country", "p2", F.count(F.lit(1)), "n")


# --- M, N --------------------------------------------------------------------------------------------------------------------------


@query(fx.sql(SP, EV, f"n AS (SELECT country, count(*) AS q FROM ev GROUP BY country), b AS (SELECT country, {BAND} AS band, st, seen, y, p2 FROM scored_pairs), x AS (SELECT b.country, band, st, count(*) * 1000 / any_value(q) AS v, avg(p2) AS p FROM b JOIN n USING (country) WHERE y = 1 GROUP BY ALL), z AS (SELECT b.country, band, st, count(*) * 1000 / any_value(q) AS v, avg(p2) AS p FROM b JOIN n USING (country) WHERE y = 0 GROUP BY ALL)",
    body=f"SELECT country, band, st, {r('x.v')} AS per1k_a, {r('x.p')} AS p_a, {r('z.v')} AS per1k_b, {r('z.p')} AS p_b, {r('z.v / x.v')} AS ratio FROM x FULL JOIN z USING (country, band, st)"))
def m1_density(spark, sf_dir):
    """M1: density of two sets of pairs (true and false) by cell, of either (full join)."""
    x = sp(spark, sf_dir)
    n = everyone(spark, sf_dir).groupBy("country").agg(F.count("*").alias("n"))
    return diagnose.density(x.where("y = 1"), x.where("y = 0"), n, n)


NAMECLS = "CASE WHEN s1 % 3 = 0 THEN 'same' WHEN s1 % 3 = 1 THEN 'form' ELSE 'other' END"


@query(fx.sql(SP, EV, f"n AS (SELECT country, count(*) AS q FROM ev GROUP BY country), b AS (SELECT country, st || '/' || {NAMECLS} AS cell, seen, y, p2 FROM scored_pairs WHERE p2 >= 0.7), x AS (SELECT b.country, cell, count(*) * 1000 / any_value(q) AS v FROM b JOIN n USING (country) WHERE y = 1 GROUP BY ALL), z AS (SELECT b.country, cell, count(*) * 1000 / any_value(q) AS v FROM b JOIN n USING (country) GROUP BY ALL)",
    body=f"SELECT country, string_split(cell, '/')[1] AS st, string_split(cell, '/')[2] AS cls, {r('x.v')} AS per1k_a, {r('z.v')} AS per1k_b FROM x FULL JOIN z USING (country, cell)"))
def m8_strata_by_name(spark, sf_dir):
    """M8: links per thousand queries by address stratum and class of name, true and predicted side by side."""
    x = sp(spark, sf_dir).where("p2 >= 0.7").withColumn("cls", F.expr(NAMECLS))
    n = everyone(spark, sf_dir).groupBy("country").agg(F.count("*").alias("n"))
    return diagnose.link_density(x.where("y = 1"), x, n, n, ["st", "cls"])


@query(fx.sql(SP, body="SELECT s1, t, count(*) OVER (PARTITION BY s1, st) AS clus, max((p2 >= 0.7)::INT) OVER (PARTITION BY s1, st) = 1 AS eqacc FROM scored_pairs"))
def m2_cluster_signature(spark, sf_dir):
    """M2: candidates of a query that share an attribute, and whether one is accepted."""
    return diagnose.cluster_signature(sp(spark, sf_dir), "st").select("s1", "t", "clus", "eqacc")


@query(fx.sql(SP, "c AS (SELECT *, count(*) FILTER (p2 >= 0.3) OVER (PARTITION BY s1, st) AS clus FROM scored_pairs)", body=f"SELECT least(clus, 6) AS size, st, count(*) AS n, {r('avg(y)')} AS true_rate FROM c WHERE st IN ('r5', 'r7') GROUP BY 1, 2"))
def m22_cluster_rates(spark, sf_dir):
    """True rate of pairs with numbers close by, by how many of the query's candidates share their stratum."""
    return diagnose.cluster_rates(sp(spark, sf_dir).where(F.col("st").isin("r5", "r7")), "st", "p2", 0.3, 6)


@query(fx.sql(SP, EXCL, "n AS (SELECT s1, count(*) AS k FROM ex GROUP BY s1)", body=f"SELECT st, count(*) AS n_s1, {r('avg(coalesce(k, 0))')} AS mean_links FROM (SELECT DISTINCT s1, st FROM scored_pairs) LEFT JOIN n USING (s1) GROUP BY st"))
def m3_copy_count(spark, sf_dir):
    """M3: links of queries that have a candidate of each stratum."""
    x = sp(spark, sf_dir)
    return diagnose.copy_count(decide.exclusive(x, "p2"), x, "st")


@query(fx.sql(*PARTS, ADD_SQL, body="SELECT country, a, n_add, n_repl, n FROM (SELECT country, a, count(*) AS n, count(*) FILTER (nd = 0) AS n_add, count(*) FILTER (nd > 0) AS n_repl FROM ad GROUP BY ALL) WHERE n >= 5 AND length(a) >= 4"))
def m4_single_additions(spark, sf_dir):
    """M4: words added singly, by how often they replace another."""
    return shift.type_words(_additions(spark, sf_dir), 5, 0.0).select("country", "a", "n_add", "n_repl", "n")


@query(fx.sql(SP, "w AS (SELECT country, st, avg((n > 1)::INT) AS clustered, avg(y) AS rate FROM (SELECT *, count(*) OVER (PARTITION BY s1, st) AS n FROM scored_pairs) GROUP BY country, st)",
    body=f"SELECT {r('corr(clustered, rate)')} AS corr, count(*) AS n FROM w"))
def m5_cluster_correlation(spark, sf_dir):
    """M5: correlation of cells' share of clustered pairs with their true rate."""
    c = diagnose.cluster_signature(sp(spark, sf_dir), "st").groupBy("country", "st").agg(F.avg((F.col("clus") > 1).cast("double")).alias("c"), F.avg(F.col("y").cast("double")).alias("r"))
    return c.agg(F.corr("c", "r").alias("corr"), F.count("*").alias("n"))


@query(fx.sql(SP, body=f"SELECT country, st, count(*) AS n, {r('avg((p2 >= 0.7)::INT)')} AS accepted, {r('avg(y)')} AS true_rate FROM scored_pairs GROUP BY country, st"))
def m6_acceptance(spark, sf_dir):
    """M6: acceptance and true rate by cell."""
    return diagnose.acceptance(sp(spark, sf_dir), ["country", "st"])


@query(fx.sql(*PAIRED, "w AS (SELECT len(list_filter(b.nt, lambda e: NOT list_contains(a.nt, e))) > 0 AS ad, len(list_filter(a.nt, lambda e: NOT list_contains(b.nt, e))) > 0 AS dr FROM topk JOIN prepared a ON a.id = s1 JOIN prepared b ON b.id = topk.t)",
    body="SELECT CASE WHEN ad AND dr THEN 'drop+add' WHEN ad THEN 'add' WHEN dr THEN 'drop' ELSE 'same' END AS edit, count(*) AS n FROM w GROUP BY 1"))
def m6_edit_types(spark, sf_dir):
    """M6: how candidates' names differ by added and dropped words."""
    p = _joined(spark, sf_dir, text.prepared(fx.part_records(spark, sf_dir)), {"nt": "n"})
    return p.groupBy(diagnose.edit_type(F.col("n1"), F.col("n2")).alias("edit")).agg(F.count("*").alias("n"))


@query(fx.sql(SP, body=f"SELECT country, 'p1' AS feature, {r('median(p1)')} AS median FROM scored_pairs GROUP BY country UNION ALL SELECT country, 'p2', {r('median(p2)')} FROM scored_pairs GROUP BY country"))
def m7_medians(spark, sf_dir):
    """M7: medians of features by country, transposed."""
    return diagnose.medians(sp(spark, sf_dir), ["country"], ["p1", "p2"])


@query(fx.sql(SP, "a AS (SELECT st, count(*) AS n, avg(y) AS r FROM scored_pairs WHERE seen GROUP BY st), b AS (SELECT st, count(*) AS n, avg((p2 >= 0.7)::INT) AS r FROM scored_pairs WHERE NOT seen GROUP BY st)",
    body=f"SELECT st, a.n AS n_a, {r('a.r')} AS rate_a, b.n AS n_b, {r('b.r')} AS rate_b, {r('b.r - a.r')} AS gap FROM a JOIN b USING (st) WHERE a.n >= 10 AND b.n >= 10"))
def m9_drift(spark, sf_dir):
    """M9: true rate in labelled countries against acceptance in the others."""
    x = sp(spark, sf_dir)
    return diagnose.drift(x.where("seen"), x.where("NOT seen"), "st", 10)


@query(fx.sql(SP, EXCL, body="SELECT CASE WHEN p2 >= 0.7 AND rt = 1 THEN 'accepted' WHEN p2 >= 0.7 THEN 'lost' WHEN p2 >= 0.5 THEN 'near' ELSE 'low' END AS why, st, count(*) AS n FROM rk GROUP BY ALL"))
def m11_rejection(spark, sf_dir):
    """Why pairs aren't links."""
    return diagnose.rejection(sp(spark, sf_dir)).groupBy("why", "st").agg(F.count("*").alias("n"))


@query(fx.sql(SP, EV, EXCL, TWO, "o AS (SELECT * FROM ex1), d AS (SELECT s1, t, y, 'removed' AS change FROM ex1 WHERE (s1, t) NOT IN (SELECT (s1, t) FROM ex) UNION ALL SELECT s1, t, y, 'added' FROM ex WHERE (s1, t) NOT IN (SELECT (s1, t) FROM ex1)), q AS (SELECT s1, change, count(*) AS n, sum(y) AS y FROM d GROUP BY ALL)",
    body=f"SELECT change, sum(n)::BIGINT AS n, {r('sum(y) / sum(n)')} AS true_share, {r('avg(fb - fa)')} AS df FROM q JOIN j USING (s1) GROUP BY change"))
def m12_impact(spark, sf_dir):
    """What added and removed links change."""
    x = sp(spark, sf_dir)
    return diagnose.impact(everyone(spark, sf_dir), _truth(x), decide.exclusive(x, "p1"), decide.exclusive(x, "p2"))


@query(fx.sql(SP, EV, EXCL, PER, body=f"SELECT country, k, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY country)')} AS share FROM per GROUP BY country, k"))
def m13_copy_profile(spark, sf_dir):
    """Numbers of links by country."""
    x = sp(spark, sf_dir)
    return diagnose.copy_profile(everyone(spark, sf_dir), decide.exclusive(x, "p2"))


@query(fx.sql(*PAIRED, "hn AS (SELECT *, list_filter(acore, lambda t: regexp_full_match(t, '[0-9]+'))[1] AS hn FROM base)",
    body="SELECT CASE WHEN len(b.acore) = 0 THEN 'Tempty' WHEN a.hn IS NULL OR b.hn IS NULL THEN 'nonum' WHEN a.hn = b.hn AND len(list_intersect(a.acore, b.acore)) / greatest(len(a.acore), 1) >= 0.5 THEN 'same' ELSE 'diff' END AS cls, count(*) AS n FROM topk JOIN hn a ON a.id = s1 JOIN hn b ON b.id = topk.t GROUP BY 1"))
def m14_address_class(spark, sf_dir):
    """Candidate pairs by how their addresses compare."""
    v = blocking.base_view(text.prepared(fx.part_records(spark, sf_dir))).select("id", "acore", F.try_element_at(text.numbers(F.col("acore")), F.lit(1)).alias("hn"))
    p = _joined(spark, sf_dir, v, {"acore": "a", "hn": "h"})
    return p.groupBy(diagnose.address_class(*[F.col(c) for c in ("a1", "a2", "h1", "h2")]).alias("cls")).agg(F.count("*").alias("n"))


@query(fx.sql(SP, EV, EXCL, PER, body=f"SELECT country, {r('avg((k = 0)::INT)')} AS empty_pred, {r('avg((g = 0)::INT)')} AS empty_true, {r('avg(k)')} AS mean_pred, {r('avg(g)')} AS mean_true, {r('avg(k - tp)')} AS fp, {r('avg(g - tp)')} AS fn FROM per GROUP BY country"))
def m15_moments(spark, sf_dir):
    """Predicted and true moments by country."""
    x = sp(spark, sf_dir)
    return diagnose.moments(everyone(spark, sf_dir), _truth(x), decide.exclusive(x, "p2"))


@query(fx.sql(SP, EV, EXCL, "m AS (SELECT s1, max(p2) AS p2 FROM scored_pairs GROUP BY s1)", body=f"SELECT country, CASE WHEN p2 IS NOT NULL THEN {BAND} END AS band, count(*) AS n FROM ev LEFT JOIN m USING (s1) WHERE s1 NOT IN (SELECT s1 FROM ex) GROUP BY 1, 2"))
def m16_rescue_bands(spark, sf_dir):
    """Queries without links by their best score."""
    x = sp(spark, sf_dir)
    return diagnose.rescue_bands(everyone(spark, sf_dir), decide.exclusive(x, "p2"), x)


ALIASED = """al AS (SELECT p.id, p.source, p.country, CASE WHEN p.id % 4 = 1 THEN p.name || ' dba ' || q.name ELSE p.name END AS name, p.address FROM part_records p JOIN part_records q ON q.id % 10000000000 = (p.id % 10000000000 + 1) % (SELECT count(*) FROM part))"""


@query(fx.sql(fx.PART_RECORDS, ALIASED, prepared_sql("al"), VIEW_SQL, BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL, body="SELECT x.s1, x.t, z.t AS via FROM topk x JOIN view_ a ON a.id = x.t JOIN topk z ON z.s1 = x.s1 AND z.t <> x.t JOIN view_ b ON b.id = z.t AND b.ns = a.al_post WHERE a.al_post <> ''"))
def m17_alias_chain(spark, sf_dir):
    """Candidates whose alias is another candidate's name, among parts of which some trade under the next one's name."""
    rec = fx.part_records(spark, sf_dir)
    n = rec.count()
    nxt = rec.select(((F.col("id") % 10_000_000_000 + n - 1) % n).alias("k"), F.col("name").alias("other"))
    named = rec.withColumn("k", F.col("id") % 10_000_000_000).join(nxt, "k")
    rec = named.withColumn("name", F.when(F.col("id") % 4 == 1, F.concat("name", F.lit(" dba "), "other")).otherwise(F.col("name"))).select(rec.columns)
    p = written(text.prepared(rec))
    return diagnose.alias_chain(attrs.record_view(p), blocking.block(p))


@query("WITH x AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders) SELECT (round(corr(k, c) + 1e-12, 9) + 0.0) AS corr, (round(avg(gap) + 1e-12, 9) + 0.0) AS mean_gap FROM x")
def m18_id_leak(spark, sf_dir):
    """Correlation of order and id, and gaps between members of a group."""
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("x"))
    return diagnose.id_leak(o, "k", "x")


@query(fx.sql(fx.DOC_RECORDS, fx.DOC_TRUTH, "o AS (SELECT * FROM doc_records WHERE id % 2 = 0), n AS (SELECT * FROM doc_records WHERE id % 2 = 1), ol AS (SELECT DISTINCT a.name AS na, a.address AS aa, b.name AS nb, b.address AS ab FROM doc_truth d JOIN o a ON a.id = d.s1 JOIN o b ON b.id = d.t), na_ AS (SELECT name, address, min(id) AS s1 FROM n WHERE source = 1 GROUP BY ALL)",
    body="SELECT s1, b.id AS t FROM ol JOIN na_ a ON a.name = na AND a.address = aa JOIN n b ON b.name = nb AND b.address = ab AND b.source > 1"))
def m18_transfer(spark, sf_dir):
    """Links that new records inherit, as records with their texts are linked in the old data."""
    rec = fx.doc_records(spark, sf_dir)
    return diagnose.transferred(rec.where("id % 2 = 1"), rec.where("id % 2 = 0"), fx.doc_truth(rec))


@query(fx.sql(SP, "old AS (SELECT s1, t, country, p1 AS p FROM scored_pairs WHERE s1 % 5 <> 0), new AS (SELECT s1, t, country, p2 AS p FROM scored_pairs WHERE country = 'NATION_3')", body=f"SELECT s1, t, {r('coalesce(new.p, old.p)')} AS p, CASE WHEN old.s1 IS NULL THEN 'new' WHEN new.s1 IS NULL THEN 'old' ELSE 'both' END AS side FROM old FULL JOIN new USING (s1, t) WHERE new.s1 IS NOT NULL OR old.country <> 'NATION_3'"))
def m25_merge_rescored(spark, sf_dir):
    """A country's pairs, scored again, put in the place of its old ones, with which side has each pair."""
    x = sp(spark, sf_dir)
    old, new = x.where("s1 % 5 <> 0").select("s1", "t", "country", F.col("p1").alias("p")), x.where("country = 'NATION_3'").select("s1", "t", "country", F.col("p2").alias("p"))
    return diagnose.merge_rescored(old, new, "NATION_3")


@query(fx.sql(fx.DOC_RECORDS, fx.DOC_TRUTH, LINKED, "k AS (SELECT id AS t, concat_ws('|', lower(trim(name)), lower(trim(address)), country) AS k FROM doc_records WHERE source > 1), g AS (SELECT k, count(*) AS members, count(s1) AS linked, count(DISTINCT s1) AS queries FROM k LEFT JOIN lk USING (t) GROUP BY k)",
    body="SELECT members, linked, queries, count(*) AS n FROM g WHERE members > 1 GROUP BY ALL"))
def m19_duplicate_report(spark, sf_dir):
    """Groups of equal targets by links."""
    rec = fx.doc_records(spark, sf_dir)
    return diagnose.duplicate_report(rec.where("source > 1"), fx.doc_truth(rec).where(fx.h(41, F.col("t")) % 2 == 0))


@query(fx.sql(*DOCS, fx.DOC_TRUTH, BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL, VIEW_SQL, f"ms AS (SELECT s1, t FROM doc_truth WHERE (s1, t) NOT IN (SELECT (s1, t) FROM topk WHERE brank <= 1 AND {fx.h_sql(83, 's1')} % 2 = 0))",
    body="""SELECT m.s1, m.t, CASE WHEN trim(b.address) = '' THEN 'empty address' WHEN regexp_matches(b.name, '[ऀ-෿]') THEN 'native script' WHEN regexp_matches(b.name, '(?i)\\.com|www\\.|^@') THEN 'domain' WHEN len(list_intersect(a.nt, b.nt)) * 2 < len(list_distinct(a.nt)) THEN 'renamed'
WHEN len(list_intersect(va."at", vb."at")) * 2 < len(list_distinct(va."at")) THEN 'other address' ELSE 'similar' END AS cat FROM ms m JOIN view_ a ON a.id = m.s1 JOIN view_ b ON b.id = m.t JOIN prepared va ON va.id = m.s1 JOIN prepared vb ON vb.id = m.t"""))
def m20_blocking_miss(spark, sf_dir):
    """True pairs that blocking lacks (kept: the first candidate, of half the queries), by kind."""
    rec = fx.doc_records(spark, sf_dir)
    p = written(text.prepared(rec))
    found = blocking.block(p, k=1).where(fx.h(83, F.col("s1")) % 2 == 0)
    return evaluate.missed(fx.doc_truth(rec), found, p, _word_share("nt"), _word_share("at"))


def _word_share(c):
    """Whether half of the query's words stand in the target's list, as 0 or 100."""
    a, b = F.array_distinct(f"{c}_1"), F.col(f"{c}_2")
    return F.when(F.size(F.array_intersect(a, b)) * 2 < F.size(a), 0.0).otherwise(100.0)


@query(fx.sql(SP, body=f"SELECT s1, t, {r('(p1 + p2) / 2')} AS p FROM scored_pairs"))
def m21_ensemble(spark, sf_dir):
    """Mean of two score tables."""
    x = sp(spark, sf_dir)
    return diagnose.ensemble(x.select("s1", "t", F.col("p1").alias("p")), x.select("s1", "t", F.col("p2").alias("p")))


@query(fx.sql(SP, "a AS (SELECT country, count(*) AS n, quantile_cont(p1, 0.5) AS q, stddev_samp(p1) AS s, corr(p1, p2) AS c FROM scored_pairs WHERE st = 'eq' GROUP BY country), b AS (SELECT country, count(*) AS n FROM scored_pairs WHERE st = 'r4' AND p2 >= 0.7 GROUP BY country)",
    body=f"SELECT country, a.n AS n_a, {r('q')} AS q, {r('s')} AS s, {r('c')} AS c, b.n AS n_b FROM a FULL JOIN b USING (country)"))
def n1_relational(spark, sf_dir):
    """N: full join with coalesced keys, quantile, deviation and correlation by group."""
    x = sp(spark, sf_dir)
    a = x.where("st = 'eq'").groupBy("country").agg(F.count("*").alias("n_a"), F.percentile("p1", 0.5).alias("q"), F.stddev_samp("p1").alias("s"), F.corr("p1", "p2").alias("c"))
    return a.join(x.where("st = 'r4' AND p2 >= 0.7").groupBy("country").agg(F.count("*").alias("n_b")), "country", "full")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, (round(avg(value) + 1e-12, 9) + 0.0) AS mean_value FROM events GROUP BY ALL")
def o1_windowed_counts(spark, sf_dir):
    """O: the windowed aggregate that also runs as a stream."""
    from ..streaming.incremental import windowed_counts

    return windowed_counts(fx.table(spark, sf_dir, "events"))


@query()
def o2_incremental_linkage(spark, sf_dir):
    """O: queries that arrive as a stream, linked to stored target keys batch by batch."""
    from ..streaming import incremental
    from .records import scratch

    rec = fx.part_records(spark, sf_dir)
    path = scratch(spark, "stream")
    rec.where("source = 1").write.parquet(f"{path}/in")
    incremental.target_index(rec.where("source > 1"), f"{path}/index")
    stream = spark.readStream.schema(rec.schema).parquet(f"{path}/in")
    incremental.link_stream(stream, f"{path}/index", f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("epoch").select("s1", "t", "bscore", "nkeys", "brank")


@query()
def z1_linkage(spark, sf_dir):
    """The whole job with the library's settings: ranker, blocking, features, two cross-fitted stages, expected-F0.5 decoding."""
    from ..plans.linkage import LinkageConfig, link

    rec = fx.part_records(spark, sf_dir)
    return link(rec, fx.part_truth(rec), LinkageConfig(rank_permille=500))


@query()
def z2_applied(spark, sf_dir):
    """The job's stored ranker and models applied to records without labels, whose scores are corrected and decided."""
    from ..plans import linkage, shifted
    from .records import scratch

    rec = fx.part_records(spark, sf_dir)
    labelled = F.crc32(F.col("country").cast("binary")) % 3 != 0
    path, config = scratch(spark, "models"), linkage.LinkageConfig(folds=2, rounds=5, depth=4, rank_permille=500)
    known = rec.where(labelled)
    old = linkage.train(known, fx.part_truth(known), path, config)
    new = linkage.apply(rec, path, config)
    return shifted.decided(known, old, rec, new)
