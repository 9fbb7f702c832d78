"""Mixing sources: weights raked to source, language and topic marginals, and a sample by calibrated probabilities."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_names, words_count

#: Share of tokens wanted of each value; "*": of all values that have no share of their own together.
SOURCES = {"src0": 0.30, "*": 0.70}
LANGUAGES = {"en": 0.55, "de": 0.165, "fr": 0.165, "es": 0.11, "*": 0.01}
TOPICS = {"short": 0.015, "medium": 0.435, "long": 0.55}
#: How far a margin's share may be from its target after raking, and the rounds to come there; more raise a warning.
MISS, MOST_ROUNDS = 1e-12, 1000
#: Tokens to sample, as a share of the tokens there are; less if a cell is wanted more than 1 / RATE times as much as it holds:
#: no document is taken twice.
RATE = 0.8
TOPIC_BOUNDS = (("short", 100), ("medium", 700))
HASH_RANGE = 1 << 60
#: Of a bounded sample: how far a margin's share may be from its target.
CLOSE = 1e-4


def topic_by_length(n_tokens: F.Column) -> F.Column:
    """A stand-in for a topic where documents have none: the class of their length in words."""
    out = F.lit("long")
    for name, bound in reversed(TOPIC_BOUNDS):
        out = F.when(n_tokens < bound, name).otherwise(out)
    return out


def _folded(value: F.Column, targets: dict[str, float]) -> F.Column:
    """The value if it has a share of its own, else "*"; so cells are as few as targets, whatever the data hold."""
    return F.when(value.isin([k for k in targets if k != "*"]), value).otherwise("*")


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]]) -> dict[tuple[str, ...], float]:
    """Iterative proportional fitting: factors of the cells, so that the weighted tokens have the targets' marginals.

    Each round scales each margin in turn, until all margins are met; targets that no weights meet, as cells are missing,
    raise a warning that tells the largest miss. A value with a share but no tokens can't be met; the shares of the values that
    are there are scaled to one. Cells of values without a share get 0.
    """
    total = sum(cells.values())
    weight = {c: float(n) for c, n in sorted(cells.items())}
    if not total:
        return {c: 1.0 for c in cells}
    miss = np.inf
    for _ in range(MOST_ROUNDS):
        if miss <= MISS:
            break
        miss = 0.0
        for axis, share in enumerate(targets):
            margin: dict[str, float] = {}
            for c, w in weight.items():
                margin[c[axis]] = margin.get(c[axis], 0.0) + w
            here = sum(share.get(v, 0.0) for v, w in sorted(margin.items()) if w > 0)
            for v, m in margin.items():
                if m > 0 and here > 0:
                    miss = max(miss, abs(m / total - share.get(v, 0.0) / here))
            for c in weight:
                m = margin[c[axis]]
                weight[c] = weight[c] * (share.get(c[axis], 0.0) / here * total / m) if m > 0 and here > 0 else 0.0
    if miss > 1e-6:
        warnings.warn(f"no weights have the wanted marginals: a share is {miss:.3g} off", stacklevel=2)
    return {c: weight[c] / n if n else 0.0 for c, n in cells.items()}


def rake_bounded(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]], rate: float = RATE) -> dict[tuple[str, ...], float]:
    """Probabilities of the cells, so that the expected sample has the targets' marginals although none exceeds 1.

    The sample is as large as that allows, up to the rate: its share of all tokens is found by bisection, and for each
    share cells are raked and capped at what they hold, in turn, until each margin is within CLOSE of its target. Shares of
    values that have no tokens are left out, as in rake(). Targets that no sample has, as cells are missing, raise a
    warning that tells the distance; the sample is then the one that came nearest.
    """
    names = [c for c, n in sorted(cells.items()) if n and all(c[axis] in share for axis, share in enumerate(targets))]
    if not names:
        return {c: 0.0 if any(cells.values()) else min(1.0, rate) for c in cells}
    held = np.array([cells[c] for c in names], float)
    held /= sum(cells.values())
    axes = []
    for axis, share in enumerate(targets):
        values = sorted({c[axis] for c in names})
        wanted = np.array([share[v] for v in values], float)
        axes.append((np.array([values.index(c[axis]) for c in names]), wanted / wanted.sum()))

    def fit(total: float) -> tuple[float, np.ndarray]:
        s, off = held * total, np.inf
        for _ in range(MOST_ROUNDS):
            for at, wanted in axes:
                m = np.bincount(at, s, len(wanted))
                s = np.minimum(s * np.divide(wanted * total, m, out=np.zeros_like(m), where=m > 0)[at], held)
            off = max(np.abs(np.bincount(at, s, len(wanted)) / s.sum() - wanted).max() for at, wanted in axes) if s.sum() else np.inf
            off = max(off, abs(s.sum() / total - 1))
            if off <= CLOSE:
                break
        return off, s

    high = min([rate, *(float((np.bincount(at, held, len(w))[w > 0] / w[w > 0]).min()) for at, w in axes)])
    off, s = fit(high)
    if off > CLOSE:
        low, best = 0.0, (off, s)
        for _ in range(20):
            middle = (low + high) / 2
            tried = fit(middle)
            if tried[0] <= CLOSE:
                low, best = middle, tried
            else:
                high, best = middle, min(best, tried, key=lambda x: x[0])
        off, s = best
        if off > CLOSE:
            warnings.warn(f"no sample has the wanted marginals: the nearest is {off:.3g} off", stacklevel=2)
    return {c: 0.0 for c in cells} | dict(zip(names, (s / held).tolist()))


def uniform(id_col: str, seed: str) -> F.Column:
    """A number in [0, 1) that only the id and the seed decide, as md5 in any engine gives it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long") / F.lit(float(HASH_RANGE))


def _cell(n: F.Column, source_col: str, lang_col: str, topic_col: str | None, sources: dict, languages: dict, topics: dict) -> list[F.Column]:
    """The source, language and topic of a row's cell; n: its tokens."""
    # a lambda's variable, so that the words are counted once for all comparisons
    topic = _folded(F.col(topic_col), topics) if topic_col else F.transform(F.array(n), lambda k: _folded(topic_by_length(k), topics))[0]
    return [_folded(F.col(source_col), sources), _folded(F.col(lang_col), languages), topic]


def _weights(counted: DataFrame, targets: list[dict[str, float]], rate: float, bounded: bool) -> tuple[dict[tuple[str, ...], float], float]:
    """Weights of cells, from rows (s, l, t, n) of which the driver gets one per cell, and the rate at which no probability
    exceeds 1."""
    cells = {(r.s, r.l, r.t): r.n for r in counted.groupBy("s", "l", "t").agg(F.sum("n").alias("n")).collect()}
    if bounded:
        return {c: p / rate for c, p in rake_bounded(cells, targets, rate).items()}, rate
    weights = rake(cells, targets)
    return weights, min([rate, *(1 / w for c, w in weights.items() if w > 0 and cells[c])])


def _looked_up(weights: dict[tuple[str, ...], float], cell: list[F.Column]) -> F.Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for c, w in sorted(weights.items()) for x in ("\x1f".join(c), float(w))])
    return F.coalesce(table[F.concat_ws("\x1f", *cell)], F.lit(0.0))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, sources: dict = SOURCES, languages: dict = LANGUAGES, topics: dict = TOPICS, rate: float = RATE, seed: str = "mix") -> DataFrame:
    """Rows (id_col, n_tokens, source, lang, topic, weight, probability, sampled), one per row of docs.

    Tokens are words. Values without a share of their own are one value "*", nulls too, so there are at most
    (sources + 1)(languages + 1)(topics + 1) cells. A cell's weight is the wanted over the present share of tokens; a document
    is sampled with probability rate * weight, by a hash of its id: rows that repeat an id have the same draw, thus the same
    fate within a cell. The rate is lowered to 1 / (largest weight) where it must be, so that no probability is cut at 1 and
    the expected sample has the targets' marginals. Texts without words, null ones too, weigh like the others of their cell.
    An empty table gives no rows; other columns play no part.
    """
    counted = docs.select(F.col(id_col).alias("id"), words_count(text_col).alias("n_tokens"), F.col(source_col).alias("s"), F.col(lang_col).alias("l"), *([F.col(topic_col).alias("t")] if topic_col else []))
    cell = _cell(F.col("n_tokens"), "s", "l", "t" if topic_col else None, sources, languages, topics)
    d = cut(counted.select("id", "n_tokens", *(c.alias(k) for k, c in zip("slt", cell))))
    weights, rate = _weights(d.withColumnRenamed("n_tokens", "n"), [sources, languages, topics], rate, False)
    d = d.withColumn("weight", _looked_up(weights, [F.col(k) for k in "slt"]))
    p = F.least(F.lit(1.0), F.lit(rate) * F.col("weight"))
    return d.select(
        F.col("id").alias(id_col), "n_tokens", F.col("s").alias("source"), F.col("l").alias("lang"), F.col("t").alias("topic"),
        F.round("weight", 9).alias("weight"), F.round(p, 9).alias("probability"), (uniform("id", seed) < p).alias("sampled"),
    )


def mix_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, sources: dict = SOURCES, languages: dict = LANGUAGES, topics: dict = TOPICS, rate: float = RATE, seed: str = "mix", bounded: bool = False) -> DataFrame:
    """The rows of docs, unchanged, that the sample takes: those that mixed() marks, or, bounded, those of a sample that has
    the targets' marginals and is as large as they allow, up to the rate. Nulls, repeats and empty tables as in mixed().

    A row's draw depends on nothing but its own columns and the cells' weights, so texts are filtered where they are read
    and never shuffled or joined.
    """
    n = words_count(text_col)
    cell = _cell(n, source_col, lang_col, topic_col, sources, languages, topics)
    words, = own_names(docs, "_n")
    told = docs.withColumn(words, n)  # counted once, in its own projection
    counted = told.select(F.col(words).alias("n"), *(c.alias(k) for k, c in zip("slt", _cell(F.col(words), source_col, lang_col, topic_col, sources, languages, topics))))
    weights, rate = _weights(counted, [sources, languages, topics], rate, bounded)
    return docs.where(uniform(id_col, seed) < F.least(F.lit(1.0), F.lit(rate) * _looked_up(weights, cell)))


def mixed_sql(table: str = "documents", sources: dict = SOURCES, languages: dict = LANGUAGES, topics: dict = TOPICS, rate: float = RATE, seed: str = "mix", rounds: int = 100) -> str:
    """The same in DuckDB's SQL: `rounds` of raking as a recursion over cells, one margin a step."""
    fold = lambda c, t: f"CASE WHEN {c} IN ({', '.join(repr(k) for k in t if k != '*')}) THEN {c} ELSE '*' END"
    ways = " ".join(f"WHEN n_tokens < {b} THEN '{t}'" for t, b in TOPIC_BOUNDS)
    blanks = "[ \\t\\n\\x0B\\f\\r]+"
    share = lambda a, t: f"CASE {a} " + " ".join(f"WHEN {k!r} THEN {v}::DOUBLE" for k, v in t.items()) + " ELSE 0.0 END"
    u = f"('0x' || substr(md5('{seed}:' || doc_id), 1, 15))::BIGINT / {float(HASH_RANGE)!r}"
    return f"""
WITH RECURSIVE d0 AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{blanks}'), lambda x: x <> ''))::BIGINT AS n_tokens, source, lang FROM {table}),
d AS (SELECT doc_id, n_tokens, {fold('source', sources)} AS s, {fold('lang', languages)} AS l, CASE {ways} ELSE 'long' END AS t FROM d0),
cells AS (SELECT s, l, t, sum(n_tokens)::DOUBLE AS n, {share('s', sources)} AS ss, {share('l', languages)} AS sl, {share('t', topics)} AS st FROM d GROUP BY s, l, t),
rake AS (SELECT 0 AS k, s, l, t, n, ss, sl, st, n AS w FROM cells UNION ALL
  SELECT k + 1, s, l, t, n, ss, sl, st, CASE WHEN m > 0 AND here > 0 THEN w * (share / here * total / m) ELSE 0 END FROM (
    SELECT *, sum(CASE WHEN m > 0 THEN share * w / m ELSE 0 END) OVER () AS here, sum(n) OVER () AS total FROM (
      SELECT *, CASE k % 3 WHEN 0 THEN ss WHEN 1 THEN sl ELSE st END AS share, sum(w) OVER (PARTITION BY CASE k % 3 WHEN 0 THEN s WHEN 1 THEN l ELSE t END) AS m FROM rake WHERE k < {3 * rounds}))),
f AS (SELECT s, l, t, n, CASE WHEN sum(n) OVER () = 0 THEN 1.0 WHEN n > 0 THEN w / n ELSE 0 END AS weight FROM rake WHERE k = {3 * rounds}),
r AS (SELECT least({rate}, min(1 / weight) FILTER (weight > 0 AND n > 0)) AS rate FROM f)
SELECT doc_id, n_tokens, s AS source, l AS lang, t AS topic, round(weight, 9) AS weight, round(least(1.0, rate * weight), 9) AS probability, {u} < least(1.0, rate * weight) AS sampled FROM d JOIN f USING (s, l, t), r
"""
