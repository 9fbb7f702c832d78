"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give scores and offsets."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .simhash import fingerprint

#: Bounds of what is learned from: documents of each label, and characters of a document that may be among them.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 4000
#: A word or stem is taken to be what makes documents toxic if its documents' labels differ from chance by this
#: log-likelihood ratio: 18 is beyond chance for some ten thousand words at once.
EVIDENCE = 18.0
#: ... and if this share at least of the documents that have it are toxic.
PRECISION = 0.9
#: Lengths of stems.
STEMS = (4, 5)
#: Steps of gradient ascent, their size, and the weight of the penalty.
STEPS, RATE, PENALTY = 60, 0.5, 3e-4
#: Commonest words that tell something of their neighbours.
NEIGHBOURS = 2000
#: A token is part of an offending span at this marginal.
SPAN = 0.5
#: Words whose weights a worker keeps.
CACHE_WORDS = 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, each a token in lower case. They are found in the text as it stands, as lower case may be longer: so
    the same tokens give scores and offsets."""
    return [w.lower() for w in WORD.findall(text)]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


# --- the chain -----------------------------------------------------------------------------------------------------------


def forward_backward(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of label 1 for the tokens of many texts that follow each other; exact.

    e: score of label 1 over label 0; first: marks of texts' first tokens, where the chain begins anew; trans and start:
    log potentials. With pairs also the expected number of each transition, and of each first label. The tokens are laid
    out in as many rows as columns. One pass over columns multiplies each row's 2 x 2 matrices for all rows at once; one
    pass over rows then joins them; one more over columns gives each token's vectors. Every product is normalised.
    """
    n = len(e)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    fill = rows * width - n
    e = np.concatenate([np.clip(e, -30, 30), np.zeros(fill)]).reshape(rows, width)
    first = np.concatenate([first, np.ones(fill, bool)]).reshape(rows, width)
    m = np.where(first[..., None, None], np.exp(start)[None, None, None, :], np.exp(trans)[None, None])
    m[..., 1] *= np.exp(e)[..., None]
    whole = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
    for t in range(width):
        whole = whole @ m[:, t]
        whole /= whole.sum(axis=(1, 2))[:, None, None]
    a_in, b_out = np.empty((rows, 2)), np.empty((rows, 2))
    a = np.array([0.5, 0.5])
    for r in range(rows):
        a_in[r] = a
        a = a @ whole[r]
        a /= a.sum()
    b = np.array([0.5, 0.5])
    for r in range(rows - 1, -1, -1):
        b_out[r] = b
        b = whole[r] @ b
        b /= b.sum()
    alpha, beta = np.empty((rows, width, 2)), np.empty((rows, width, 2))
    a, b = a_in, b_out
    for t in range(width):
        a = np.einsum("ri,rij->rj", a, m[:, t])
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
        u = width - 1 - t
        beta[:, u] = b
        b = np.einsum("rij,rj->ri", m[:, u], b)
        b /= b.sum(axis=1, keepdims=True)
    both = alpha * beta
    gamma = (both[..., 1] / both.sum(axis=2)).reshape(-1)[:n]
    if not pairs:
        return gamma
    before = np.concatenate([np.array([[0.5, 0.5]]), alpha.reshape(-1, 2)[: n - 1]])
    joint = before[:, :, None] * m.reshape(-1, 2, 2)[:n] * beta.reshape(-1, 2)[:n, None, :]
    joint /= joint.sum(axis=(1, 2))[:, None, None]
    begin = first.reshape(-1)[:n]
    g1 = gamma[begin]
    return gamma, joint[~begin].sum(axis=0), np.array([(1 - g1).sum(), g1.sum()])


# --- the model -----------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of features for a token, its neighbours, the chain, and from marginals to a score."""

    own: dict[str, float] = field(default_factory=dict)
    left: dict[str, float] = field(default_factory=dict)
    right: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    scale: np.ndarray = field(default_factory=lambda: np.array([-8.0, 0.0, 0.0]))

    def __post_init__(self):
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, 3))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _word(self, w: str) -> int:
        i = len(self.number)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = sum(self.own.get(f, 0.0) for f in features(w)), self.left.get(w, 0.0), self.right.get(w, 0.0)
        self.number[w] = i
        return i

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Each text's marginals of being toxic, token by token."""
        if len(self.number) > CACHE_WORDS:
            self._forget()
        number, new = self.number, self._word
        sizes = np.array([len(t) for t in texts], np.int64)
        n = int(sizes.sum())
        ids = np.fromiter([number[w] if w in number else new(w) for t in texts for w in t], np.int64, n)
        e = self.table[ids, 0] + self.bias
        first = np.zeros(n, bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        last = np.roll(first, -1)
        if n:
            e += np.where(first, 0.0, np.roll(self.table[ids, 1], 1)) + np.where(last, 0.0, np.roll(self.table[ids, 2], -1))
        return np.split(forward_backward(e, first, self.trans, self.start), np.cumsum(sizes)[:-1]) if len(texts) else []

    def score(self, marginals: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale @ _summary(marginals), -30, 30))))


def _summary(p: np.ndarray) -> np.ndarray:
    """What a score sees of a text: one, its clearly toxic tokens (log of the sum of squares, so that length alone says nothing),
    its largest marginal."""
    return np.array([1.0, np.log1p((p * p).sum()), p.max()]) if len(p) else np.array([1.0, 0.0, 0.0])


def _ratio(t: int, n: int, nt: int, nn: int) -> float:
    """Log-likelihood ratio of a word's documents' labels against the sample's."""
    k, base = t + n, nt / (nt + nn)
    out = 0.0
    for seen, share in ((t, base), (n, 1 - base)):
        if seen:
            out += 2 * seen * np.log(seen / (k * share))
    return out


def families(texts: list[str], distance: int = 12) -> np.ndarray:
    """A number per text that near copies share: word shingles' fingerprints within a distance, which other texts are far beyond.

    Brute force over the bounded sample. Copies must count once: else the words of a much copied text seem evidence.
    """
    fp = np.array([fingerprint(t) for t in texts], np.uint64)
    group = np.arange(len(fp))
    for i in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(fp[i] ^ fp[:i]) <= distance)
        if len(near):
            group[i] = group[near[0]]
    return group


def toxic_features(docs: list[list[str]], labels: np.ndarray, family: np.ndarray | None = None) -> set[str]:
    """Words and stems that the labels show to make documents toxic: tokens get their labels from these.

    A feature counts once for each family of documents.
    """
    family = np.arange(len(docs)) if family is None else family
    have: dict[tuple[int, int], set[str]] = {}
    for words, y, f in zip(docs, labels.tolist(), family.tolist()):
        have.setdefault((f, y), set()).update(x for w in set(words) for x in features(w))
    toxic, clean = Counter(), Counter()
    for (_, y), fs in have.items():
        (toxic if y else clean).update(fs)
    nt, nn = sum(y for _, y in have), sum(1 - y for _, y in have)
    if not nt or not nn:
        return set()
    rate = lambda f: (toxic[f] / nt) / (toxic[f] / nt + clean[f] / nn)
    return {f for f, t in toxic.items() if t > 2 and rate(f) >= PRECISION and _ratio(t, clean[f], nt, nn) >= EVIDENCE}


def fit_model(texts: list[str], labels: list[int], prior: float = 0.5, parts: int = 2) -> Model:
    """The model of labelled texts; prior: the share of toxic ones among all, of which texts may hold more.

    What a score makes of marginals is learned from texts whose marginals come from a chain that didn't see them or their near
    copies: families of texts are dealt into `parts`, and each part is read by the chain of the others. No toxic or no clean
    text, or no word that tells them apart: a score near 0 for all.
    """
    docs, y = [words_of(t) for t in texts], np.array(labels, np.int64)
    family = families(texts)
    model = _chain(docs, y, family)
    if model is None:
        return Model()
    x, known = np.zeros((len(docs), 3)), np.zeros(len(docs), bool)
    for k in range(parts):
        rest = np.flatnonzero(family % parts != k)
        own = np.flatnonzero(family % parts == k)
        chain = _chain([docs[i] for i in rest], y[rest], family[rest]) if len(own) else None
        if chain is not None:
            x[own] = [_summary(p) for p in chain.marginals([docs[i] for i in own])]
            known[own] = True
    if len(set(y[known].tolist())) < 2:  # too few texts to be dealt
        x, known = np.array([_summary(p) for p in model.marginals(docs)]), np.ones(len(docs), bool)
    model.scale = _calibrated(x[known], y[known], prior)
    return model


def _calibrated(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """A penalised logistic regression of labels on texts' summaries, by Newton's steps; classes weigh as the prior has them."""
    scale, weight = np.zeros(3), np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        scale = scale + np.linalg.solve(hess, x.T @ (weight * (y - p)) - 1e-4 * scale)
    return scale


def _chain(docs: list[list[str]], y: np.ndarray, family: np.ndarray) -> Model | None:
    """The chain of labelled texts' tokens, fitted by Adam on the penalised likelihood; None if no word tells labels apart.

    A neighbour's word is a feature if it is among the NEIGHBOURS commonest words.
    """
    marks = toxic_features(docs, y, family)
    if not marks:
        return None
    index: dict[str, int] = {}
    cols: list[list[int]] = []
    target, first = [], []
    count = Counter(f for words in docs for w in set(words) for f in features(w))
    near = {w for w, k in count.most_common(NEIGHBOURS) if not w.endswith("*")}
    for d, words in enumerate(docs):
        for i, w in enumerate(words):
            fs = features(w)
            hit = y[d] and any(f in marks for f in fs)
            target.append(bool(hit))
            first.append(i == 0)
            row = [index.setdefault(f, len(index)) for f in fs if count[f] > 2]
            if i and words[i - 1] in near:
                row.append(index.setdefault("<" + words[i - 1], len(index)))
            if i + 1 < len(words) and words[i + 1] in near:
                row.append(index.setdefault(">" + words[i + 1], len(index)))
            cols.append(row)
    goal, first = np.array(target), np.array(first)
    flat = np.fromiter((c for row in cols for c in row), np.int64)
    token = np.repeat(np.arange(len(cols)), [len(r) for r in cols])
    n, k = len(cols), len(index)
    w, bias, trans, start = np.zeros(k), -3.0, np.zeros((2, 2)), np.zeros(2)
    prev = np.roll(goal, 1)
    inner = ~first
    seen = np.zeros((2, 2))
    np.add.at(seen, (prev[inner].astype(int), goal[inner].astype(int)), 1)
    begun = np.bincount(goal[first].astype(int), minlength=2).astype(float)
    moments = [np.zeros(k + 7), np.zeros(k + 7)]
    for step in range(1, STEPS + 1):  # labels are rare, so gradients are scaled by their number
        e = np.bincount(token, w[flat], n) + bias
        gamma, expected, expected_start = forward_backward(e, first, trans, start, pairs=True)
        error = goal - gamma
        grad = np.concatenate([np.bincount(flat, error[token], k) - PENALTY * len(docs) * w, [error.sum()], (seen - expected).ravel() - trans.ravel(), begun - expected_start - start]) / max(1, goal.sum())
        for i, power in ((0, 1), (1, 2)):
            beta = (0.9, 0.999)[i]
            moments[i] = beta * moments[i] + (1 - beta) * grad**power
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, bias, trans, start = w + move[:k], bias + move[k], trans + move[k + 1 : k + 5].reshape(2, 2), start + move[k + 5 :]
    model = Model({}, {}, {}, float(bias), trans, start)
    for f, i in index.items():
        if f[0] == "<":
            model.left[f[1:]] = float(w[i])
        elif f[0] == ">":
            model.right[f[1:]] = float(w[i])
        else:
            model.own[f] = float(w[i])
    return model


# --- operators -----------------------------------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most sample_docs rows (text, y) of each label, those of least hash, of texts of 1 to sample_chars characters.

    A document with several labels is toxic if one says so; null ids, labels and texts give no row.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    short = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where((F.length("text") > 0) & (F.length("text") <= sample_chars))
    rows = short.join(marked, "id").select("id", "y", F.md5(F.concat(F.lit("tox:"), F.col("id").cast("string")).cast("binary")).alias("h")).distinct()
    rows = cut(rows)
    taken = [rows.where(F.col("y") == y).orderBy("h", "id").limit(sample_docs) for y in (0, 1)]
    few = cut(taken[0].unionByName(taken[1]).select("id", "y"))  # 2 * sample_docs ids at most: small enough to broadcast
    return short.join(F.broadcast(few), "id").select("id", "text", "y")


def fit_toxicity(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model, learned on the driver from a bounded sample (see SAMPLE_DOCS and SAMPLE_CHARS) of labelled documents."""
    rows = sorted({(r.id, r.text, r.y) for r in training_rows(docs, labels, **options).collect()})
    label = F.col(options.get("label_col", "toxic")).cast("double")
    prior = labels.agg(F.avg(label)).first()[0]
    return fit_model([r[1] for r in rows], [r[2] for r in rows], 0.5 if prior is None else prior)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score, n_toxic, spans), one per row of docs, from whole texts; no shuffle.

    spans are the (start, end) character offsets of runs of tokens whose marginal is at least SPAN. Null and empty texts
    have no tokens: the score of a text without any sign, and no spans. Rows that repeat score alike; an empty table gives
    no rows; other columns play no part.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # bounded by the sample: at most its words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for b in batches:
            texts = b["t"].tolist()
            rows: list = []
            at = 0
            while at < len(texts):  # some 200,000 tokens at once, whole texts each
                size, upto, tokens = 0, at, []
                while upto < len(texts) and (size < 200_000 or upto == at):
                    tokens.append(words_of(texts[upto]))
                    size += len(tokens[-1])
                    upto += 1
                for text, p in zip(texts[at:upto], m.marginals(tokens)):
                    hot = p >= SPAN
                    rows.append((m.score(p), int(hot.sum()), _spans(text, hot) if hot.any() else []))
                at = upto
            out = pd.DataFrame(rows, columns=["score", "n_toxic", "spans"])
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    made = rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, score double, n_toxic long, spans array<struct<start:long,end:long>>")
    return made.withColumnRenamed("id", id_col)


def _spans(text: str, hot: np.ndarray) -> list[dict]:
    """Runs of marked tokens as character offsets into the text."""
    out: list[dict] = []
    previous = False
    for mark, found in zip(hot.tolist(), WORD.finditer(text)):
        if mark and previous:
            out[-1]["end"] = found.end()
        elif mark:
            out.append({"start": found.start(), "end": found.end()})
        previous = mark
    return out
