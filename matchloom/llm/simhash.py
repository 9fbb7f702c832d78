"""SimHash near-duplicates: fingerprints of word shingles, searched by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_names
from .graph import connected_components

BITS = 64
#: Fingerprints of one segment value that are compared by a plain join; beyond, by pairs of blocks of that size.
BUCKET = 512
#: Shingles whose bits are counted at once, so that a very long text needs little memory.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, width: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """Blocks of the hashes of all shingles; fewer words than a shingle has: of all words; no words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and the six ASCII blanks, only
    n = len(words)
    if not n:
        return
    joined = b" ".join(words)
    if n <= width:
        yield np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
        return
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: n - width + 1].tolist()
    end = end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(start), BLOCK):
        yield np.array([digest(joined[s:e], seed) for s, e in zip(start[i : i + BLOCK], end[i : i + BLOCK])], np.uint64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Majority of the bits of all shingles' hashes; no words: 0."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, width, seed):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 4, seed: int = 42) -> DataFrame:
    """Rows (id, fp), one per row of docs: the fingerprint of each whole text as a signed 64-bit number; null and empty texts: 0. Long
    texts are counted in blocks of shingles, repeated rows alike; an empty table gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, width, seed) for t in b["t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fp})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, fp long")


def segments(radius: int, parts: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment to probe.

    With radius = a * parts + b, two fingerprints within the radius differ by at most a bits in one of the first b + 1
    segments or by at most a - 1 in one of the others: else they would differ by (b + 1)(a + 1) + (parts - b - 1) a,
    which is radius + 1, at least.
    """
    a, b = divmod(radius, parts)
    out, shift = [], BITS
    for i in range(parts):
        width = BITS // parts + (i >= parts - BITS % parts)
        shift -= width
        own = a if i <= b else a - 1
        if own >= 0:
            out.append((shift, width, own))
    return out


def _ball(segment: int, key: F.Column, width: int, radius: int) -> F.Column:
    """Array of (s, k, own): the values to look up for one segment's value; own: the value itself."""
    masks = [sum(1 << x for x in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    near = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: key.bitwiseAND(m.bitwiseAND(-m)) == 0)
    return F.transform(near, lambda m: F.struct(F.lit(segment).alias("s"), key.bitwiseXOR(m).alias("k"), (m == 0).alias("own")))


def best_parts(n: int, radius: int) -> int:
    """Segments for n fingerprints: what the search costs least with. A fingerprint asks for all values in each segment's ball, and
    meets n / 2^width others at each. Few wide segments have large balls, many narrow ones crowded values: 3 segments suit some
    10^6 fingerprints at radius 4, 2 from 10^8 on."""
    cost = lambda parts: sum(sum(comb(w, r) for r in range(own + 1)) * (4 + n / 2.0**w) for _, w, own in segments(radius, parts))
    return min(range(2, 6), key=cost)


def connecting(fps: DataFrame, radius: int = 4, parts: int | None = None) -> DataFrame:
    """Pairs (a, b) of fingerprints, from distinct rows (fp), that connect what those differing in at most `radius` bits connect.

    Multi-index hashing: each segment's value is a table; a fingerprint looks up every value in a small Hamming ball
    around its own, and whole distances are verified inside the join. A ball's mask is probed only by the side that has
    0 at the mask's lowest bit, so that a pair is found from one side. Exact for any number of parts. Values of more than
    BUCKET rows give a forest, in proportion to their rows: it connects the same, so components don't depend on sizes.
    """
    return _found(fps, radius, parts, True)


def links(fps: DataFrame, radius: int = 4, parts: int | None = None) -> DataFrame:
    """All pairs (a, b) of different fingerprints that differ in at most `radius` bits, whatever their number; see connecting."""
    pairs = _found(fps, radius, parts, False)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _found(fps: DataFrame, radius: int, parts: int | None, forest: bool) -> DataFrame:
    entries, probes = [], []
    for i, (shift, width, own) in enumerate(segments(radius, parts or best_parts(fps.count(), radius))):
        key = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        entries.append(F.struct(F.lit(i).alias("s"), key.alias("k")))
        probes.append(_ball(i, key, width, own))
    tables = fps.select(F.col("fp").alias("b"), F.inline(F.array(*entries)))
    asked = fps.select(F.col("fp").alias("a"), F.inline(F.concat(*probes)))
    hot = cut(tables.groupBy("s", "k").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET))
    close = F.expr(f"bit_count(a ^ b) <= {int(radius)} AND (NOT own OR a < b)")
    key = ["s", "k"]
    plain = asked.join(hot, key, "left_anti").join(tables.join(hot, key, "left_anti").hint("merge"), key).where(close).select("a", "b")
    if not hot.take(1):
        return plain
    return plain.unionByName(_hot_links(asked.join(hot, key), tables.join(hot, key), radius, forest))


def _hot_links(asked: DataFrame, tables: DataFrame, radius: int, forest: bool) -> DataFrame:
    """Links within values of many rows, from rows with the value's size: all, or a forest that connects the same.

    Both sides of a value are dealt into blocks of BUCKET rows or so, and each pair of blocks is compared by one task. For a
    forest it returns for each fingerprint that is linked in it the smallest that is linked to it within the two
    blocks, directly or not: one row per fingerprint.
    """
    n = F.ceil(F.col("size") / BUCKET).cast("int")
    block = lambda c: F.pmod(F.xxhash64(c), n).cast("int")
    every = F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.select("s", "k", F.col("a").alias("fp"), F.lit(True).alias("asks"), block("a").alias("x"), every.alias("y"))
    right = tables.select("s", "k", F.col("b").alias("fp"), F.lit(False).alias("asks"), every.alias("x"), block("b").alias("y"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (g.loc[g["asks"] == side, "fp"].drop_duplicates().to_numpy(np.int64) for side in (True, False))
        near = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= radius
        if not forest:
            i, j = np.nonzero(near & (a[:, None] != b[None, :]))
            return pd.DataFrame({"a": a[i], "b": b[j]})
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        ai, bi, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        todo = near.any(axis=1)
        while todo.any():  # breadth first over both sides
            front = np.zeros(len(a), bool)
            front[np.argmax(todo)] = True
            seen_a, seen_b = front.copy(), np.zeros(len(b), bool)
            while front.any():
                new_b = near[front].any(axis=0) & ~seen_b
                seen_b |= new_b
                front = near[:, new_b].any(axis=1) & ~seen_a
                seen_a |= front
            own = np.concatenate([ai[seen_a], bi[seen_b]])
            root[own] = own.min()
            todo &= ~seen_a
        linked = root != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[linked], "b": nodes[root[linked]]})

    return left.unionByName(right).groupBy("s", "k", "x", "y").applyInPandas(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, seed: int = 42, parts: int | None = None) -> DataFrame:
    """Rows (id_col, fingerprint, component_id), one per row of docs.

    component_id is the smallest id reachable by links. Copies share a fingerprint and are one node of the search, so
    a group of copies of any size costs one row. Texts without words have fingerprint 0 and are linked like others;
    rows with null ids take part and are in the component of the smallest id that is not null; an empty table gives
    no rows. Other columns of docs play no part.
    """
    marked = cut(with_fingerprints(docs, id_col, text_col, width, seed))
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    found = connected_components(connecting(nodes.select("fp"), radius, parts))
    grouped = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = grouped.groupBy("component").agg(F.min("least").alias("root"))
    named = grouped.join(roots, "component").select("fp", "root")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("root").alias("component_id")
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of its component: one document of each group stays.

    Rows that repeat an id stay or go together; rows with a null id go if their component has an id, else they stay.
    """
    return kept(docs, simhash_components(docs, id_col, text_col, **options), id_col)


def kept(docs: DataFrame, components: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, from rows (id_col, component_id)."""
    mark, = own_names(docs, "_kept")
    keep = components.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(mark)).distinct()
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col(mark)), "left_semi")
