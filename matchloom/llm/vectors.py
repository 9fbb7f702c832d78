"""Near-duplicate vectors: sign hashing against random hyperplanes, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

#: Of a pair at the threshold, the chance to share no table; and the least hyperplanes of a table.
MISS, PLANES = 0.0015, 10
#: Rows of a bucket that one task compares with as many others.
BLOCK = 512


def layout(nodes: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(planes, tables) for so many vectors that are compared: planes as many as leave a bucket BLOCK vectors or so on average, so
    that work grows with the vectors and not with their square, and the tables that a pair at the threshold then needs. At a
    cosine of 0.93 one plane keeps two vectors together with probability 0.88: twenty tables of ten planes, 47 of 16."""
    together = 1 - np.arccos(min(1.0, threshold)) / np.pi
    planes = max(PLANES, int(np.ceil(np.log2(max(1, nodes) / BLOCK))))
    return planes, int(np.ceil(np.log(miss) / np.log1p(-(together**planes))))


def _sound(v: str) -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _codes(nodes: DataFrame, planes: int, tables: int, seed: int) -> DataFrame:
    """nodes with codes: for each table, the signs of its hyperplanes as bits."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        normals: dict[int, np.ndarray] = {}
        for b in batches:
            out = np.empty(len(b), object)
            sizes = b.map(len).to_numpy()
            for d in np.unique(sizes):
                if d not in normals:
                    normals[d] = np.random.default_rng((seed, int(d))).standard_normal((int(d), planes * tables))
                at = np.flatnonzero(sizes == d)
                x = np.stack(b.to_numpy()[at]).astype(np.float64)
                sides = (x / np.abs(x).max(axis=1, keepdims=True)) @ normals[d] > 0
                codes = sides.reshape(len(at), tables, planes) @ (1 << np.arange(planes))
                for i, c in zip(at, codes.astype(np.int32)):
                    out[i] = c
            yield pd.Series(out)

    return nodes.withColumn("codes", F.pandas_udf(run, "array<int>")("v"))


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _verify(g: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    """Links within one pair of blocks: (id, n, other).

    n: copies of other nodes linked to id that no earlier table could show, so that a pair counts once over all tables
    and blocks; other: the smallest id of those linked within the group, directly or not.
    """
    x = np.stack(g["v"].to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of large components would overflow
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    t, left, right = int(g["t"].iloc[0]), int(g["bi"].iloc[0]), int(g["bj"].iloc[0])
    block = g["block"].to_numpy()
    if left != right:  # pairs within a block are the work of the groups with left = right
        near &= block[:, None] != block[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return None
    codes = np.stack(g["codes"].to_numpy())[:, :t]
    new = np.concatenate([~(codes[i[k : k + 65536]] == codes[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)])
    n = np.bincount(i[new], weights=g["m"].to_numpy()[j[new]], minlength=len(g)).astype(np.int64)
    ids, parent = g["id"].to_numpy(), np.arange(len(g))
    todo = np.ones(len(g), bool)
    for start in np.unique(i):  # breadth first; each node is expanded once
        if not todo[start]:
            continue
        front, todo[start] = np.array([start]), False
        while len(front):
            hit = near[front].any(axis=0) & todo
            todo &= ~hit
            front = np.flatnonzero(hit)
            parent[front] = start
    have = np.unique(i)
    root = parent[have]
    least = pd.Series(ids[have]).groupby(root).transform("min").to_numpy()
    return pd.DataFrame({"id": ids[have], "n": n[have], "other": least})


def _links(entries: DataFrame, threshold: float) -> DataFrame:
    """Rows (id, n, other) from rows of groups, which the input holds side by side."""
    key = ["part", "t", "code", "bi", "bj"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            k = b[key].to_numpy()
            edge = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            last = int(edge[-1]) if len(edge) else 0
            rest = b.iloc[last:]
            yield from done(b, [0, *edge.tolist()])
        if rest is not None and len(rest):
            yield from done(rest.reset_index(drop=True), [0, len(rest)])

    def done(b: pd.DataFrame, edge: list[int]) -> Iterator[pd.DataFrame]:
        found = [_verify(b.iloc[s:e], threshold) for s, e in zip(edge, edge[1:]) if e - s > 1]
        found = [f for f in found if f is not None]
        if found:
            yield pd.concat(found, ignore_index=True)

    return entries.mapInPandas(run, "id long, n long, other long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, planes: int | None = None, tables: int | None = None, seed: int = 7) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one per row of vectors with an id.

    Vectors of equal labels and lengths are linked if their cosine, in double precision, is at least the threshold and
    they meet in one of the tables. A vector that is null, zero, or holds null or non-finite components, and one whose
    label is null, links with nothing. Equal vectors are one node with a count, so a group of copies of any size is one
    row of the search; rows that repeat an id count as vectors of their own. A bucket of many nodes is dealt as pairs of
    blocks, of which each task compares two at a time; what a task returns is counts and one link per node, never pairs.
    Rows with a null id are left out: a link needs an id. An empty table gives no rows; other columns play no part. Planes
    and tables follow from the largest label's vectors (see layout), unless they are given.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")).where("id IS NOT NULL")
    rows = rows.withColumn("ok", _sound("v") & F.col("label").isNotNull())
    nodes = rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    nodes = cut(nodes.withColumn("part", F.struct("label", F.size("v"))))
    if planes is None or tables is None:
        most = nodes.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        planes, tables = layout(most, threshold)
    nodes = cut(_codes(nodes, planes, tables, seed))
    narrow = nodes.select("part", F.posexplode("codes").alias("t", "code"))
    hot = cut(narrow.groupBy("part", "t", "code").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    entries = nodes.select("part", "id", "m", "v", "codes", F.posexplode("codes").alias("t", "code"))
    entries = entries.join(hot, ["part", "t", "code"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int"))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.select("id", "m", "v", "codes", "t", "code", "block", F.least("block", "x").alias("bi"), F.greatest("block", "x").alias("bj"), F.xxhash64("part").alias("part"))
    dealt = entries.repartition("part", "t", "code", "bi", "bj").sortWithinPartitions("part", "t", "code", "bi", "bj")
    found = cut(_links(dealt, threshold))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select("id", "other"), "id", "other").withColumnRenamed("node", "id")
    known = nodes.select("id", "m", "label", "v").join(counts, "id", "left").join(comps, "id", "left")
    known = known.select("label", "v", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("root"))
    linked = rows.where("ok").join(known, ["label", "v"]).select("id", "n_links", "root")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("root"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept")
    )
