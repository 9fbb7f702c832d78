"""Every query against its SQL on the smallest tables, and the contract of the entry module."""

import math

import duckdb
import pytest

import __spark_entry__
from matchloom.queries.common import QUERIES, SQL
from matchloom.queries.records import part_pairs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=cols.__getitem__)
    plain = lambda v: round(float(v), 8) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(cols), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in got.description], got.fetchall())


def _one_query_each(rows):
    return len({r.t for r in rows}) == len(rows)


def _pairs_once(rows):
    return len({(r.s1, r.t) for r in rows}) == len(rows) > 0


def _probabilities(rows, *columns):
    return all(0 <= r[c] <= 1 for r in rows for c in columns)


#: What must hold of the results of queries that SQL can't express; their operators are tested on literal cases too.
HOLDS = {
    "c22_extended_profile": lambda rows: len(rows) == len({r.id for r in rows}) == 200 and any(r.country == "fr" for r in rows),
    "d21_ranker": lambda rows: _pairs_once(rows) and all(r.rrank <= 30 for r in rows) and _probabilities(rows, "rs"),
    "f1_string_scores": lambda rows: _pairs_once(rows) and all(0 <= r[c] <= 100 for r in rows for c in r.asDict() if c not in ("s1", "t")) and all(r.ns_ratio < 100 or r.ns_tset == r.ns_tsort == r.ns_part == 100 for r in rows),
    "h1_out_of_fold": lambda rows: _pairs_once(rows) and _probabilities(rows, "p_oof") and {r.fold for r in rows} == {0, 1, 2, 3},
    "h3_fold_average": lambda rows: _pairs_once(rows) and _probabilities(rows, "p"),
    "j12_rescue": lambda rows: _one_query_each(rows) and {r.kind for r in rows} <= {"filler", "lf_add", "same_name"},
    "l5_bootstrap": lambda rows: rows[0].low <= rows[0].delta <= rows[0].high and rows[0].se > 0,
    "l8_missed": lambda rows: _pairs_once(rows) and {r.cat for r in rows} <= {"empty address", "native script", "domain", "renamed", "other address", "similar"},
    "o2_incremental_linkage": lambda rows: _pairs_once(rows),
    "z1_linkage": lambda rows: _one_query_each(rows) and _probabilities(rows, "p1", "p2") and len(rows) > 0,
    "z2_applied": lambda rows: _one_query_each(rows) and {r.how for r in rows} <= {"decoded", "copy", "rescued"},
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_holds(spark, name):
    assert HOLDS[name](QUERIES[name](spark, SF).collect())


def test_stream_links_as_a_batch(spark):
    streamed = {(r.s1, r.t, r.brank) for r in QUERIES["o2_incremental_linkage"](spark, SF).collect()}
    whole = part_pairs(spark, SF).select("s1", "t", "brank").collect()
    assert streamed == {(r.s1, r.t, r.brank) for r in whole}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
