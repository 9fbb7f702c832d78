"""The pipeline against a brute-force composition of its stages."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from matchloom.llm import lines, mixing
from matchloom.llm.queries import tokenizer_path

from .test_near_dup import slow_shingles, union
from .test_text_rules import slow_measure

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rnd = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    body = lambda: "\n".join(" ".join(rnd.choice(words) for _ in range(30)) for _ in range(3))
    texts = [body() for _ in range(60)]
    texts = [t + rnd.choice(["\nall rights reserved", "\nhome about contact", ""]) for t in texts]
    texts += texts[:10] + [t.replace(t.split()[40], "changed", 1) for t in texts[10:20]] + ["too short", None, "", "spam and " * 80, (body() + "\n") * 3]
    return [(i, t, rnd.choice(["en", "en", "de", None]), rnd.choice(["src0", "b"]), len(t or "")) for i, t in enumerate(texts)]


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def slow(rows):
    """The stages one after another by brute force, but the last."""
    rows = [r for r in rows if not slow_measure(r[1])[5] and slow_measure(r[1])[6]]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    text = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, text FROM ({lines.line_dedup_sql()})").fetchall()}
    rows = [(r[0], text[r[0]], *r[2:4]) for r in rows]
    sets = [slow_shingles(r[1]) for r in rows]
    root = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    n = lambda r: len(r[1].split())
    cell = lambda r: (r[3] if r[3] == "src0" else "*", r[2] or "*", "short" if n(r) < 100 else "medium" if n(r) < 700 else "long")
    cells = {c: sum(n(r) for r in rows if cell(r) == c) for c in map(cell, rows)}
    p = mixing.rake_bounded(cells, [mixing.SOURCES, mixing.LANGUAGES, mixing.TOPICS])
    return [r for r in rows if int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:15], 16) / 2.0**60 < p[cell(r)]]


def test_pipeline(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS fp", "2 AS id", "3 AS _kept").write.parquet(str(tmp_path / "documents.parquet"))
    want, library = {}, tokenizers.Tokenizer.from_file(tokenizer_path())
    for r in slow(rows):
        ids = library.encode(r[1], add_special_tokens=False).ids
        want[r[0]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and want


def test_odd_rows_pass_the_stages(spark, tmp_path):
    good = documents()
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [*good[:30], *good[:3], (None, *good[30][1:]), (9000, long, "en", "src0", len(long)), (9001, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, ""))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        sizes.append(len(ids))
        assert 9001 not in ids
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == 35 and sizes[1] == 35
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == sizes[-1]
