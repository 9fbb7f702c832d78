"""Each registered query over the smallest tables: the contract's columns and types, and SQL or the libraries where they can tell."""

import hashlib
from zlib import crc32

import duckdb
import numpy as np
import pytest

from matchloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_lines": {"doc_id": "bigint", "text": "string", "n_lines": "bigint", "n_dropped": "bigint"},
    "op4_mixing": {"doc_id": "bigint", "n_tokens": "bigint", "weight": "double", "probability": "double", "sampled": "boolean"},
    "op5_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_licenses": {"doc_id": "bigint", "license": "string", "dice": "double", "n_matches": "bigint"},
    "op10_chat": {"conv_id": "bigint", "speaker": "string", "rendered": "string", "mask": "string"},
}


def plain(cols, data):
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted((tuple(round(r[i], 8) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, con, name):
    df = queries.queries()[name](spark, SF)
    assert {k: v for k, v in df.dtypes if k in CONTRACT[name]} == CONTRACT[name]
    got = df.collect()
    if name in queries.oracle_sql():
        c = con.execute(queries.oracle_sql()[name])
        assert plain(df.columns, [tuple(r) for r in got]) == plain([d[0] for d in c.description], c.fetchall())
    key, source = {"op5_warc": ("page_id", "pages"), "op8_vectors": ("vec_id", "embeddings"), "op10_chat": ("conv_id", "conversations")}.get(name, ("doc_id", "documents"))
    ids = [r[0] for r in con.execute(f"SELECT {key} FROM {source}").fetchall()]
    assert sorted(r[key] for r in got) == sorted(ids) if name != "op10_chat" else {r[key] for r in got} == set(ids)
    text = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in got:
        if name == "op1_bpe":
            ids = library().encode(text[r.doc_id] or "", add_special_tokens=False).ids
            decoded = library().decode(ids, skip_special_tokens=False)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        elif name == "op2_simhash":
            assert r.fingerprint == f"{simhash.fingerprint(text[r.doc_id]):016x}" and r.component_id <= r.doc_id
        elif name == "op6_toxicity":
            assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        elif name == "op7_quality":
            assert not (r.base_failed and r.kept) and r.n_words == len((text[r.doc_id] or "").encode().split())
        elif name == "op8_vectors":
            assert r.kept == (r.vec_id == r.component_id) and (r.n_links > 0 or r.kept)


def library():
    tokenizers = pytest.importorskip("tokenizers")
    if not hasattr(library, "it"):
        library.it = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    return library.it
