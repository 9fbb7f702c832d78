import hashlib
import random

import numpy as np
import pytest

from matchloom.llm import bpe
from matchloom.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
POOL = "aA'sStTéÉßΣσςİıǅ你हिं😀 \t\n\x0b\x1c\x1d\x85\xa0 　​̣́KÅ0१Ⅷ<|>_-.!"
FIXED = ["", " ", "Hello<|endoftext|>x <|startoftext|><|startoftext|>", "ΑΣ ΣΑΣ don't DON'T it's'll 1²", "a" * 3000, "x y " * 2000, "<|endof text|>"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_matches_the_library(library):
    rnd, own = random.Random(5), bpe.load(tokenizer_path())
    for text in FIXED + ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_stale_queue_entries_are_skipped():
    own = bpe.load(tokenizer_path())
    ids = [own.vocab[c] for c in "aaaaaa"]
    assert "".join(own.names[i] for i in own.merge(list(ids))) == "aaaaaa"


def test_frames(spark, library):
    rows = [(1, "Hello, World's"), (2, None), (3, ""), (3, ""), (None, "é " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS id", "1 AS n_tokens")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(docs, tokenizer_path()).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    decoded = bpe.bpe_decode(bpe.bpe_encode(docs, tokenizer_path()), tokenizer_path()).where("doc_id = 1").first()
    assert decoded.decoded == "hello</w> ,</w> world</w> 's</w>" and len(decoded.token_ids) == 4
    assert bpe.bpe_digests(docs.limit(0), tokenizer_path()).count() == 0
