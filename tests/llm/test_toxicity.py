import itertools
import random

import numpy as np

from matchloom.llm import toxicity


def test_forward_backward_is_exact():
    rnd = np.random.default_rng(1)
    sizes = [1, 4, 7, 2, 9]
    e, first = rnd.normal(0, 2, sum(sizes)), np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    trans, start = rnd.normal(0, 1, (2, 2)), rnd.normal(0, 1, 2)
    want, pairs, begun, at = [], np.zeros((2, 2)), np.zeros(2), 0
    for n in sizes:
        p, moves, starts, z = np.zeros(n), np.zeros((2, 2)), np.zeros(2), 0.0
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(start[y[0]] + sum(e[at + i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            z += w
            p += w * np.array(y)
            starts[y[0]] += w
            for i in range(1, n):
                moves[y[i - 1], y[i]] += w
        want.append(p / z)
        pairs, begun, at = pairs + moves / z, begun + starts / z, at + n
    got, got_pairs, got_begun = toxicity.forward_backward(e, first, trans, start, pairs=True)
    assert np.allclose(got, np.concatenate(want)) and np.allclose(got_pairs, pairs) and np.allclose(got_begun, begun)


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("na", "ne", "ni", "no", "nu", "ra", "ri")]
    rows = []
    for i in range(n):
        body = [rnd.choice(words) for _ in range(rnd.randrange(5, 80))]
        toxic = int(rnd.random() < 0.2)
        for _ in range(toxic * rnd.randrange(1, 4)):
            body.insert(rnd.randrange(len(body)), rnd.choice(["Grob", "vilest", "vilesto,", "vilestu."]))
        rows.append((i, " ".join(body), toxic))
    return rows


def test_held_out_accuracy(spark):
    train, rest = corpus(600, 1), corpus(300, 2)
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in train] + [(5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    odd = [(1000, None), (1001, ""), (1001, ""), (None, "ka"), (1002, "İ grob İ grob"), (1003, "ka " * 60000 + "grob")]
    asked = spark.createDataFrame([r[:2] for r in rest] + odd, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS score")
    got = {r.doc_id: r for r in toxicity.score_toxicity(asked, model).collect()}
    assert np.mean([(got[i].score >= 0.7) == y for i, _, y in rest]) > 0.97
    for i, text, y in rest:
        if y and got[i].spans:
            assert all(text[s.start : s.end].lower().split()[0].strip(",.").startswith(("grob", "viles")) for s in got[i].spans)
    assert got[1000].score < 0.5 and got[1001].score == got[1000].score and got[1000].spans == []
    assert [(s.start, s.end) for s in got[1002].spans] == [(2, 6), (9, 13)] and got[1003].score > 0.7
    assert toxicity.score_toxicity(asked.limit(0), model).count() == 0


def test_offsets_are_those_of_the_scored_tokens():
    text = "İstanbul vile x grob"
    words = toxicity.words_of(text)
    assert len(words) == 4
    hot = np.array([w in ("vile", "grob") for w in words])
    assert [text[s["start"] : s["end"]] for s in toxicity._spans(text, hot)] == ["vile", "grob"]


def test_held_out_labels_teach_nothing(spark, tmp_path):
    from zlib import crc32

    from matchloom.llm import queries

    rows = corpus(500, 3)
    held = {r[0] for r in rows if crc32(str(r[0]).encode()) % 3 == 1}
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "a/documents.parquet"))
    out = []
    for k in range(2):  # the held-out labels as they are, and turned round
        path = tmp_path / f"{k}"
        path.mkdir()
        (path / "documents.parquet").symlink_to(tmp_path / "a/documents.parquet")
        spark.createDataFrame([(i, 1 - y if k and i in held else y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(str(path / "labels.parquet"))
        out.append({r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op6_toxicity(spark, str(path)).collect()})
    assert out[0] == out[1] and {i for i, r in out[0].items() if r[0]} == held
    assert all(p == int(s >= 0.7) for _, s, p in out[0].values()) and np.mean([out[0][i][2] == y for i, _, y in rows if i in held]) > 0.95


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, model).first().score < 0.01
