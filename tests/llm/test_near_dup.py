import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from matchloom.llm import graph, overlap, simhash, vectors


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(400, 400 + i) for i in range(1, 90)] + [(500 + i, 501 + i) for i in range(60)]
    want = union(600, pairs)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text, width=4):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint():
    for t in ["", None, " \n", "One", "one two THREE four", "a b c d e", "É é \xa0 x\x1cy z w", "w " * 70000, "the cat sat on the mat and the dog"]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_segments_follow_the_count():
    assert simhash.best_parts(1000, 4) >= simhash.best_parts(10**6, 4) >= simhash.best_parts(10**10, 4) == 2


@pytest.mark.parametrize("bucket", [4, 512])
@pytest.mark.parametrize("parts", [2, 3, 5, None])
def test_links_are_exact(spark, parts, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(parts)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = {0, 1, (1 << 64) - 1} | set(base)
    for b in base[:40]:
        for _ in range(6):
            x = b
            for bit in rnd.sample(range(64), rnd.randrange(1, 7)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4}
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, parts).collect()}
    assert got == want


def test_large_buckets_keep_the_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rnd = random.Random(9)
    fps = set()
    for _ in range(4):
        x = rnd.getrandbits(64)
        for _ in range(120):
            y = x
            for bit in rnd.sample(range(64), rnd.randrange(1, 9)):
                y ^= 1 << bit
            fps.add(y)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    order = sorted(range(len(fps)), key=signed.__getitem__)
    f, z = [fps[i] for i in order], [signed[i] for i in order]
    pairs = [(i, j) for i in range(len(f)) for j in range(i) if bin(f[i] ^ f[j]).count("1") <= 4]
    want = union(len(f), pairs)
    frame = spark.createDataFrame([(x,) for x in z], "fp long")
    linked = {i for p in pairs for i in p}
    for bucket in (8, 512):  # the same on both sides of the limit
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = {r.node: r.component for r in graph.connected_components(simhash.connecting(frame, 4, 3)).collect()}
        assert got == {z[i]: z[want[i]] for i in linked}


def test_segments_are_enough():
    for radius in range(7):
        for parts in range(1, 6):
            probed = simhash.segments(radius, parts)
            assert sum(w for _, w, _ in probed) <= 64 and sum(own + 1 for _, _, own in probed) == radius + 1


def test_documents(spark):
    rnd = random.Random(3)
    words = ["w%d" % i for i in range(500)]
    base = [" ".join(rnd.choice(words) for _ in range(120)) for _ in range(12)]
    texts = base + [t.replace(t.split()[50], "other", 1) for t in base] + [base[0]] * 30 + [None, "", " ", "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base[1]), (2, base[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS fp", "doc_id AS component_id")
    fps = [slow_fingerprint(t) for t in texts]
    want = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, want))}
    kept = [r.doc_id for r in simhash.simhash_dedup(docs).collect()]
    assert set(kept) == {c for c in want} and kept.count(2) == 2
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def slow_vectors(rows):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.93]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[good[a][0]] += 1
        n[good[b][0]] += 1
    ids = sorted(n)
    at = {x: k for k, x in enumerate(ids)}
    root = union(len(ids), [(at[good[a][0]], at[good[b][0]]) for a, b in links])
    return {i: (n[i], ids[root[at[i]]]) for i in ids}


@pytest.mark.parametrize("block", [512, 8])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rnd = np.random.default_rng(2)
    rows, centre = [], rnd.standard_normal((12, 16))
    for i in range(240):
        c = centre[i % 12]
        rows.append((i, [float(np.float32(x)) for x in c + rnd.standard_normal(16) * (0.02 if i % 3 else 0.3)], i % 2))
    rows += [(300 + i, rows[5][1], 1) for i in range(40)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 0), (404, rows[0][1], None), (405, [float("inf")] * 16, 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (408, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "vec_id AS id", "label AS part")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    want = slow_vectors(rows)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_any_length(spark):
    rows = [(1, [1e200, 1e200, 0.0], 0), (2, [1e200, 1.1e200, 0.0], 0), (3, [1e-200, 1e-200, 0.0], 0), (4, [0.0, 0.0, 1e300], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_tables_follow_the_count():
    for n in (1000, 10**6, 10**9):
        planes, tables = vectors.layout(n, 0.93)
        assert n / 2**planes <= vectors.BLOCK and (1 - (1 - np.arccos(0.93) / np.pi) ** planes) ** tables <= vectors.MISS
    assert vectors.layout(1000, 0.93)[0] == 10


def slow_shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_overlap_links_every_pair_of_similarity_08(spark, monkeypatch):
    monkeypatch.setattr(overlap, "GROUP", 8)
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfghk" for b in "aeiou"]
    texts = []
    for i in range(40):
        base = [rnd.choice(words) + rnd.choice(words) for _ in range(rnd.choice([30, 80, 200]))]
        for changed in (0, 1, 2, 3, 5):
            copy = list(base)
            for at in rnd.sample(range(len(base)), changed):
                copy[at] = f"new{rnd.random()}"
            texts.append(" ".join(copy))
    body = [rnd.choice(words) + rnd.choice(words) for _ in range(120)]
    texts += [" ".join([*body[:60], f"v{i}", *body[60:]]) for i in range(40)] + [texts[3].upper().replace(" ", "\n")] + ["one two", "One two", "", None, "three"]
    sets = [slow_shingles(t) for t in texts]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near(sets[i], sets[j])]
    fp = [slow_fingerprint(t, 5) for t in texts]
    assert sum((fp[i] ^ fp[j]).bit_count() > 4 for i, j in pairs) > 50  # what SimHash within 4 bits leaves
    want = union(len(texts), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in overlap.overlap_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df.selectExpr("*", "'en' AS lang", "'a' AS source", "1L AS n_chars"), "").collect()}
    assert left == set(want)


def test_overlap_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(1, 61))
    rows = [(None, a), (None, b), (7, "other words stand here in a row"), (7, a + " more")]
    got = [(r.doc_id, r.component_id) for r in overlap.overlap_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == [(7, 7), (7, 7), (None, 7), (None, 7)]
    got = overlap.overlap_components(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(None, None)] * 2


def test_ties_are_those_of_fingerprints(spark, monkeypatch):
    rnd = random.Random(8)
    size, width, number = 400, 8, 6
    centres = [[rnd.getrandbits(1) for _ in range(width * number + overlap.CHECK)] for _ in range(40)]
    bits = [[b ^ (rnd.random() < rnd.choice([0.02, 0.1, 0.16, 0.2])) for b in centres[rnd.randrange(40) if i % 3 else 0]] for i in range(size)]
    value = lambda x: int("".join(map(str, x)), 2)
    segs = [[value(x[i : i + width]) for i in range(0, width * number, width)] for x in bits]
    check = [value(x[width * number :]) for x in bits]
    pairs = [(i, j) for i in range(size) for j in range(i) if any(map(int.__eq__, segs[i], segs[j])) and (check[i] ^ check[j]).bit_count() <= overlap.RADIUS]
    want = union(size, pairs)
    signed = lambda x: x - (x >> 63 << 64)
    rows = [(i, segs[i], signed(check[i] >> 64), signed(check[i] & (1 << 64) - 1)) for i in range(size)] + [(size, [], 0, 0), (size + 1, [], 0, 0)]
    nodes = spark.createDataFrame(rows, "fp long, segs array<int>, c long, d long")
    counts = []
    for bucket, edges in ((1 << 20, 1 << 20), (7, 1 << 20), (1 << 20, 50)):  # compared where they are sorted, by pairs of blocks; thinned in parts
        monkeypatch.setattr(overlap, "BUCKET", bucket)
        monkeypatch.setattr(overlap, "EDGES", edges)
        found = [tuple(r) for r in overlap.ties(nodes).collect()]
        assert union(size, found) == want
        counts.append(len(found))
    assert counts[0] <= number * size < len(pairs) * 2


def test_fingerprints_of_similar_sets():
    rnd = np.random.default_rng(3)
    for n in (10**2, 10**5, 10**9):
        width, number = overlap.layout(n)
        assert (1 - (1 - overlap.DIFFER) ** width) ** number <= overlap.MISS and width * number + overlap.CHECK <= 64 * 512
    width, number = overlap.layout(50_000)
    found, apart = 0, 0
    far = lambda x, y: sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x[1:], y[1:]))
    for i in range(300):
        n = [10, 15, 50, 300, 600][i % 5]
        drawn = [np.unique(rnd.integers(0, 1 << 63, n, np.uint64)) for _ in range(2)]
        gone = rnd.permutation(n)[: n // 5]
        both = drawn[0], np.delete(drawn[0], gone)  # Jaccard of 0.8 exactly
        x, y, z = (overlap.signature(s, width, number) for s in (*both, drawn[1]))
        found += far(x, y) <= overlap.RADIUS and any(p == q for p, q in zip(x[0], y[0]))
        apart += far(x, z) > overlap.RADIUS
    assert found >= 298 and apart >= 299
    assert overlap.signature(drawn[0][:0], width, number) == ([], 0, 0)
