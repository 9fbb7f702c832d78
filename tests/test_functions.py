"""Functions and operators on literal cases with known results."""

import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import ids, poisson, strings, text
from matchloom.operators import attrs, blocking, context, decide, dense, evaluate, features, shift
from matchloom.plans import dictionary, models, scorers
from matchloom.sources import files


def prepared(spark, rows, profile=text.BASE):
    df = spark.createDataFrame([(i, 1 if i % 2 else 2, "x", n, a) for i, (n, a) in enumerate(rows)], "id long, source int, country string, name string, address string")
    return {r.id: r for r in text.prepared(df, profile).collect()}


def test_names(spark):
    got = prepared(spark, [("AB1 C0rp (ID: 13882)", ""), ("Acme Holdings d/b/a Zed Labs", None), ("Straße & Cœur’s", ""), (None, "")])
    assert got[0].nt == ["abl", "corp"] and got[0].core == ["abl"]
    assert (got[1].al_pre, got[1].al_post, got[1].core) == ("acme holdings", "zed labs", ["acme", "zed"])
    assert got[2].nt == ["strasse", "and", "coeurs"] and got[3].nt == []


def test_extended_profile(spark):
    got = prepared(spark, [("Lycée Sainte Développement SARL et Compagnie & Associés", "155 Boulevard Constantin Descat, Tourcoing, Hauts-de-France"), ("Foo S.A.R.L. Service", "3 bd X")], text.EXTENDED)
    assert " ".join(got[0].nt) == "lycee sainte services llc and cie and partners"
    assert " ".join(got[0].at) == "155 blvd constantin descat tourcoing frhdf" and "frhdf" not in got[0].acore
    assert got[1].nt == ["foo", "llc", "service"] and got[1].core == ["foo", "service"] and got[1].at == ["3", "blvd", "x"]


def test_addresses(spark):
    got = prepared(spark, [("", "PO Box 12, 021st Street N, Austin, Texas"), ("", "155 Boulevard Constantin Descat, Tourcoing, Hauts-de-France"), ("", "000, n/a, null, West Virginia")])
    assert (got[0].at, got[0].acore, got[0].ncomp) == (["21", "st", "n", "austin", "tx"], ["21", "st", "austin"], 3)
    assert " ".join(got[1].at) == "155 blvd constantin descat tourcoing hauts de france" and "de" not in got[1].acore
    assert got[2].at == ["0", "wv"]


def test_scripts_and_forms(spark):
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["राम", "कमल", "x1", "कक", "শক্তি", "தமிழ்", "१२ॐ", "कं", "क्x"])], "i int, w string")
    assert [r[0] for r in words.orderBy("i").select(text.transliterated(F.col("w"))).collect()] == ["raam", "kamal", "x1", "kak", "shakti", "tamil", "12om", "kan", "kx"]
    df = spark.createDataFrame([("Foo S.A.R.L. & Co", "राम Ltd"), (None, None)], "a string, b string")
    got = df.select(text.legal_forms(F.col("a")).alias("f"), text.has_indic(F.col("b")).alias("i")).collect()
    assert (got[0].f, got[0].i) == ("co,sarl", True) and (got[1].f, got[1].i) == ("", False)
    rec = spark.createDataFrame([(1, " राम  Ltd ", 'a, "मुंबई"'), (2, "Café", "x"), (3, None, "मुंबई"), (4, "कमल राम", None)], "id long, name string, address string")
    lists = [spark.createDataFrame([r], "word string, latin string") for r in (("राम", "ram"), ("मुंबई", "mumbai"))]
    known = {r.id: (r.name_latin, r.address_latin, r.oov) for r in text.romanised(rec, *lists).collect()}
    assert known == {1: ("ram Ltd", "a, mumbai", 0), 2: ("Café", "x", 0), 3: (None, "mumbai", 0), 4: ("kamal ram", None, 1)}
    assert {r.id: (r.name_latin, r.oov) for r in text.romanised(rec).collect()} == {1: ("raam Ltd", 1), 2: ("Café", 0), 3: (None, 0), 4: ("kamal raam", 2)}
    street = spark.createDataFrame([("Zone A, 12 bis rue de la République, Paris",)], "a string").select(text.street_words(F.col("a"))).first()[0]
    assert street == ["republique"]
    line = spark.createDataFrame([("n", " ")], "n string, a string").select(text.serialised(F.col("n"), F.col("a"))).first()[0]
    assert line == "name: n ; address: [none]"


def test_ids(spark):
    r = spark.createDataFrame([("S3-42",)], "x string").select(ids.encode(F.col("x")).alias("n")).select("n", ids.decode(F.col("n")).alias("t")).first()
    assert (r.n, r.t) == (30_000_000_042, "S3-42")


def test_number_relation(spark):
    cases = [("123", "123"), ("1123", "123"), ("1234", "123"), ("23", "123"), ("12", "123"), ("123", "124"), ("123", "223"), ("100", "115"), ("100", "350")]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(cases)], "i int, x string, y string")
    assert [r[0] for r in df.orderBy("i").select(features.number_relation(F.col("x"), F.col("y"))).collect()] == list(range(9))
    none = features.number_features(spark.createDataFrame([([], ["12"])], "nums_1 array<string>, nums_2 array<string>")).first()
    assert {none[c] for c in ("hn_eq", "hn_any", "hn_sub", "hn_logd", "num_jac", "hn_rel", "nums_unB")} == {-1.0}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_string_scores():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rnd.choice("ab c") for _ in range(rnd.randrange(12))) for _ in "ab")
        assert strings.common(a, b) == lcs(a, b)
        n, short, long = len(a) + len(b), *sorted((a, b), key=len)
        assert strings.ratio(a, b) == pytest.approx(200 * lcs(a, b) / n if n else 100)
        if short:
            best = max(strings.ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))
            assert strings.partial(a, b) == pytest.approx(best)
    assert strings.token_sort("b a", "a b") == 100 and strings.token_set("new york mets", "mets") == 100 and strings.token_set("", "a") == 0
    assert strings.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6) and strings.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)


def expected(ps, k, missed):
    out = 0.0
    for truth in itertools.product((0, 1), repeat=len(ps)):
        p = np.prod([q if y else 1 - q for q, y in zip(ps, truth)])
        for m, pm in enumerate(missed):
            g, tp = sum(truth) + m, sum(truth[:k])
            out += p * pm * ((1.0 if g == 0 else 0.0) if k == 0 else 5 * tp / (g + 4 * k))
    return out


def test_counts_of_links(spark):
    assert poisson.pmf([0.9, 0.6, 0.2]) == pytest.approx([0.032, 0.344, 0.516, 0.108])
    got = spark.createDataFrame([([0.9, 0.6, 0.2],)], "p array<double>").select(poisson.pmf_column(F.col("p"))).first()[0]
    assert got == pytest.approx([0.032, 0.344, 0.516, 0.108])
    rnd = random.Random(2)
    for _ in range(60):
        ps, missed = sorted((rnd.random() for _ in range(rnd.randrange(1, 6))), reverse=True), rnd.choice([np.ones(1), poisson.poisson(0.1, 3)])
        k, e = poisson.best_count(ps, missed)
        every = [expected(ps, j, missed) for j in range(len(ps) + 1)]
        assert e == pytest.approx(max(every)) and every[k] == pytest.approx(max(every))


PAIRS = "s1 long, t long, p double"


def links(df):
    return sorted((r.s1, r.t) for r in df.collect())


def test_decisions(spark):
    df = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.8), (2, 11, 0.75), (3, 12, 0.4), (4, 13, 0.7), (4, 14, 0.45), (5, 15, 0.6)], PAIRS)
    assert links(decide.exclusive(df)) == [(1, 10), (2, 11), (4, 13)]
    assert links(decide.threshold(df)) == [(1, 10), (2, 10), (2, 11), (4, 13)]
    assert links(decide.top_relative(df)) == [(1, 10), (2, 10), (2, 11), (4, 13), (5, 15)]
    assert links(decide.two_thresholds(df)) == [(1, 10), (2, 10), (2, 11), (4, 13), (5, 15)]
    want = [(1, 10), (2, 11)] + [(s, t) for s, ts, ps in ((4, [13, 14], [0.7, 0.45]), (5, [15], [0.6]), (3, [12], [0.4])) for t in ts[: poisson.best_count(ps)[0]]]
    assert links(decide.expected_decode(df)) == sorted(want)
    assert decide.expected_best(df).count() > 3
    up = decide.recall_rule(df, F.lit(True)).where("p > 0.7 AND p < 0.701")
    assert links(up) == [(3, 12), (4, 13), (4, 14), (5, 15)]


def test_duplicates(spark):
    t = spark.createDataFrame([(i, n, "a", "c") for i, n in ((1, "X"), (2, " x"), (3, "x "), (4, "y"), (5, "y"), (6, "y"), (7, "z"))], "id long, name string, address string, country string")
    have = spark.createDataFrame([(100, 1), (101, 4), (102, 5)], "s1 long, t long")
    assert links(decide.duplicate_links(t, have)) == [(100, 2), (100, 3)]


def test_edits(spark):
    cases = [("Foo SARL", "Foo SAS", "lf_change"), ("Foo", "Foo s.a.r.l.", "lf_add"), ("Foo SAS", "foo sas", "same_name"), ("Foo", "Bar", "nooverlap"), ("Foo Bar", "Foo Groupe", "filler"), ("Foo", "Foo Baz", "other")]
    df = spark.createDataFrame(cases, "a string, b string, k string")
    assert all(r.k == r.g for r in df.withColumn("g", decide.edit_kind(F.col("a"), F.col("b"))).collect())
    low = spark.createDataFrame([("Foo", "Foo France SA", True), ("Foo", "Foo Societe", False), ("Foo", "Bar", False)], "a string, b string, k boolean")
    assert all(r.k == r.g for r in low.withColumn("g", decide.low_band_ok(F.col("a"), F.col("b"))).collect())


def test_f05(spark):
    ev = spark.createDataFrame([(i,) for i in range(1, 5)], "s1 long")
    truth, chosen = spark.createDataFrame([(1, 10), (3, 30), (4, 40)], "s1 long, t long"), spark.createDataFrame([(1, 10), (1, 11), (3, 31)], "s1 long, t long")
    got = {r.s1: r.f for r in evaluate.per_query(ev, truth, chosen).collect()}
    assert got == {1: pytest.approx(5 / 9), 2: 1.0, 3: 0.0, 4: 0.0}


def test_sets_and_audit(spark, tmp_path):
    ev = spark.createDataFrame([(10_000_000_001,), (10_000_000_002,)], "s1 long")
    sets = files.set_output(ev, spark.createDataFrame([(10_000_000_001, 20_000_000_005, 0.5), (10_000_000_001, 30_000_000_001, 0.9)], PAIRS), "p", "matched_entity_ids")
    assert sorted(map(tuple, sets.collect())) == [("S1-1", "S3-1,S2-5"), ("S1-2", "")]
    assert files.set_links(sets, "matched_entity_ids").count() == 2
    more = files.patch_sets(sets, spark.createDataFrame([(10_000_000_002, 20_000_000_009), (10_000_000_001, 20_000_000_005)], "s1 long, t long"), "matched_entity_ids")
    assert sorted(map(tuple, more.collect())) == [("S1-1", "S3-1,S2-5"), ("S1-2", "S2-9")]
    bad = files.audit(more, sets.withColumnRenamed("matched_entity_ids", "candidate_entity_ids")).first()
    assert (bad.not_candidates, bad.repeated_t, bad.n_matches, bad.most_matches) == (1, 0, 3, 2)
    rows = spark.createDataFrame([('a "q"', None, "x\ty")], "u string, v string, w string")
    files.write_tsv(rows, str(tmp_path / "t"))
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "t"), ["u", "v", "w"]).collect()] == [('a "q"', "", "x y")]


def test_context(spark):
    df = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.8), (3, 10, 0.1), (1, 11, 0.3)], "s1 long, t long, p1 double").withColumn("st", F.lit("a"))
    got = {(r.s1, r.t): r for r in context.stage2(df).collect()}
    assert [got[k].p_t_other for k in ((1, 10), (2, 10), (3, 10), (1, 11))] == [0.8, 0.9, 0.9, 0.0]
    assert got[1, 11].p_s1_gap == pytest.approx(-0.6) and got[1, 10].p_same_st == pytest.approx(0.3)


def test_dense(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, 1 if i % 4 == 0 else 2, "ab"[i % 2 if i % 4 else 0], rnd.standard_normal(8).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, source int, country string, v array<double>")
    got = dense.top_k_cosine(df, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, dense.top_k_cosine(df, 5, block=7).collect()))  # one block, and many
    some = dense.top_k_cosine(df, 5, spark.createDataFrame([(0,), (8,)], "id long"), block=7).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(g) for g in got if g.s1 in (0, 8))
    unit = {r[0]: np.array(r[3]) / np.linalg.norm(r[3]) for r in rows}
    for r in rows:
        if r[1] == 1:
            sims = sorted(((-round(float(unit[r[0]] @ unit[t[0]]), 9), t[0]) for t in rows if t[1] == 2 and t[2] == r[2]))[:5]
            assert [(x.t) for x in sorted((g for g in got if g.s1 == r[0]), key=lambda g: g.drank)] == [t for _, t in sims]


def test_shift_and_vetoes(spark):
    add = spark.createDataFrame([(i, i, "fr", ["a", "old"], ["a", "old"], ["a", "newword"], ["a", "newword"]) for i in range(30)] + [(99, 99, "fr", ["a"], ["a"], ["a", "extra"], ["a", "extra"])], "s1 long, t long, country string, nt1 array<string>, c1 array<string>, nt2 array<string>, c2 array<string>")
    x = shift.single_additions(add)
    words = shift.type_words(x, 20)
    assert [(r.a, r.n, r.n_add) for r in words.collect()] == [("newword", 30, 0)]
    assert shift.type_word_veto(x, words).count() == 30
    s = spark.createDataFrame([(0.94,), (0.95,), (0.29,), (0.3,)], "p double").select(shift.score_bin(F.col("p")))
    assert [r[0] for r in s.collect()] == [0.9, 0.95, 0.0, 0.3]


def test_learned_words(spark):
    p = spark.createDataFrame([(["राम", "x"], ["ram", "y"]), (["राम"], ["raam"]), (["राम"], ["ram"]), (["a"], ["b", "c"])], "native array<string>, latin array<string>")
    assert [tuple(r) for r in dictionary.learn_words(p).collect()] == [("राम", "ram", 2)]
    assert [tuple(r) for r in dictionary.learn_components(p.where("size(native) = 1 AND native[0] = 'राम'")).collect()] == [("राम", "raam", 1)]


def test_keys_and_blocking(spark):
    rows = [(10_000_000_001, 1, "us", "Acme Rocket Works", "12 Main Street, Austin"), (20_000_000_001, 2, "us", "ACME Rockets", "12 Main St, Austin"), (20_000_000_002, 2, "fr", "Acme Rocket Works", "12 Main Street, Austin"), (20_000_000_003, 2, "us", "Zed", "")]
    p = text.prepared(spark.createDataFrame(rows, "id long, source int, country string, name string, address string"))
    assert links(blocking.block(p)) == [(10_000_000_001, 20_000_000_001)]
    v = blocking.base_view(p)
    k = {(r.id, r.k) for r in blocking.keys(v, blocking.token_df(v.where("source > 1"))).collect()}
    assert (20_000_000_003, "N1zed") in k and (20_000_000_001, "HA12|austin") in k and (20_000_000_001, "N1acme") not in k


def test_models(spark):
    rnd = random.Random(3)
    rows = [(i, 1000 + i, x, None if i % 9 == 0 else x, int(x > 0.5)) for i in range(400) for x in [rnd.random()]]
    df = spark.createDataFrame(rows, "s1 long, t long, a double, b double, y int")
    out, ms = models.out_of_fold(df, ["a", "b"], "p", folds=2, rounds=3, depth=2)
    ev = evaluate.auc(out, "p").first()
    assert out.count() == 400 and ev.auc > 0.95 and len(ms) == 2
    assert models.fold_average(ms, df, ["a", "b"], "q").where("q BETWEEN 0 AND 1").count() == 400
    assert models.importances(ms[0], ["a", "b"])[0][1] > 0 and out.where("b IS NULL").count() == 45
    g = scorers.gate(out.withColumn("p1", F.col("p")))
    assert g.where("half NOT IN (0, 1)").count() == 0


def test_stored_models_score_alike(spark, tmp_path):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, 1000 + i, rnd.random(), rnd.random() if i % 5 else None, i % 2) for i in range(200)], "s1 long, t long, a double, b double, y int")
    _, ms = models.out_of_fold(df, ["a", "b"], "p", folds=2, rounds=3, depth=3)
    models.save(spark, str(tmp_path), ms, ["a", "b"])
    loaded, names = models.load(spark, str(tmp_path))
    score = lambda m: sorted((r.s1, r.q) for r in models.fold_average(m, df, names, "q").collect())
    assert score(loaded) == score(ms) and names == ["a", "b"]


def test_row_sets_are_checked(spark):
    a = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.7)], "s1 long, t long, ce double")
    models.same_rows(a, a)
    for other in (a.where("s1 = 1"), a.unionByName(a)):
        with pytest.raises(ValueError, match="same pairs"):
            models.same_rows(a, other)
        with pytest.raises(Exception, match="not scored once"):
            scorers.mean_of([a, other]).collect()


def test_rescue(spark):
    street = "12 bis rue de la République, Paris"
    names = {1: "Foo Bar", 2: "Baz Qux", 3: "Zed Works", 4: "Nul Un", 5: "Claimed Co"}
    rows = [(10_000_000_000 + i, 1, "fr", n, street) for i, n in names.items()]
    rows += [(20_000_000_001, 2, "fr", "Foo Bar SARL", street), (20_000_000_002, 2, "fr", "Baz Qux", "14 rue de la République, Paris"), (20_000_000_003, 2, "fr", "Zed Works France", street), (20_000_000_004, 2, "fr", "Other Name", street), (20_000_000_005, 2, "fr", "Claimed Co", street)]
    rec = spark.createDataFrame(rows, "id long, source int, country string, name string, address string")
    scores = spark.createDataFrame([(10_000_000_000 + i, 20_000_000_000 + i, p) for i, p in ((1, 0.3), (2, 0.6), (3, 0.1), (4, 0.6), (5, 0.6))], PAIRS)
    taken = spark.createDataFrame([(10_000_000_099, 20_000_000_005)], "s1 long, t long")
    got = decide.rescue(scores, taken, rec, attrs.record_view(text.prepared(rec))).collect()
    # 2: another number; 4: no word in common; 5: somebody's already
    assert sorted((r.s1 % 100, r.t % 100, r.kind) for r in got) == [(1, 1, "lf_add"), (3, 3, "filler")]


def test_decoding_leaves_a_target_one_query(spark):
    df = spark.createDataFrame([(1, 10, 0.8, True), (2, 10, 0.9, False), (1, 11, 0.75, True), (3, 12, 0.71, False)], PAIRS + ", seen boolean")
    assert links(decide.decode_seen(df)) == [(1, 11), (2, 10), (3, 12)]


def test_bootstrap(spark):
    rnd = random.Random(6)
    d = [rnd.choice([0.0, 0.0, 0.2, -0.1]) for _ in range(400)]
    a = spark.createDataFrame([(i, 0.5) for i in range(400)], "s1 long, f double")
    b = spark.createDataFrame([(i, 0.5 + x) for i, x in enumerate(d)], "s1 long, f double")
    r = evaluate.bootstrap(a, b).first()
    se = np.std(d) / 20
    assert abs(r.delta - np.mean(d)) < 4 * se / np.sqrt(200) + 1e-3 and 0.8 * se < r.se < 1.2 * se and r.low < np.mean(d) < r.high


def test_missed_by_likeness(spark):
    rows = [(1, 1, "Foo Bar", "1 Main St"), (2, 2, "Foo Bar", "1 Main St"), (3, 2, "Quite Unlike", "1 Main St"), (4, 2, "Foo Bar", "99 Elsewhere Avenue"), (5, 2, "foo.com", "x"), (6, 2, "राम", "x"), (7, 2, "Foo", " ")]
    rec = spark.createDataFrame([(i, s, "c", n, a) for i, s, n, a in rows], "id long, source int, country string, name string, address string")
    truth = spark.createDataFrame([(1, t) for t in range(2, 8)], "s1 long, t long")
    got = {r.t: r.cat for r in evaluate.missed(truth, truth.limit(0), text.prepared(rec)).collect()}
    assert got == {2: "similar", 3: "renamed", 4: "other address", 5: "domain", 6: "native script", 7: "empty address"}


def test_auc_of_any_scale(spark):
    rnd = random.Random(7)
    rows = [(round(rnd.gauss(0, 5), 2), int(rnd.random() < 0.4)) for _ in range(500)] + [(0.0, 1), (-0.0, 0), (1e30, 1), (-1e30, 0)]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluate.auc(spark.createDataFrame(rows, "p double, y int"), "p").first().auc == pytest.approx(want)


def test_tables_go_with_their_owner(spark):
    from matchloom import storage

    with storage.Tables(spark) as tables:
        t = tables.write(spark.range(5))
        path = t.inputFiles()[0].removeprefix("file://")
        assert t.count() == 5 and Path(path).exists()
    assert not Path(path).exists()


def test_windows_of_a_stream(spark, tmp_path):
    from matchloom import fixtures
    from matchloom.streaming import incremental

    e = fixtures.table(spark, "/root/testdata/sf0.001", "events")
    e.write.parquet(str(tmp_path / "in"))
    live = incremental.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    live.writeStream.outputMode("complete").format("memory").queryName("live_windows").trigger(availableNow=True).start().awaitTermination()
    key = lambda d: sorted((r.start, r.event_type, r.n, round(r.mean_value, 9)) for r in d.collect())
    assert key(spark.table("live_windows")) == key(incremental.windowed_counts(e))


def test_a_whole_job(spark, tmp_path):
    from matchloom import fixtures
    from matchloom.plans import linkage

    rec = fixtures.part_records(spark, "/root/testdata/sf0.001")
    config = linkage.LinkageConfig(folds=2, rounds=2, depth=2, rank_permille=1000)
    scored = linkage.train(rec, fixtures.part_truth(rec), str(tmp_path), config)
    new = linkage.apply(rec, str(tmp_path), config)
    models.same_rows(scored, new)  # one score for each pair, and the same pairs
    assert scored.where("p1 NOT BETWEEN 0 AND 1 OR p2 NOT BETWEEN 0 AND 1").isEmpty() and scored.select("fold").distinct().count() == 2


def test_view_counts(spark):
    rows = [(10_000_000_001, 1, "us", "Acme", "1 A"), (20_000_000_001, 2, "us", "Acme", "1 A"), (20_000_000_002, 2, "us", "Acme", None)]
    v = attrs.record_view(text.prepared(spark.createDataFrame(rows, "id long, source int, country string, name string, address string")))
    a = {r.id: r for r in attrs.record_attrs(v).collect()}
    assert (a[10_000_000_001].cc_fs1, a[10_000_000_001].cc_ft, a[20_000_000_002].acs, a[20_000_000_002].acs_ft, a[20_000_000_002].hn) == (1, 2, None, 0, "")


def test_records_are_merged_with_pairs_not_broadcast(spark):
    view = attrs.record_view(text.prepared(spark.createDataFrame([(1, 1, "us", "red fox", "1 high st"), (2, 2, "us", "red cat", "1 low st")], "id long, source int, country string, name string, address string")))
    weighed = attrs.weighed(view, 1)
    p = features.with_records(spark.createDataFrame([(1, 2)], "s1 long, t long"), weighed)
    assert [sorted(m) for m in p.select("wn_1", "wn_2").first()] == [["fox", "red"], ["cat", "red"]]
    for df, sides in ((weighed, "id"), (p, "s1 t")):  # by files' sizes millions of records look small
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("rightHint=(strategy=merge)") >= len(sides.split()), plan


def test_dense_copies_cost_k_rows(spark, monkeypatch):
    best = dense._best
    monkeypatch.setattr(dense, "_best", lambda sims, *a: best(sims, *a) if sims.shape[0] <= 4 and sims.shape[1] <= 4 * 3 else 1 / 0)
    vs = [[1.0, 0.0], [0.0, 2.0], [1.0, 1.0], [0.0, 0.0]]
    rows = [(i, 1 if i % 3 == 0 else 2, "a", vs[i // 3 % 4]) for i in range(600)]
    got = dense.top_k_cosine(spark.createDataFrame(rows, "id long, source int, country string, v array<double>"), 3).collect()
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / max(sum(x * x for x in a) * sum(y * y for y in b), 1e-300) ** 0.5, 9)
    want = {(s, t[1], -t[0], n) for s, kind, _, a in rows if kind == 1 for n, t in enumerate(sorted((-cos(a, b), t) for t, kind, _, b in rows if kind == 2)[:3], 1)}
    assert {(r.s1, r.t, r.dscore, r.drank) for r in got} == want and len(got) == 600


def test_best_of_a_row():
    sims = np.array([[0.5, np.nan, 0.5000000001, 0.9, 0.5], [np.nan, np.nan, -1.0, np.nan, 0.25]])
    at, score = dense._best(sims, 3, 9)
    assert at.tolist() == [[3, 0, 2], [4, 2, 0]] and score[0].tolist() == [0.9, 0.5, 0.5] and np.isnan(score[1, 2])
    assert dense._best(sims[:1, :2], 3, 9)[0].tolist() == [[0, 1]]
