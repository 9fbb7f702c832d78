"""Queries of sources, ids, normal forms, blocking, attributes and features (groups A to F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import storage
from ..functions import ids, strings, text, vocab
from ..operators import attrs, blocking, decide, features
from ..sources import files
from .common import query, r

# --- SQL of the normal forms -------------------------------------------------------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(map(lit, sorted(words))) + ")"


def sql_map(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in sorted(d.items())) + "}"


def fold_sql(x: str) -> str:
    x = f"coalesce({x}, '')"
    for k, v in vocab.SPECIAL.items():
        x = f"replace({x}, {lit(k)}, {lit(v)})"
    return f"lower(strip_accents({x}))"


ALIAS_SQL = r"\b(?:" + "|".join(vocab.ALIASES) + r")\b"


def prepared_sql(records: str) -> str:
    """CTE prepared over a records CTE."""
    tok = f"CASE WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[a-z]') THEN translate(t, {lit(vocab.LEET_FROM)}, {lit(vocab.LEET_TO)}) ELSE t END"
    num = "CASE WHEN regexp_full_match(u, '[0-9]+') THEN coalesce(nullif(ltrim(u, '0'), ''), '0') ELSE u END"
    return rf"""p1 AS MATERIALIZED (SELECT *, regexp_replace(replace(replace({fold_sql('name')}, '&', ' and '), '+', ' and '), '\(?\bid\s*:\s*\d+\)?', ' ', 'g') AS nf,
    list_filter(list_transform(string_split(regexp_replace({fold_sql('address')}, '\b(?:p\.?\s*o\.?\s*box|pmb)\s*#?\s*\d+', ' ', 'g'), ','), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c NOT IN ('', 'null', 'n/a', 'na')) AS comps FROM {records}),
p2 AS MATERIALIZED (SELECT *, list_transform(regexp_extract_all(nf, '[a-z0-9]+'), lambda t: {tok}) AS nt,
    CASE WHEN regexp_matches(nf, {lit(ALIAS_SQL)}) THEN trim(regexp_extract(nf, {lit('(?s)^(.*?)' + ALIAS_SQL)}, 1)) END AS al_pre,
    CASE WHEN regexp_matches(nf, {lit(ALIAS_SQL)}) THEN trim(regexp_extract(nf, {lit('(?s)^.*?' + ALIAS_SQL + '(.*)$')}, 1)) END AS al_post,
    flatten(list_transform(comps, lambda c: CASE WHEN c IN {among(vocab.STATES)} THEN [{sql_map(vocab.STATES)}[c]] ELSE
      list_transform(list_transform(list_transform(regexp_extract_all(c, '[a-z0-9]+'), lambda t: regexp_replace(t, '^(\d+)(?:st|nd|rd|th)$', '\1')), lambda t: coalesce({sql_map(vocab.ADDRESS_FORMS)}[t], t)), lambda u: {num}) END)) AS "at" FROM p1),
prepared AS MATERIALIZED (SELECT *, list_filter(nt, lambda t: t NOT IN {among(vocab.LEGAL | vocab.HONOR | vocab.NOISE)}) AS core, list_filter("at", lambda t: t NOT IN {among(vocab.ADDRESS_DROP | set(vocab.STATES.values()))}) AS acore, len(comps) AS ncomp FROM p2)"""


VIEW_SQL = """v0 AS (SELECT * REPLACE (CASE WHEN len(core) > 0 THEN core ELSE nt END AS core) FROM prepared),
view_ AS MATERIALIZED (SELECT id, source, country, name, address, nt, core, "at", acore, al_pre, al_post, ncomp, array_to_string(nt, ' ') AS ns, array_to_string(core, ' ') AS cs, array_to_string(core, '') AS cc, array_to_string(nt, '') AS nc,
  array_to_string("at", ' ') AS as_, array_to_string(acore, ' ') AS acs, list_filter(acore, lambda t: regexp_full_match(t, '[0-9]+')) AS nums, trim(coalesce(address, '')) = '' AS aempty,
  coalesce(regexp_matches(name, '(?i)\\.com|www\\.|^@'), false) AS dom, coalesce(regexp_matches(name, '[ऀ-෿]'), false) AS ind FROM v0)"""

DOCS, PARTS = (fx.DOC_RECORDS, prepared_sql("doc_records")), (fx.PART_RECORDS, prepared_sql("part_records"))


# --- A: sources and sinks ------------------------------------------------------------------------------------------------


def scratch(spark, name: str) -> str:
    """A folder of the session's own, which goes with it."""
    return storage.session_tables(spark).path(name)


@query(fx.sql(fx.PART_RECORDS, body="SELECT 'S' || source || '-' || (id % 10000000000) AS entity_id, name AS business_name, address AS business_address, country FROM part_records"))
def a1_tsv_roundtrip(spark, sf_dir):
    """A1, A2: records written as tab-separated text and read back."""
    p = fx.part_records(spark, sf_dir)
    out = p.select(ids.decode(F.col("id")).alias("entity_id"), F.col("name").alias("business_name"), F.col("address").alias("business_address"), "country")
    path = scratch(spark, "tsv")
    files.write_tsv(out, path)
    return files.read_tsv(spark, path, out.columns)


@query(fx.sql(fx.PARTY_RECORDS, body="SELECT source::BIGINT AS source, count(*) AS n, max(id) AS last FROM party_records GROUP BY source"))
def a4_multi_scan(spark, sf_dir):
    """Parts written by source to folders of their own, scanned together."""
    rec, path = fx.party_records(spark, sf_dir), scratch(spark, "parts")
    for s in (1, 2):
        rec.where(F.col("source") == s).write.parquet(f"{path}/s{s}")
    return files.read_parts(spark, f"{path}/s1", f"{path}/s2").groupBy("source").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("SELECT 'brand' AS kind, p_brand AS key, max(p_type) AS value FROM part GROUP BY p_brand")
def a7_dictionary(spark, sf_dir):
    """A dictionary written and read as JSON."""
    d = fx.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.max("p_type").alias("value")).withColumn("kind", F.lit("brand"))
    path = scratch(spark, "dict")
    files.write_dictionary(d, path)
    return files.read_dictionary(spark, path)


def _sets(spark, sf_dir):
    pairs = fx.scored_pairs(spark, sf_dir)
    s1 = fx.table(spark, sf_dir, "customer").select((F.lit(ids.BASE) + F.col("c_custkey")).alias("s1"))
    wide = pairs.select((F.lit(ids.BASE) + F.col("s1")).alias("s1"), (F.lit(2 * ids.BASE) + F.col("t")).alias("t"), F.col("p2").alias("p"))
    return s1, wide


SETS_SQL = """s AS (SELECT 'S1-' || c_custkey AS source1_entity_id, c_custkey AS s1 FROM customer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p2 DESC, s1) AS rt FROM scored_pairs),
m AS (SELECT s1, string_agg('S2-' || t, ',' ORDER BY p2 DESC, t) AS x FROM ranked WHERE rt = 1 AND p2 >= 0.7 GROUP BY s1),
c AS (SELECT s1, string_agg('S2-' || t, ',' ORDER BY p2 DESC, t) AS x FROM scored_pairs GROUP BY s1),
matches AS (SELECT source1_entity_id, coalesce(x, '') AS matched_entity_ids FROM s LEFT JOIN m USING (s1)),
cands AS (SELECT source1_entity_id, coalesce(x, '') AS candidate_entity_ids FROM s LEFT JOIN c USING (s1))"""


@query(fx.sql(fx.SCORED_PAIRS, SETS_SQL, body="SELECT * FROM matches"))
def a9_set_output(spark, sf_dir):
    """One row per query with its matches by score."""
    s1, pairs = _sets(spark, sf_dir)
    return files.set_output(s1, decide.exclusive(pairs), "p", "matched_entity_ids")


@query(fx.sql(fx.SCORED_PAIRS, SETS_SQL, body="SELECT 10000000000 + s1 AS s1, 20000000000 + t AS t FROM ranked WHERE rt = 1 AND p2 >= 0.7"))
def a10_set_links(spark, sf_dir):
    """A10: the links of a set-valued table."""
    s1, pairs = _sets(spark, sf_dir)
    return files.set_links(files.set_output(s1, decide.exclusive(pairs), "p", "matched_entity_ids"), "matched_entity_ids")


FAULTS_SQL = """split AS (SELECT s1, source1_entity_id, list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') AS l, list_filter(string_split(candidate_entity_ids, ','), lambda x: x <> '') AS c FROM matches JOIN cands USING (source1_entity_id) JOIN s USING (source1_entity_id)),
bad_m AS (SELECT CASE WHEN s1 % 29 = 0 THEN 'X' || source1_entity_id ELSE source1_entity_id END AS source1_entity_id, CASE WHEN s1 % 17 = 0 THEN list_append(l, 'S9-x') WHEN s1 % 19 = 0 AND len(l) > 0 THEN list_append(l, l[1]) ELSE l END AS m FROM split, (SELECT unnest([0, 1]) AS again) WHERE again = 0 OR s1 % 31 = 0),
bad_c AS (SELECT source1_entity_id, c FROM split WHERE s1 % 23 <> 0),
au AS (SELECT * FROM bad_m FULL JOIN bad_c USING (source1_entity_id))"""


def _faulty(df, name, c):
    """Sets as the SQL's bad_m and bad_c have them: lists changed, ids broken, rows repeated or lost."""
    k = F.regexp_extract("source1_entity_id", "[0-9]+$", 0).cast("long")
    l = F.filter(F.split(name, ","), lambda x: x != "")  # noqa: E741
    if c:
        return df.where(k % 23 != 0)
    m = F.when(k % 17 == 0, F.concat(l, F.array(F.lit("S9-x")))).when((k % 19 == 0) & (F.size(l) > 0), F.concat(l, F.slice(l, 1, 1))).otherwise(l)
    again = F.explode(F.when(k % 31 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.select(F.when(k % 29 == 0, F.concat(F.lit("X"), F.col("source1_entity_id"))).otherwise(F.col("source1_entity_id")).alias("source1_entity_id"), F.array_join(m, ",").alias(name), again.alias("_a")).drop("_a")


@query(fx.sql(fx.SCORED_PAIRS, SETS_SQL, FAULTS_SQL, body="""SELECT count(*) AS n_rows, count(*) - count(DISTINCT source1_entity_id) AS repeated_s1, count(*) FILTER (NOT regexp_full_match(source1_entity_id, 'S1-[0-9]+')) AS bad_s1, count(*) FILTER (m IS NULL OR c IS NULL) AS unpaired,
count(*) FILTER (len(list_distinct(m)) < len(m)) AS repeated_t, count(*) FILTER (len(list_filter(m, lambda x: NOT regexp_full_match(x, 'S[23]-[0-9]+'))) > 0) AS bad_t, count(*) FILTER (len(list_filter(m, lambda x: NOT list_contains(c, x))) > 0) AS not_candidates,
sum(len(m))::BIGINT AS n_matches, sum(len(c))::BIGINT AS n_candidates, max(len(m))::BIGINT AS most_matches FROM au"""))
def a14_audit(spark, sf_dir):
    """Structural checks of matches against candidates, on outputs with faults of every kind."""
    s1, pairs = _sets(spark, sf_dir)
    m, c = files.set_output(s1, decide.exclusive(pairs), "p", "matched_entity_ids"), files.set_output(s1, pairs, "p", "candidate_entity_ids")
    return files.audit(_faulty(m, "matched_entity_ids", False), _faulty(c, "candidate_entity_ids", True))


@query(fx.sql(fx.SCORED_PAIRS, SETS_SQL, "x AS (SELECT 'S1-' || s1 AS source1_entity_id, list_sort(list_distinct(list('S2-' || t))) AS m FROM ranked WHERE rt = 1 AND p2 >= 0.5 GROUP BY s1)",
    body="""SELECT source1_entity_id, array_to_string(list_concat(o, list_filter(coalesce(m, []), lambda e: NOT list_contains(o, e))), ',') AS matched_entity_ids
FROM (SELECT source1_entity_id, CASE WHEN matched_entity_ids = '' THEN [] ELSE string_split(matched_entity_ids, ',') END AS o FROM matches) LEFT JOIN x USING (source1_entity_id)"""))
def a13_patch(spark, sf_dir):
    """Links of a lower threshold put at the end of the lists."""
    s1, pairs = _sets(spark, sf_dir)
    return files.patch_sets(files.set_output(s1, decide.exclusive(pairs), "p", "matched_entity_ids"), decide.exclusive(pairs, at=0.5), "matched_entity_ids")


@query(fx.sql(fx.SCORED_PAIRS, SETS_SQL, body="SELECT source1_entity_id, CASE WHEN n_name = 'NATION_1' THEN '' ELSE matched_entity_ids END AS matched_entity_ids FROM matches JOIN customer ON source1_entity_id = 'S1-' || c_custkey JOIN nation ON n_nationkey = c_nationkey"))
def k15_mask_country(spark, sf_dir):
    """One country's rows emptied."""
    s1, pairs = _sets(spark, sf_dir)
    return files.mask_sets(files.set_output(s1, decide.exclusive(pairs), "p", "matched_entity_ids"), fx.party_records(spark, sf_dir), "NATION_1", "matched_entity_ids")


# --- B: ids and samples --------------------------------------------------------------------------------------------------


@query(fx.sql(fx.DOC_RECORDS, body=f"""SELECT id, 'S' || source || '-' || (id % 10000000000) AS text_id, id AS back, ({fx.h_sql(11, 'id')} % 4) AS fold, ({fx.h_sql(11, 'id')} % 4) // 2 AS half,
{fx.h_sql(23, 'id')} % 1000 < 500 AS sub, {fx.h_sql(2024, 'id')} % 1000 < 814 AS keep, {fx.h_sql(99, 'id')} % 100 < 5 AS sample FROM doc_records"""))
def b1_ids_and_samples(spark, sf_dir):
    """Ids in both forms, folds, halves, and samples by hash."""
    d = fx.doc_records(spark, sf_dir).select("id")
    i = F.col("id")
    t = ids.decode(i)
    return d.select("id", t.alias("text_id"), ids.encode(t).alias("back"), ids.fold(i).alias("fold"), F.floor(ids.fold(i) / 2).alias("half"), (ids.sample_hash(i, 23) % 1000 < 500).alias("sub"), ids.kept(i).alias("keep"), (ids.sample_hash(i, 99) % 100 < 5).alias("sample"))


@query(fx.sql(fx.DOC_RECORDS, fx.DOC_TRUTH, body="SELECT s1, t FROM doc_truth"))
def b4_truth_pairs(spark, sf_dir):
    """True pairs from a set-valued table."""
    rec = fx.doc_records(spark, sf_dir)
    sets = fx.doc_truth(rec).groupBy(ids.decode(F.col("s1")).alias("source1_entity_id")).agg(F.array_join(F.collect_list(ids.decode(F.col("t"))), ",").alias("m"))
    return files.set_links(sets, "m")


@query(fx.sql(fx.SCORED_PAIRS, f"""x AS (SELECT s1, t, y, p1, {fx.h_sql(5, '(t * 1000003 + s1)')} AS h FROM scored_pairs),
z AS (SELECT *, row_number() OVER (PARTITION BY s1, y ORDER BY h, t) AS rp, row_number() OVER (PARTITION BY s1, y ORDER BY p1 DESC, t) AS rn FROM x),
q AS (SELECT *, row_number() OVER (PARTITION BY s1, y, rn > 6 ORDER BY h, t) AS rl FROM z)""", body="SELECT s1, t, y::BIGINT AS y FROM q WHERE CASE WHEN y = 1 THEN rp <= 4 ELSE rn <= 6 OR rl = 1 END"))
def b12_hard_negatives(spark, sf_dir):
    """True pairs, the hardest false ones and a random one of each query."""
    from ..plans.scorers import training_pairs

    return training_pairs(fx.scored_pairs(spark, sf_dir))


# --- C: normal forms -----------------------------------------------------------------------------------------------------


@query(fx.sql(*DOCS, body="SELECT id, nf, array_to_string(nt, ' ') AS nt, array_to_string(core, ' ') AS core, al_pre, al_post FROM prepared"))
def c1_name_forms(spark, sf_dir):
    """Folded names, tokens, core tokens and aliases of whole first lines."""
    return text.prepared(fx.doc_records(spark, sf_dir)).select("id", "nf", "nt", "core", "al_pre", "al_post")


@query(fx.sql(*DOCS, body='''SELECT id, array_to_string("at", ' ') AS "at", array_to_string(acore, ' ') AS acore, ncomp FROM prepared'''))
def c11_address_forms(spark, sf_dir):
    """Address components, tokens and core tokens of the whole rest of the texts."""
    return text.prepared(fx.doc_records(spark, sf_dir)).select("id", "at", "acore", "ncomp")


@query(rf"""SELECT doc_id, regexp_matches(coalesce(text, ''), '[ऀ-෿]') AS indic, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(replace(lower(coalesce(text, '')), '.', ''), '[a-z]+'),
lambda t: t IN {among(vocab.LEGAL_FORMS)}), lambda t: {sql_map(vocab.LEGAL_FORMS)}[t]))), ',') AS lf FROM documents""")
def c24_legal_forms(spark, sf_dir):
    """Native script and the set of legal forms of whole texts."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.has_indic(F.col("text")).alias("indic"), text.legal_forms(F.col("text")).alias("lf"))


WRITTEN = sql_map(text.WRITTEN)
BY_RULE = f"""list_aggregate(list_transform(string_split(regexp_replace(regexp_replace(translate(@, '{text.BLOCKS}', '{text.DEVANAGARI}'), '({text.CONSONANT_CLASS})([^{text.SIGNS}])', '\\1a\\2', 'g'), '({text.CONSONANT_CLASS})([^a{text.SIGNS}])', '\\1a\\2', 'g'), ''),
  lambda c: coalesce({WRITTEN}[c], CASE WHEN ascii(c) < 128 THEN c ELSE '' END)), 'string_agg', '')"""
ROMAN_SQL = f"""nw AS (SELECT id, unnest(regexp_split_to_array(trim(name), '\\s+')) AS w, unnest(range(len(regexp_split_to_array(trim(name), '\\s+')))) AS pos FROM native WHERE regexp_matches(name, '{text.INDIC}')),
nl AS (SELECT id, string_agg(CASE WHEN regexp_matches(w, '{text.INDIC}') THEN coalesce(latin, {BY_RULE.replace('@', 'w')}) ELSE w END, ' ' ORDER BY pos) AS x, count(*) FILTER (regexp_matches(w, '{text.INDIC}') AND latin IS NULL) AS oov FROM nw LEFT JOIN words ON word = w GROUP BY id),
np AS (SELECT id, trim(trim(unnest(string_split(address, ','))), '"') AS w, unnest(range(len(string_split(address, ',')))) AS pos FROM native WHERE regexp_matches(address, '{text.INDIC}')),
al AS (SELECT id, string_agg(coalesce(latin, w), ', ' ORDER BY pos) AS y FROM np LEFT JOIN parts ON word = w GROUP BY id),
roman AS (SELECT id, source, country, coalesce(x, name) AS name, coalesce(y, address) AS address, coalesce(oov, 0) AS oov FROM native LEFT JOIN nl USING (id) LEFT JOIN al USING (id))"""


@query(fx.sql(fx.NATIVE_SQL, ROMAN_SQL, body="SELECT id, name AS name_latin, address AS address_latin, oov FROM roman"))
def c2_romanised(spark, sf_dir):
    """Names and addresses of native scripts by dictionary and by rule, over literal records: the tables have none."""
    return text.romanised(*fx.native_records(spark)).select("id", "name_latin", "address_latin", "oov")


@query(fx.sql(fx.NATIVE_SQL, ROMAN_SQL, prepared_sql("roman"), body='SELECT id, array_to_string(nt, \' \') AS nt, array_to_string("at", \' \') AS "at", array_to_string(acore, \' \') AS acore, ncomp, oov FROM prepared'))
def c3_native_forms(spark, sf_dir):
    """C2, C3, C11 in the token views that blocking and features read, over literal records."""
    rec, words, parts = fx.native_records(spark)
    return text.prepared(rec, names=words, components=parts).select("id", "nt", "at", "acore", "ncomp", "oov")


VOTES_SQL = "vo AS (SELECT word, latin, count(*) AS votes FROM al GROUP BY ALL), vr AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY votes DESC, latin) AS k FROM vo)"


@query(fx.sql(*DOCS, fx.DOC_TRUTH, """al AS (SELECT unnest(b.nt) AS word, unnest(a.nt) AS latin FROM doc_truth JOIN prepared a ON a.id = s1 JOIN prepared b ON b.id = t WHERE len(a.nt) = len(b.nt))""", VOTES_SQL, body="SELECT word, latin, votes FROM vr WHERE k = 1"))
def c20_learned_dictionary(spark, sf_dir):
    """C20: words of targets' names voted to the words they are paired with, over all names."""
    from ..plans.dictionary import learn_words

    rec = storage.written(text.prepared(fx.doc_records(spark, sf_dir)).select("id", F.col("nt").alias("w")))
    truth = fx.doc_truth(fx.doc_records(spark, sf_dir))
    pairs = truth.join(rec.select(F.col("id").alias("s1"), F.col("w").alias("latin")), "s1").join(rec.select(F.col("id").alias("t"), F.col("w").alias("native")), "t")
    return learn_words(pairs, native_only=False)


@query(fx.sql(fx.NATIVE_SQL, f"""tp AS (SELECT a.address AS l, b.address AS n FROM native a JOIN native b ON a.source = 1 AND b.source = 2 AND a.id % 10000000000 = b.id % 10000000000),
al0 AS (SELECT unnest(list_transform(string_split(n, ','), lambda x: trim(trim(x), '"'))) AS word, list_transform(string_split(l, ','), lambda x: lower(trim(x))) AS ls FROM tp),
al1 AS (SELECT word, unnest(ls) AS latin FROM al0), al AS (SELECT * FROM al1 WHERE regexp_matches(word, '{text.INDIC}') AND NOT regexp_matches(latin, '{text.INDIC}'))""", VOTES_SQL, body="SELECT word, latin, votes FROM vr WHERE k = 1"))
def c21_learned_components(spark, sf_dir):
    """Native parts of addresses voted to the parts of the paired addresses, over literal records."""
    from ..plans.dictionary import learn_components

    rec, _, _ = fx.native_records(spark)
    parts = lambda f: F.transform(F.split("address", ","), lambda c: f(F.regexp_replace(F.trim(c), '^"+|"+$', "")))
    a = rec.where("source = 1").select((F.col("id") % 10_000_000_000).alias("k"), parts(F.lower).alias("latin"))
    b = rec.where("source = 2").select((F.col("id") % 10_000_000_000).alias("k"), parts(lambda c: c).alias("native"))
    return learn_components(a.join(b, "k"))


@query(fx.sql(fx.DOC_RECORDS, body="SELECT id, 'name: ' || name || ' ; address: ' || CASE WHEN trim(coalesce(address, '')) = '' THEN '[none]' ELSE address END AS line FROM doc_records"))
def c27_serialised(spark, sf_dir):
    """Records as lines for a pair scorer."""
    return fx.doc_records(spark, sf_dir).select("id", text.serialised(F.col("name"), F.col("address")).alias("line"))


@query()
def c22_extended_profile(spark, sf_dir):
    """The extended profile for one country, the base one for the others."""
    rec = fx.doc_records(spark, sf_dir)
    cols = ["id", "country", "nt", "core", "acore"]
    return text.prepared(rec.where("country = 'fr'"), text.EXTENDED).select(*cols).unionByName(text.prepared(rec.where("country <> 'fr' OR country IS NULL")).select(*cols))


FOLDED = "lower(regexp_replace(strip_accents(nfc_normalize(coalesce(text, ''))), '[^\\x00-\\x7F]', '', 'g'))"


@query(fx.sql(f"seg AS (SELECT doc_id, list_filter(string_split(regexp_replace({FOLDED}, '[^a-z0-9 ,]', ' ', 'g'), ','), lambda x: regexp_matches(x, '[0-9]'))[1] AS seg FROM documents)",
    body=f"SELECT doc_id, coalesce(array_to_string(list_filter(regexp_split_to_array(trim(seg), ' +'), lambda w: length(w) >= 3 AND w NOT IN {among(vocab.STREET_STOP)} AND NOT regexp_full_match(w, '[0-9]+[0-9a-z_]*')), ' '), '') AS words FROM seg"))
def c26_street_words(spark, sf_dir):
    """Street words of addresses."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.street_words(F.col("text")).alias("words"))


# --- D: blocking ---------------------------------------------------------------------------------------------------------

BASE_SQL = f"""b0 AS (SELECT *, list_filter(nt, lambda t: t NOT IN {among(vocab.LEGAL | vocab.HONOR | vocab.BLOCK_STOP)}) AS b FROM prepared),
base AS MATERIALIZED (SELECT id, source, country, nt, core, acore, CASE WHEN len(b) > 0 THEN b ELSE nt END AS bt, CASE WHEN len(core) > 0 THEN core ELSE nt END AS ntok, len(list_filter(acore, lambda t: length(t) >= 3)) = 0 AS noaddr FROM b0),
dfs AS MATERIALIZED (SELECT country, kind, t, count(*) AS df FROM (SELECT country, 'n' AS kind, unnest(list_distinct(bt)) AS t FROM base WHERE source > 1 UNION ALL SELECT country, 'a', unnest(list_distinct(acore)) FROM base WHERE source > 1) GROUP BY ALL)"""
RARE_SQL = """r0 AS (SELECT id, source, country, 'n' AS kind, unnest(list_distinct(bt)) AS t FROM base UNION ALL SELECT id, source, country, 'a', unnest(list_distinct(acore)) FROM base),
r1 AS (SELECT id, source, country, CASE WHEN kind = 'a' AND regexp_full_match(t, '[0-9]+') THEN 'h' ELSE kind END AS kind, kind AS dk, t FROM r0),
r2 AS (SELECT r1.*, coalesce(df, 0) AS df FROM r1 LEFT JOIN dfs ON dfs.country = r1.country AND dfs.kind = r1.dk AND dfs.t = r1.t WHERE CASE r1.kind WHEN 'n' THEN length(r1.t) >= 2 WHEN 'a' THEN length(r1.t) >= 3 ELSE r1.t <> '0' END),
r3 AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY df, t) AS r FROM r2),
rare AS MATERIALIZED (SELECT id, source, country, kind, t FROM r3 WHERE r <= CASE kind WHEN 'n' THEN 4 WHEN 'a' THEN CASE source WHEN 1 THEN 7 ELSE 5 END ELSE CASE source WHEN 1 THEN 3 ELSE 2 END END)"""
KEYS_SQL = """n AS (SELECT * FROM rare WHERE kind = 'n'), a AS (SELECT * FROM rare WHERE kind = 'a'), hh AS (SELECT * FROM rare WHERE kind = 'h'),
k0 AS (SELECT n.id, 0 AS ty, 'N1' || n.t AS k FROM n JOIN base USING (id) WHERE n.source = 1 OR noaddr
UNION ALL SELECT x.id, 1, 'AA' || x.t || '|' || z.t FROM a x JOIN a z ON x.id = z.id AND x.t < z.t
UNION ALL SELECT x.id, 2, 'NP' || x.t[1:4] || '|' || z.t[1:4] FROM n x JOIN n z ON x.id = z.id AND x.t < z.t
UNION ALL SELECT x.id, 3, 'NA' || x.t || '|' || z.t FROM n x JOIN a z ON x.id = z.id
UNION ALL SELECT x.id, 4, 'NN' || x.t || '|' || z.t FROM n x JOIN n z ON x.id = z.id AND x.t < z.t
UNION ALL SELECT x.id, 5, 'HA' || x.t || '|' || z.t FROM hh x JOIN a z ON x.id = z.id
UNION ALL SELECT x.id, 6, 'NH' || x.t || '|' || z.t FROM n x JOIN hh z ON x.id = z.id
UNION ALL SELECT id, 7, 'C' || array_to_string(ntok, '') FROM base UNION ALL SELECT id, 7, 'C' || array_to_string(nt, '') FROM base),
keys AS MATERIALIZED (SELECT k0.id, base.source, base.country, k, min(ty) AS ty FROM k0 JOIN base USING (id) GROUP BY ALL)"""
PAIRS_SQL = """nt_ AS (SELECT count(*) AS n FROM base WHERE source > 1),
wk AS (SELECT country, k, count(*) AS df, ln((SELECT n FROM nt_)) - ln(count(*)) AS w FROM keys WHERE source > 1 GROUP BY country, k HAVING count(*) <= 300),
pairs AS MATERIALIZED (SELECT q.id AS s1, t.id AS t, sum(w) AS bscore, count(*) AS nkeys, max(w) AS wmax, """ + ", ".join(f"coalesce(sum(w) FILTER (q.ty = {i}), 0) AS w{i}" for i in range(8)) + """
  FROM keys q JOIN keys t ON q.source = 1 AND t.source > 1 AND q.country = t.country AND q.k = t.k JOIN wk ON wk.country = q.country AND wk.k = q.k GROUP BY q.id, t.id),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(bscore, 9) DESC, t) AS brank, count(*) OVER (PARTITION BY s1) AS npool, bscore / max(bscore) OVER (PARTITION BY s1) AS brel FROM pairs),
topk AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY t) AS t_ns1, max(bscore) OVER (PARTITION BY t) AS t_best, row_number() OVER (PARTITION BY t ORDER BY round(bscore, 9) DESC, s1) AS t_rank FROM ranked WHERE brank <= 30)"""


def _view(spark, sf_dir, records=fx.doc_records):
    return storage.written(blocking.base_view(text.prepared(records(spark, sf_dir))))


@query(fx.sql(*DOCS, BASE_SQL, body="SELECT country, kind, t, df FROM dfs"))
def d2_token_df(spark, sf_dir):
    """Document frequency of targets' tokens by country."""
    return blocking.token_df(_view(spark, sf_dir).where("source > 1"))


@query(fx.sql(*DOCS, BASE_SQL, RARE_SQL, body="SELECT id, country, kind, t FROM rare"))
def d3_rarest_tokens(spark, sf_dir):
    """D3: the rarest tokens of each record."""
    v = _view(spark, sf_dir)
    rare = blocking.rarest_tokens(v, blocking.token_df(v.where("source > 1")))
    kind = lambda k: F.transform(k, lambda t: F.struct(F.lit(k).alias("kind"), t.alias("t")))
    return rare.select("id", "country", F.inline(F.concat(*map(kind, "nah"))))


@query(fx.sql(*DOCS, BASE_SQL, RARE_SQL, KEYS_SQL, body="SELECT id, country, k, ty::BIGINT AS ty FROM keys"))
def d4_keys(spark, sf_dir):
    """Compound keys of each record."""
    v = _view(spark, sf_dir)
    return blocking.keys(v, blocking.token_df(v.where("source > 1"))).select("id", "country", "k", "ty")


@query(fx.sql(*DOCS, BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL, body=f"SELECT s1, t, nkeys, brank, npool, t_ns1, t_rank, {', '.join(f'{r(c)} AS {c}' for c in ['bscore', 'wmax', 'brel', 't_best', *[f'w{i}' for i in range(8)]])} FROM topk"))
def d14_block(spark, sf_dir):
    """Capped, weighted keys joined to candidate pairs, ranked by rarity, cut to the best 30, and their competition."""
    cols = ["s1", "t", "nkeys", "brank", "npool", "t_ns1", "t_rank", "bscore", "wmax", "brel", "t_best", *[f"w{i}" for i in range(8)]]
    return blocking.block(text.prepared(fx.doc_records(spark, sf_dir))).select(*cols)


RS = "bscore / nkeys + 0.5 * noaddr + 0.1 * w3 - 0.01 * brank + brel"
RANKER_SQL = f"""rs0 AS (SELECT r.*, b.noaddr::INT AS noaddr FROM ranked r JOIN base b ON b.id = r.t), rs1 AS (SELECT *, {RS} AS rs FROM rs0),
rs2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(rs, 9) DESC, t) AS rrank FROM rs1),
cut AS (SELECT s1, t, noaddr, rs, rrank, count(*) OVER (PARTITION BY t) AS t_ns1, max(rs) OVER (PARTITION BY t) AS t_best, row_number() OVER (PARTITION BY t ORDER BY round(rs, 9) DESC, s1) AS t_rank,
  max(bscore) OVER (PARTITION BY t) AS t_bbest, row_number() OVER (PARTITION BY t ORDER BY round(bscore, 9) DESC, s1) AS t_brank FROM rs2 WHERE rrank <= 5)"""


@query(fx.sql(*PARTS, BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL, RANKER_SQL, body=f"SELECT s1, t, noaddr, rrank, t_ns1, t_rank, t_brank, {r('rs')} AS rs, {r('t_best')} AS t_best, {r('t_bbest')} AS t_bbest FROM cut"))
def d16_ranked_block(spark, sf_dir):
    """A pool scored by a ranker (a fixed formula here, so that SQL can follow), cut by its rank, and both competitions."""
    out = blocking.block(text.prepared(fx.part_records(spark, sf_dir)), k=5, ranker=lambda pool: pool.withColumn("rs", F.expr(RS)))
    return out.select("s1", "t", "noaddr", "rrank", "t_ns1", "t_rank", "t_brank", "rs", "t_best", "t_bbest")


@query(fx.sql(*PARTS, BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL, body=f"SELECT s1, t, {r('bscore')} AS bscore, brank, npool FROM ranked WHERE {fx.h_sql(99, 's1')} % 100 < 5"))
def d20_raw_pool(spark, sf_dir):
    """The uncut pool of a 5 % sample of queries, which a ranker is trained on."""
    return blocking.raw_pool(text.prepared(fx.part_records(spark, sf_dir)), ids.sample_hash(F.col("id"), 99) % 100 < 5).select("s1", "t", "bscore", "brank", "npool")


@query()
def d21_ranker(spark, sf_dir):
    """Trees trained on the sample's pool, and the candidates they keep."""
    from ..plans import ranker

    rec = fx.part_records(spark, sf_dir)
    p = storage.written(text.prepared(rec))
    model = ranker.fit_ranker(storage.written(ranker.training_pool(p, fx.part_truth(rec), 500)), rounds=5, depth=4)
    return blocking.block(p, ranker=ranker.ranker(model)).select("s1", "t", "rs", "rrank", "t_rank", "t_brank")


@query(fx.sql(*[x.replace("part_records)", "kept_records)") if x.startswith("p1 AS") else x for x in (fx.PART_RECORDS, f"kept_records AS (SELECT * FROM part_records WHERE source > 1 OR {fx.h_sql(2024, 'id')} % 1000 < 814)", prepared_sql("kept_records"))], BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL, body="SELECT s1, t, brank, t_ns1, t_rank FROM topk"))
def d22_kept_queries(spark, sf_dir):
    """Blocking of the queries of a keep list."""
    rec = fx.part_records(spark, sf_dir)
    keep = rec.where("source = 1").where(ids.kept(F.col("id"))).select("id")
    return blocking.block(text.prepared(rec), keep=keep).select("s1", "t", "brank", "t_ns1", "t_rank")


HN_SQL = "hn AS (SELECT *, list_filter(acore, lambda t: regexp_full_match(t, '[0-9]+'))[1] AS hn, list_distinct(list_filter(acore, lambda t: NOT regexp_full_match(t, '[0-9]+'))) AS w FROM base)"


@query(fx.sql(*PARTS, BASE_SQL, HN_SQL, """x AS (SELECT id, source, country, hn, unnest(w) AS w FROM hn WHERE hn IS NOT NULL),
few AS (SELECT country, hn, w FROM x WHERE source > 1 GROUP BY ALL HAVING count(*) <= 15)""", RARE_SQL, KEYS_SQL, PAIRS_SQL, body="SELECT a.id AS s1, b.id AS t, count(*) AS n_shared FROM x a JOIN x b ON a.source = 1 AND b.source > 1 AND a.country = b.country AND a.hn = b.hn AND a.w = b.w JOIN few ON few.country = a.country AND few.hn = a.hn AND few.w = a.w WHERE (a.id, b.id) NOT IN (SELECT (s1, t) FROM topk WHERE brank <= 3) GROUP BY a.id, b.id"))
def d25_rare_address(spark, sf_dir):
    """Pairs of equal country and number that share a rare address word and aren't among the first three candidates."""
    return blocking.rare_address_pairs(_view(spark, sf_dir, fx.part_records), part_pairs(spark, sf_dir).where("brank <= 3"))


@query(fx.sql(*PARTS, BASE_SQL, HN_SQL, body=f"""SELECT a.id AS s1, b.id AS t, {r('len(list_intersect(a.w, b.w)) / greatest(len(a.w), 1)')} AS overlap FROM hn a JOIN hn b ON a.source = 1 AND b.source > 1 AND a.country = b.country AND a.hn = b.hn
AND array_to_string(a.ntok, '') = array_to_string(b.ntok, '') WHERE len(list_intersect(a.w, b.w)) / greatest(len(a.w), 1) >= 0.5"""))
def d26_same_name_number(spark, sf_dir):
    """Pairs of equal core name and number whose address words overlap."""
    return blocking.same_name_number_pairs(_view(spark, sf_dir, fx.part_records))


# --- E: attributes ---------------------------------------------------------------------------------------------------------


@query(fx.sql(*PARTS, VIEW_SQL, """a0 AS (SELECT id, source, country, cc, CASE WHEN len(acore) > 0 THEN acs END AS acs, coalesce(nums[1], '') AS hn, CASE WHEN len(nums) > 0 THEN array_to_string(list_sort(nums), ' ') END AS nums_k FROM view_)""",
    body="""SELECT id, country, cc, acs, hn, nums_k, count(*) FILTER (source = 1) OVER (PARTITION BY country, cc) AS cc_fs1, count(*) FILTER (source > 1) OVER (PARTITION BY country, cc) AS cc_ft,
CASE WHEN acs IS NULL THEN 0 ELSE count(*) FILTER (source = 1) OVER (PARTITION BY country, acs) END AS acs_fs1, CASE WHEN acs IS NULL THEN 0 ELSE count(*) FILTER (source > 1) OVER (PARTITION BY country, acs) END AS acs_ft FROM a0"""))
def e1_record_attrs(spark, sf_dir):
    """Comparable keys of records and their frequencies."""
    return attrs.record_attrs(attrs.record_view(text.prepared(fx.part_records(spark, sf_dir))))


@query(fx.sql(*DOCS, VIEW_SQL, body="SELECT id, ns, cs, cc, nc, as_ AS \"as\", acs, array_to_string(nums, ' ') AS nums, ind, aempty, dom FROM view_"))
def e4_record_view(spark, sf_dir):
    """Joined token views and flags."""
    return attrs.record_view(text.prepared(fx.doc_records(spark, sf_dir))).select("id", "ns", "cs", "cc", "nc", "as", "acs", "nums", "ind", "aempty", "dom")


@query(fx.sql(*DOCS, f"x AS (SELECT unnest(list_distinct(nt)) AS t FROM prepared WHERE source > 1), n AS (SELECT count(*) AS n FROM prepared WHERE source > 1)", body=f"SELECT t, count(*) AS df, {r('ln(any_value(n) / count(*))')} AS idf FROM x, n GROUP BY t"))
def e5_idf(spark, sf_dir):
    """E5: rarity of name words over all targets."""
    return attrs.idf(attrs.record_view(text.prepared(fx.doc_records(spark, sf_dir))), "nt")


# --- F: pair features --------------------------------------------------------------------------------------------------------

PAIR_SQL = ",\n".join([BASE_SQL, RARE_SQL, KEYS_SQL, PAIRS_SQL, "pp AS MATERIALIZED (SELECT s1, t FROM topk)"])


def part_pairs(spark, sf_dir):
    """Candidate pairs of the part records: keys are capped, and each query has 30 at most."""
    return blocking.block(text.prepared(fx.part_records(spark, sf_dir)))


def _pairs(spark, sf_dir):
    return part_pairs(spark, sf_dir).select("s1", "t"), storage.written(attrs.record_view(text.prepared(fx.part_records(spark, sf_dir))))


@query()
def f1_string_scores(spark, sf_dir):
    """Similarities of joined token views (of scorers that SQL lacks)."""
    pairs, v = _pairs(spark, sf_dir)
    p = features.string_features(features.with_records(pairs, v))
    return p.select("s1", "t", *[c for c in p.columns if c.rsplit("_", 1)[-1] in ("ratio", "tset", "tsort", "part", "jw", "best")])


@query(fx.sql(*PARTS, VIEW_SQL, PAIR_SQL, body=f"SELECT s1, t, {r('jaro_winkler_similarity(a.cs, b.cs)')} AS cs_jw, {r('jaro_winkler_similarity(a.cc, b.cc)')} AS cc_jw, levenshtein(a.cs, b.cs) AS lev FROM pp JOIN view_ a ON a.id = s1 JOIN view_ b ON b.id = t"))
def f5_jaro_winkler(spark, sf_dir):
    """Jaro-Winkler similarities of candidate pairs' core names."""
    pairs, v = _pairs(spark, sf_dir)
    p = features.with_records(pairs, v)
    two = strings.scores({f"{c}_jw": ("jw", F.col(f"{c}_1"), F.col(f"{c}_2")) for c in ("cs", "cc")})
    return p.select("s1", "t", two.alias("x"), F.levenshtein("cs_1", "cs_2").alias("lev")).select("s1", "t", "x.cs_jw", "x.cc_jw", "lev")


@query("""WITH b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS b, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark),
d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS d FROM documents)
SELECT doc_id, item_id FROM d JOIN b ON contains(d, ' ' || b || ' ') WHERE len(w) >= 8""")
def f6_contamination(spark, sf_dir):
    """benchmark passages of eight words or more that stand whole in a document."""
    b, d = fx.table(spark, sf_dir, "benchmark"), fx.table(spark, sf_dir, "documents")
    return features.contained_passages(d, b)


@query(fx.sql(*PARTS, VIEW_SQL, PAIR_SQL, body="""SELECT s1, t, (length(a.cc) > 3 AND contains(b.nc, a.cc))::BIGINT AS cc_in_t, (a.cc = b.cc)::BIGINT AS cc_eq, coalesce((a.core[1] = b.core[1])::BIGINT, 0) AS first_eq,
(coalesce(b.al_pre, '') <> '' OR coalesce(b.al_post, '') <> '')::BIGINT AS has_alias, ((t // 10000000000) = 3)::BIGINT AS is_s3, length(a.ns) AS len_ns1, length(b.ns) AS len_ns2, length(b.as_) AS len_as2, (a.country = b.country)::BIGINT AS same_country,
b.dom::BIGINT AS dom_2, b.aempty::BIGINT AS aempty_2 FROM pp JOIN view_ a ON a.id = s1 JOIN view_ b ON b.id = t"""))
def f6_containment_flags(spark, sf_dir):
    """Containment, first words, aliases and flags."""
    pairs, v = _pairs(spark, sf_dir)
    p = features.flags(features.containment(features.with_records(pairs, v)))
    return p.select("s1", "t", "cc_in_t", "cc_eq", "first_eq", "has_alias", "is_s3", "len_ns1", "len_ns2", "len_as2", "same_country", "dom_2", "aempty_2")


F7_SETS = {"core": ("a.core", "b.core", "wn"), "nt": ("a.nt", "b.nt", "wn"), "addr": ("list_filter(a.acore, lambda t: NOT regexp_full_match(t, '[0-9]+'))", "list_filter(b.acore, lambda t: NOT regexp_full_match(t, '[0-9]+'))", "wa")}
IDF_SQL = """nn AS (SELECT count(*) AS n FROM view_ WHERE source > 1), wn AS MATERIALIZED (SELECT w, ln(any_value(n) / count(*)) AS x FROM (SELECT unnest(list_distinct(nt)) AS w FROM view_ WHERE source > 1), nn GROUP BY w),
wa AS MATERIALIZED (SELECT w, ln(any_value(n) / count(*)) AS x FROM (SELECT unnest(list_distinct("at")) AS w FROM view_ WHERE source > 1), nn GROUP BY w)"""
F7_COLS = ("jac", "ninter", "nA", "nB", "covA", "covB", "unA", "unB", "nfuzzy", "maxunB")


def _f7_sql(k: str) -> str:
    a, b, w = F7_SETS[k]
    return f"""{k}_q AS MATERIALIZED (SELECT s1, t, list_distinct({a}) AS A, list_distinct({b}) AS B FROM pp JOIN view_ a ON a.id = s1 JOIN view_ b ON b.id = t),
{k}_e AS (SELECT s1, t, A, B, unnest(list_distinct(list_concat(A, B))) AS w FROM {k}_q),
{k}_m AS (SELECT s1, t, e.w, list_contains(A, e.w) AS ia, list_contains(B, e.w) AS ib, coalesce(x, ln(n)) AS x, NOT list_contains(B, e.w) AND len(list_filter(B, lambda o: NOT list_contains(A, o) AND jaro_winkler_similarity(o, e.w) >= 0.88)) > 0 AS near FROM {k}_e e LEFT JOIN {w} USING (w), nn),
{k}_g AS (SELECT s1, t, count(*) FILTER (ia AND ib) AS ninter, count(*) FILTER (ia) AS na, count(*) FILTER (ib) AS nb, count(*) AS nu, coalesce(sum(x) FILTER (ia), 0) AS wa, coalesce(sum(x) FILTER (ib), 0) AS wb, coalesce(sum(x) FILTER (ia AND ib), 0) AS wi,
  coalesce(sum(x) FILTER (ia AND near), 0) AS fa, count(*) FILTER (ia AND near) AS nf, max(x) FILTER (ib AND NOT ia) AS mx FROM {k}_m GROUP BY s1, t),
{k}_f AS (SELECT s1, t, {r('coalesce(ninter / greatest(nu, 1), 0)')} AS {k}_jac, {r('coalesce(ninter, 0)::DOUBLE')} AS {k}_ninter, {r('coalesce(na, 0)::DOUBLE')} AS {k}_nA, {r('coalesce(nb, 0)::DOUBLE')} AS {k}_nB, {r('coalesce(wi / greatest(wa, 1e-9), 0)')} AS {k}_covA, {r('coalesce(wi / greatest(wb, 1e-9), 0)')} AS {k}_covB,
  {r('coalesce(greatest(wa - wi - fa, 0), 0)')} AS {k}_unA, {r('coalesce(greatest(wb - wi - fa, 0), 0)')} AS {k}_unB, {r('coalesce(nf, 0)::DOUBLE')} AS {k}_nfuzzy, {r('coalesce(mx, 0)')} AS {k}_maxunB FROM {k}_q LEFT JOIN {k}_g USING (s1, t))"""


@query(fx.sql(*PARTS, VIEW_SQL, PAIR_SQL, IDF_SQL, *map(_f7_sql, F7_SETS), body=f"SELECT s1, t, {', '.join(f'{k}_{c}' for k in F7_SETS for c in F7_COLS)} FROM core_f JOIN nt_f USING (s1, t) JOIN addr_f USING (s1, t)"))
def f7_set_features(spark, sf_dir):
    """Weighted overlap of core name words, of all name words and of address words, leftovers aligned by Jaro-Winkler."""
    pairs, v = _pairs(spark, sf_dir)
    p = features.with_records(pairs, storage.written(attrs.weighed(v, v.where("source > 1").count())))
    words = lambda c: F.filter(c, lambda x: ~x.rlike("^[0-9]+$"))
    return features.set_features(p.withColumns({"aw_1": words("acore_1"), "aw_2": words("acore_2")})).select("s1", "t", *[f"{k}_{c}" for k in F7_SETS for c in F7_COLS])


REL_SQL = """CASE WHEN x = y THEN 0 WHEN length(y) < length(x) AND suffix(x, y) THEN 1 WHEN length(y) < length(x) AND prefix(x, y) THEN 2 WHEN length(y) > length(x) AND suffix(y, x) THEN 3 WHEN length(y) > length(x) AND prefix(y, x) THEN 4
 WHEN length(x) = length(y) AND hamming(x, y) = 1 THEN CASE WHEN d < 10 THEN 5 ELSE 6 END WHEN d <= 20 THEN 7 ELSE 8 END"""


@query(fx.sql(fx.PARTY_RECORDS, f"""v AS (SELECT id, source, coalesce(nullif(ltrim(name[-9:], '0'), ''), '0') AS h FROM party_records),
pp AS (SELECT DISTINCT {ids.BASE} + o_custkey AS s1, {2 * ids.BASE} + l_suppkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
q AS (SELECT s1, t, a.h AS x, b.h AS y, abs(a.h::BIGINT - b.h::BIGINT) AS d FROM pp JOIN v a ON a.id = s1 JOIN v b ON b.id = t)""",
    body=f"SELECT s1, t, CASE WHEN length(x) = length(y) THEN ({REL_SQL}) ELSE ({REL_SQL.replace('hamming(x, y)', '9')}) END::BIGINT AS hn_rel, {r('ln(1 + d)')} AS hn_logd FROM q"))
def f9_number_relations(spark, sf_dir):
    """How the numbers of customers and of the suppliers they ordered from relate."""
    number = F.array(F.coalesce(F.nullif(F.ltrim(F.substring("name", -9, 9), F.lit("0")), F.lit("")), F.lit("0")))
    v = fx.party_records(spark, sf_dir).select("id", number.alias("nums"))
    o, li = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "lineitem")
    pairs = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select((F.lit(ids.BASE) + F.col("o_custkey")).alias("s1"), (F.lit(2 * ids.BASE) + F.col("l_suppkey")).alias("t")).distinct()
    p = pairs.join(v.select(F.col("id").alias("s1"), F.col("nums").alias("nums_1")), "s1").join(v.select(F.col("id").alias("t"), F.col("nums").alias("nums_2")), "t")
    return features.number_features(p).select("s1", "t", F.col("hn_rel").cast("long").alias("hn_rel"), "hn_logd")


@query(fx.sql(*PARTS, VIEW_SQL, PAIR_SQL, "q AS (SELECT s1, t, a.nums AS A, b.nums AS B, len(a.nums) AS na, len(b.nums) AS nb FROM pp JOIN view_ a ON a.id = s1 JOIN view_ b ON b.id = t)",
    body="SELECT s1, t, " + ", ".join(f"(CASE WHEN na < 1 OR nb < 1 THEN -1.0 ELSE {v} END)::DOUBLE AS {k}" for k, v in {"hn_eq": "(A[1] = B[1])::INT", "hn_any": "list_contains(B, A[1])::INT", "hn_sub": "(contains(B[1], A[1]) OR contains(A[1], B[1]))::INT", "num_last_eq": "(A[-1] = B[-1])::INT", "num_jac": "len(list_intersect(A, B)) / len(list_distinct(list_concat(A, B)))", "t_hn_in_s1": "list_contains(A, B[1])::INT", "nums_unB": "len(list_filter(list_distinct(B), lambda e: NOT list_contains(A, e)))", "nums_unA": "len(list_filter(list_distinct(A), lambda e: NOT list_contains(B, e)))"}.items()) + ", na AS n_nums1, nb AS n_nums2 FROM q"))
def f8_number_features(spark, sf_dir):
    """Numbers of both sides."""
    pairs, v = _pairs(spark, sf_dir)
    return features.number_features(features.with_records(pairs, v)).select("s1", "t", "hn_eq", "hn_any", "hn_sub", "num_last_eq", "num_jac", "t_hn_in_s1", "nums_unB", "nums_unA", "n_nums1", "n_nums2")


@query(fx.sql(*PARTS, VIEW_SQL, PAIR_SQL, "q AS (SELECT s1, t, list_filter(list_distinct(a.nt), lambda e: NOT list_contains(b.nt, e)) AS ra, list_filter(list_distinct(b.nt), lambda e: NOT list_contains(a.nt, e)) AS rb FROM pp JOIN view_ a ON a.id = s1 JOIN view_ b ON b.id = t)",
    body="SELECT s1, t, len(list_filter(ra, lambda e: length(e) <= 3)) AS short_unA, len(list_filter(rb, lambda e: length(e) <= 3)) AS short_unB, len(list_filter(rb, lambda e: len(list_filter(ra, lambda o: levenshtein(o, e) <= 1)) > 0)) AS un_lev1 FROM q"))
def f11_short_leftovers(spark, sf_dir):
    """short and nearly matched leftovers."""
    pairs, v = _pairs(spark, sf_dir)
    return features.short_leftovers(features.with_records(pairs, v)).select("s1", "t", "short_unA", "short_unB", "un_lev1")
