"""How the driver's tables stand in for the records, pairs and scores of a linkage job, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BILLION10 = 10_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h(seed: int, *parts: Column) -> Column:
    """A whole number below 2^32 that any engine computes alike: the first 8 hex digits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def h_sql(seed: int, *parts: str) -> str:
    return "('0x' || substr(md5('" + str(seed) + ":' || " + " || ':' || ".join(f"{p}::VARCHAR" for p in parts) + "), 1, 8))::BIGINT"


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of three sources: the first line is the name, the others the address, the language the country."""
    d = table(spark, sf_dir, "documents")
    src = F.lit(1) + F.col("doc_id") % 3
    text = F.coalesce("text", F.lit(""))
    return d.select(
        (src * BILLION10 + F.col("doc_id")).alias("id"), src.cast("int").alias("source"), F.col("lang").alias("country"),
        F.substring_index(text, "\n", 1).alias("name"), F.regexp_replace(text, "^[^\n]*\n?", "").alias("address"),
    )


DOC_RECORDS = f"""doc_records AS (SELECT (1 + doc_id % 3) * {BILLION10} + doc_id AS id, (1 + doc_id % 3)::INTEGER AS source, lang AS country,
  string_split(coalesce(text, ''), chr(10))[1] AS name, regexp_replace(coalesce(text, ''), '^[^\\n]*\\n?', '') AS address FROM documents)"""


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records: size and brand are the address, the type the country."""
    src = F.lit(1) + F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select(
        (src * BILLION10 + F.col("p_partkey")).alias("id"), src.cast("int").alias("source"), F.col("p_type").alias("country"),
        F.col("p_name").alias("name"), F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand").alias("address"),
    )


PART_RECORDS = f"""part_records AS (SELECT (1 + p_partkey % 3) * {BILLION10} + p_partkey AS id, (1 + p_partkey % 3)::INTEGER AS source, p_type AS country,
  p_name AS name, p_size || ' ' || p_brand AS address FROM part)"""


def part_truth(records: DataFrame) -> DataFrame:
    """Truth pairs (s1, t) of part records: each target with the least query of its type that has its first name word, and its
    brand. A target has one query."""
    k = {"country": F.col("country"), "w": F.split("name", " ")[0], "b": F.split("address", " ")[1]}
    r = records.select("id", "source", *[v.alias(c) for c, v in k.items()])
    return r.where("source = 1").groupBy(*k).agg(F.min("id").alias("s1")).join(r.where("source > 1").withColumnRenamed("id", "t"), list(k)).select("s1", "t")


def party_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (source 1) and suppliers (source 2), with their nation as country."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    c = table(spark, sf_dir, "customer").select((F.lit(BILLION10) + F.col("c_custkey")).alias("id"), F.lit(1).alias("source"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, sf_dir, "supplier").select((F.lit(2 * BILLION10) + F.col("s_suppkey")).alias("id"), F.lit(2).alias("source"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey"))
    return c.unionByName(s).join(n, "n_nationkey").drop("n_nationkey")


PARTY_RECORDS = f"""party_records AS (SELECT id, source, name, n_name AS country FROM (
  SELECT {BILLION10} + c_custkey AS id, 1 AS source, c_name AS name, c_nationkey AS k FROM customer UNION ALL
  SELECT {2 * BILLION10} + s_suppkey, 2, s_name, s_nationkey FROM supplier) JOIN nation ON n_nationkey = k)"""

STRATA = ["empty", "eq", "nonum", *[f"r{i}" for i in range(1, 9)]]


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (s1) and the parts they ordered (t) as scored candidate pairs, with scores, truth and strata from hashes."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("s1"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("t"))
    pairs = o.join(li, "k").select("s1", "t").distinct()
    m = 1_000_000
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"), (F.col("n_regionkey") <= 2).alias("seen"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s1"), "c_nationkey").join(n, "c_nationkey").drop("c_nationkey")
    k = F.array(*map(F.lit, STRATA))
    out = pairs.join(c, "s1").withColumns({
        "p1": (h(30, F.col("s1"), F.col("t")) % m) / float(m), "p2": (h(31, F.col("s1"), F.col("t")) % m) / float(m),
        "u": (h(32, F.col("s1"), F.col("t")) % m) / float(m), "st": F.element_at(k, (h(33, F.col("s1"), F.col("t")) % 11 + 1).cast("int")),
    })
    return out.withColumn("y", (F.col("u") < F.col("p2")).cast("int")).drop("u")


SCORED_PAIRS = f"""scored_pairs AS (SELECT s1, t, country, seen, p1, p2, st, (u < p2)::INTEGER AS y FROM (
  SELECT s1, t, n_name AS country, n_regionkey <= 2 AS seen, ({h_sql(30, 's1', 't')} % 1000000) / 1e6 AS p1, ({h_sql(31, 's1', 't')} % 1000000) / 1e6 AS p2,
    ({h_sql(32, 's1', 't')} % 1000000) / 1e6 AS u, ({STRATA})[{h_sql(33, 's1', 't')} % 11 + 1] AS st
  FROM (SELECT DISTINCT o_custkey AS s1, l_partkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = s1 JOIN nation ON n_nationkey = c_nationkey))"""


def doc_truth(records: DataFrame) -> DataFrame:
    """Truth pairs (s1, t): records of sources 2 and 3, each with the least record of source 1 that has its text. A target has
    one query, as in a linkage job, so copies of a text make as many pairs as they are, not their square."""
    k = ["name", "address"]
    a = records.where("source = 1").groupBy(*k).agg(F.min("id").alias("s1"))
    return a.join(records.where("source > 1").select(F.col("id").alias("t"), *k), k).select("s1", "t")


DOC_TRUTH = "doc_truth AS (SELECT a.s1, b.id AS t FROM (SELECT name, address, min(id) AS s1 FROM doc_records WHERE source = 1 GROUP BY ALL) a JOIN doc_records b ON a.name = b.name AND a.address = b.address AND b.source > 1)"

#: Records of two sources with names and addresses in native scripts, and dictionaries of some of their words.
NATIVE = [
    (10_000_000_001, 1, "IN", "Ram Trading Ltd", "12 MG Road, Mumbai, Maharashtra"),
    (20_000_000_001, 2, "IN", "राम ट्रेडिंग Ltd", '12 MG Road, "मुंबई", महाराष्ट्र'),
    (10_000_000_002, 1, "IN", "Kamala Stores", "5 Anna Salai, Chennai, Tamil Nadu"),
    (20_000_000_002, 2, "IN", "কমলা স্টোর্স", "5 Anna Salai, চেন্নাই, তামিলনাড়ু"),
    (30_000_000_001, 3, "IN", "कमल १२३ hôtel", None),
    (30_000_000_002, 3, "IN", None, "तमिलनाडु"),
    (10_000_000_003, 1, "FR", "Société Générale", "1 Rue X, Paris"),
    (20_000_000_003, 2, "IN", "शक्ति और राम", "महाराष्ट्र"),
    (30_000_000_003, 3, "IN", "தமிழ் உணவகம்", ", मुंबई ,"),
]
NATIVE_WORDS = [("राम", "ram"), ("ट्रेडिंग", "trading"), ("স্টোর্স", "stores")]
NATIVE_PARTS = [("महाराष्ट्र", "maharashtra"), ("मुंबई", "mumbai"), ("চেন্নাই", "chennai")]


def native_records(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """NATIVE and its dictionaries of words and of parts of addresses."""
    of = lambda rows: spark.createDataFrame(rows, "word string, latin string")
    return spark.createDataFrame(NATIVE, "id long, source int, country string, name string, address string"), of(NATIVE_WORDS), of(NATIVE_PARTS)


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, row)) + ")" for row in rows) + ")"


NATIVE_SQL = ",\n".join([_values("native", "id, source, country, name, address", NATIVE), _values("words", "word, latin", NATIVE_WORDS), _values("parts", "word, latin", NATIVE_PARTS)])


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a side: 1 are queries, 2 targets; the label is the country."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, 1).otherwise(2).alias("source"), F.col("label").cast("string").alias("country"), F.col("embedding").alias("v"),
    )


DENSE_VECTORS = "dense_vectors AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 2 END AS source, label::VARCHAR AS country, embedding AS v FROM embeddings)"


def sql(*needs: str, body: str) -> str:
    """A statement over the stand-ins named."""
    return "WITH " + ",\n".join(needs) + "\n" + body
