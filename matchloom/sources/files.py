"""Files of records and match sets: tab-separated text without quoting, JSON dictionaries, and checks of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids

TAB = "\t"


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every field a string as it stands, quotes included; missing ones are empty; header lines, wherever they are, are left out."""
    lines = spark.read.text(path).where(F.col("value") != TAB.join(columns))
    cells = F.split("value", TAB, -1)
    return lines.select(*[F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


def write_tsv(df: DataFrame, path: str) -> None:
    """Columns as strings, nulls empty, tabs and line ends as blanks; the header is the first file."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]", " ") for c in df.columns]
    rows = df.select(F.concat_ws(TAB, *cells).alias("value"))
    head = df.sparkSession.createDataFrame([(TAB.join(df.columns),)], "value string")
    head.coalesce(1).unionAll(rows).write.mode("overwrite").text(path)


def write_dictionary(df: DataFrame, path: str) -> None:
    """Rows (kind, key, value) as JSON lines."""
    df.select("kind", "key", "value").write.mode("overwrite").json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, key string, value string").json(path)


def read_parts(spark: SparkSession, *paths: str) -> DataFrame:
    """Several folders of equal columns as one table."""
    return spark.read.parquet(*paths)


def set_output(everyone: DataFrame, links: DataFrame, score: str, name: str) -> DataFrame:
    """One row (source1_entity_id, name) for each s1 of everyone: its t by score, joined by commas, "" if none."""
    sets = links.groupBy("s1").agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("k"), "t"))).alias("x"))
    joined = everyone.select("s1").join(sets, "s1", "left")
    return joined.select(ids.decode(F.col("s1")).alias("source1_entity_id"), F.coalesce(F.array_join(F.transform("x", lambda p: ids.decode(p["t"])), ","), F.lit("")).alias(name))


def set_links(sets: DataFrame, name: str) -> DataFrame:
    """Rows (s1, t) of a set-valued table."""
    t = F.explode(F.split(name, ","))
    return sets.select("source1_entity_id", t.alias("x")).where("x <> ''").select(ids.encode(F.col("source1_entity_id")).alias("s1"), ids.encode(F.col("x")).alias("t"))


def patch_sets(sets: DataFrame, extra: DataFrame, name: str) -> DataFrame:
    """sets with links (s1, t) put at the end of their lists, each once."""
    more = extra.groupBy(ids.decode(F.col("s1")).alias("source1_entity_id")).agg(F.array_sort(F.collect_set(ids.decode(F.col("t")))).alias("m"))
    old = F.filter(F.split(name, ","), lambda x: x != "")
    return sets.join(more, "source1_entity_id", "left").select("source1_entity_id", F.array_join(F.array_distinct(F.concat(old, F.coalesce("m", F.array().cast("array<string>")))), ",").alias(name))


def mask_sets(sets: DataFrame, records: DataFrame, country: str, name: str) -> DataFrame:
    """sets with the lists of one country's records emptied."""
    c = records.select(ids.decode(F.col("id")).alias("source1_entity_id"), "country")
    return sets.join(c, "source1_entity_id", "left").select("source1_entity_id", F.when(F.col("country").eqNullSafe(country), "").otherwise(F.col(name)).alias(name))


def audit(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of counts that are all 0 for a sound output, and its totals."""
    m = matches.select("source1_entity_id", F.filter(F.split("matched_entity_ids", ","), lambda x: x != "").alias("m"))
    c = candidates.select("source1_entity_id", F.filter(F.split("candidate_entity_ids", ","), lambda x: x != "").alias("c"))
    both = m.join(c, "source1_entity_id", "full")
    bad = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return both.agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct("source1_entity_id")).alias("repeated_s1"),
        bad(~F.col("source1_entity_id").rlike("^S1-[0-9]+$")).alias("bad_s1"), bad(F.col("m").isNull() | F.col("c").isNull()).alias("unpaired"),
        bad(F.size(F.array_distinct("m")) < F.size("m")).alias("repeated_t"), bad(F.exists("m", lambda x: ~x.rlike("^S[23]-[0-9]+$"))).alias("bad_t"),
        bad(F.size(F.array_except("m", "c")) > 0).alias("not_candidates"), F.sum(F.size("m")).cast("long").alias("n_matches"), F.sum(F.size("c")).cast("long").alias("n_candidates"),
        F.max(F.size("m")).cast("long").alias("most_matches"),
    )
