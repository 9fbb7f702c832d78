"""Line dedup by site: lines that stand on a large share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_names

#: A line on more than this share of a host's pages goes.
MAX_RATIO = 0.05
#: A line of a single page is no repetition, however few pages its host has: it stays.
MIN_PAGES = 2
BLANKS = " \t\r\x0b\x0c"


def url_host(url: F.Column) -> F.Column:
    """The host of a URL, as a site's name: lower case, without port and a leading www.; null if there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def _key(line: F.Column) -> F.Column:
    return F.xxhash64(line)


def _trimmed(line: F.Column) -> F.Column:
    return F.btrim(line, F.lit(BLANKS))


def _page_keys(text: str) -> F.Column:
    """A page's distinct lines that aren't blank, as hashes."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda x: x != ""), _key))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows (host, k, n, total): hashes of lines over the ratio, from rows (host, text).

    Each page counts a line once. Counts are combined before the shuffle, and the key holds the line, so a hot host is
    spread over its lines; hosts' totals are counts of pages, combined likewise. Lines are told apart by 64 bits within their
    host: of 10^10 different lines of one host some three pairs share a hash, which matters only if their counts together pass.
    """
    counted = pages.select("host", F.explode(_page_keys("text")).alias("k")).groupBy("host", "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return counted.join(totals, "host").where(F.col("n") > F.col("total") * F.lit(max_ratio))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | F.Column = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with each page's text without its host's boilerplate lines, and columns n_lines and n_dropped.

    Lines are split at \\n and compared trimmed of ASCII blanks; blank lines are never boilerplate and stay; the other
    lines stay as they are, in order. A boilerplate line goes from every page of its host, the first included; a page of
    nothing else is left with its blank lines, or empty. A null host is a host of its own. Null texts have no lines and stay
    null; very long ones are handled line by line in their row. Rows that repeat a page count as pages. An empty table gives
    no rows. Other columns of docs pass through; own columns n_lines and n_dropped are replaced. host_col is a column's name
    or an expression, as url_host(F.col("url")).

    A host has few lines over the ratio: (lines of a page) / max_ratio at most. They are gathered by host and written, and
    each page drops its own in place. Spark broadcasts the hosts' lists if what was written is under its threshold, and then
    no text is shuffled; else texts are joined by host, where a hot host's pages are split as a skewed join.
    """
    host_of = F.col(host_col) if isinstance(host_col, str) else host_col
    host, lists, gone = own_names(docs, "_host", "_lists", "_gone")
    marked = docs.withColumn(host, F.when(host_of.isNull(), "-").otherwise(F.concat(F.lit("+"), host_of.cast("string"))))
    pages = marked.select(F.col(host).alias("host"), F.col(text_col).alias("text"))
    bad = cut(boilerplate(pages, max_ratio, min_pages).groupBy(F.col("host").alias(host)).agg(F.collect_set("k").alias(lists)))
    lines = F.split(text_col, "\n")
    own = F.when(F.col(lists).isNotNull(), F.array_intersect(_page_keys(text_col), F.col(lists)))
    joined = marked.join(bad, host, "left").withColumn(gone, own)
    stay = F.when(F.size(gone) > 0, F.filter(lines, lambda x: ~F.array_contains(gone, _key(_trimmed(x))))).otherwise(lines)
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    dropped = F.when(F.size(gone) > 0, count(lines) - count(stay)).otherwise(F.lit(0).cast("long"))
    text = F.when(F.size(gone) > 0, F.array_join(stay, "\n")).otherwise(F.col(text_col))
    return joined.withColumns({"n_lines": F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(count(lines)), "n_dropped": dropped, text_col: text}).drop(host, lists, gone)


def line_dedup_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same in DuckDB's SQL."""
    trim = "trim({}, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
    return f"""
WITH pages AS (SELECT {id_col} AS id, coalesce('+' || {host_col}, '-') AS host, string_split({text_col}, chr(10)) AS ls FROM {table}),
lines AS (SELECT host, unnest(list_distinct(list_filter(list_transform(ls, lambda x: {trim.format('x')}), lambda x: x <> ''))) AS line FROM pages),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY host),
bad AS (SELECT host, list(line) AS lines FROM (SELECT l.host, l.line FROM lines l JOIN totals t USING (host) GROUP BY l.host, l.line, t.total
        HAVING count(*) >= {min_pages} AND count(*) > t.total * {max_ratio}) GROUP BY host),
done AS (SELECT p.*, list_filter(ls, lambda x: NOT list_contains(coalesce(b.lines, []), {trim.format('x')})) AS st FROM pages p LEFT JOIN bad b USING (host))
SELECT id AS {id_col}, CASE WHEN ls IS NOT NULL THEN coalesce(array_to_string(st, chr(10)), '') END AS {text_col}, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(st), 0)::BIGINT AS n_dropped FROM done
"""
