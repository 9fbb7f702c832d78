"""The queries of the operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, licenses, lines, mixing, quality, simhash, toxicity, vectors, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file: where MATCHLOOM_TOKENIZERS says, or as the package of public tokenizers has it."""
    folder = os.environ.get("MATCHLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    return bpe.bpe_digests(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the boilerplate lines of its source."""
    return lines.line_dedup(table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("source")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and sample of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to packages and read back from them."""
    packages = warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    read = warc.read_archives(packages, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of those that aren't held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held()))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(held(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_toxic", "spans")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, repetition shares and the verdict for every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best licence match of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every participant's view of every conversation."""
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_simhash, op3_lines, op4_mixing, op5_warc, op6_toxicity, op7_quality, op8_vectors, op9_licenses, op10_chat)}


WARC_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= {warc.LEAST_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= {warc.LEAST_REVISIT} AND page_id <> first THEN first END AS refers_to FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_lines": lines.line_dedup_sql(), "op4_mixing": mixing.mixed_sql(), "op5_warc": WARC_SQL, "op9_licenses": licenses.license_sql(), "op10_chat": chat.rotate_sql()}
