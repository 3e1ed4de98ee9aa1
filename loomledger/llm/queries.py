"""The operators of this subpackage as queries over the driver's tables, and SQL for some of them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, lines, minhash, packing, pii, pitman_yor, quality, repair, suffix_dedup, token_counts, token_file, warc
from .common import Workspace


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.clean(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark).path("token-file")
    token_file.write_token_file(spark, _documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_file.read_token_file(spark, path)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(spark, _documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("clean_text", "UTF-8"), 256).alias("clean_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(spark, _documents(spark, sf_dir))
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")  # a cut may fall inside a character
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(spark, _documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(token_counts.encoded_lengths(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark).path("warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = warc.assemble(warc.read_records(spark, path))
    return out.select(
        F.col("metadata.page_id").cast("long").alias("page_id"),
        F.coalesce("payload_bytes", F.col("metadata.payload_bytes").cast("long")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("original.page_id").cast("long").alias("refers_to"),
    )


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align(spark, _documents(spark, sf_dir), *paths)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(spark, _documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_quality, op3_token_file, op4_line_dedup, op5_suffix_dedup, op6_decontaminate, op7_pitman_yor, op8_packing, op9_token_counts, op10_warc, op11_align, op12_repair, op13_pii)}

ORACLE_SQL = {
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages WHERE page_id IS NOT NULL),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM f
    """,
}
