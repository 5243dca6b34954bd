"""Queries opN_<name> and their DuckDB SQL; ``__spark_entry__`` adds them where this subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, huffman, importance, main_text, oracles, pii, simhash, spotsigs, substrings, token_counts, toxicity, variants, warc
from .common import new_path, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files against a replica's, in which 3 of 50 ids are damaged."""
    pages = table(spark, sf_dir, "pages")
    return warc.compare(pages, warc.damaged(pages, F.pmod(F.col("page_id") * 37, F.lit(50))), new_path(spark, "warc"))


def op5_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, new_path(spark, "token-ids"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_digests(table(spark, sf_dir, "documents"))


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in their classes of near duplicates, of op9's fingerprints."""
    return spotsigs.near_duplicates(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_simhash": op2_simhash, "op3_pii": op3_pii, "op4_merkle": op4_merkle, "op5_huffman": op5_huffman, "op6_decontaminate": op6_decontaminate, "op7_suffix_array": op7_suffix_array, "op8_token_counts": op8_token_counts, "op9_spotsigs": op9_spotsigs, "op10_byte_bpe": op10_byte_bpe, "op11_main_text": op11_main_text, "op12_importance": op12_importance, "op13_variants": op13_variants, "spotsigs_classes": spotsigs_classes}


_CRLF = "chr(13) || chr(10)"
_RECORD = f"""'WARC/1.0' || {_CRLF} || 'WARC-Type: resource' || {_CRLF} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {_CRLF}
    || 'WARC-Target-URI: ' || coalesce(url, '') || {_CRLF} || 'Content-Type: text/html' || {_CRLF}
    || 'Content-Length: ' || strlen(body) || {_CRLF} || {_CRLF} || body || {_CRLF} || {_CRLF}"""
_PLACE = 'CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY warc_file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"'
OP4_SQL = f"""
WITH p AS (SELECT page_id, url, CAST(page_id // 256 AS BIGINT) AS warc_file, (page_id * 37) % 50 AS fault, coalesce(html, '') AS body FROM pages),
q AS (SELECT * REPLACE (CASE fault WHEN 0 THEN left(body, length(body) // 2) || '!' || substr(body, length(body) // 2 + 1) WHEN 2 THEN left(body, length(body) // 2) ELSE body END AS body) FROM p WHERE fault <> 1),
a AS (SELECT *, {_PLACE} FROM (SELECT page_id, warc_file, {_RECORD} AS record FROM p)),
b AS (SELECT *, {_PLACE} FROM (SELECT page_id, warc_file, {_RECORD} AS record FROM q))
SELECT a.page_id, a.warc_file, a."offset", CAST(strlen(a.record) AS BIGINT) AS length, sha256(a.record) AS record_sha256,
  CASE WHEN b.page_id IS NULL THEN 'lost' WHEN a.record <> b.record THEN 'altered' WHEN a."offset" <> b."offset" THEN 'moved' ELSE 'intact' END AS status
FROM a LEFT JOIN b USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    """The others' fingerprints, models, tokenizers and searches are not SQL; tests hold them against brute force."""
    return {"op4_merkle": OP4_SQL, "op11_main_text": oracles.OP11_SQL, "op12_importance": oracles.OP12_SQL, "op13_variants": oracles.OP13_SQL}
