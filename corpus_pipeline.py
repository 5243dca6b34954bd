"""Corpus pipeline: documents through five training-data operators, each stage on what the last one kept.

In all stages an empty table gives an empty one, other columns than those of documents pass or are left
out but are never read, and texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import bpe, decontaminate, pii, simhash, toxicity
from skarn.llm.common import removed, table, written


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects (score 0.5 or more) go.

    Each row is judged by its text alone: null and empty texts score alike, repeated rows stay or go together,
    null ids are never learnt from. Without any label all scores are 0.5, so all would go.
    """
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document of least id stays.

    Null ids come last; of equal ids the text of least hash stays, of equal rows one. Null and empty texts and those
    without words are one group.
    """
    return simhash.keep_one(docs)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go, whatever their ids; repeated rows stay or go together. Null and empty
    texts and items match nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows. All documents stay, as often as they came; null
    texts stay null, and their n_chars is null. Where spans overlap the first one's kind stands."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to. Null and empty texts have no ids; repeated rows
    come back as often as they came."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=("lang", "source", "n_chars")).select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", clean_language),
    ("simhash", one_of_each),
    ("decontamination", no_benchmarks),
    ("pii", no_personal_data),
    ("byte_bpe", token_ids),
]
#: Fingerprints, models and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each one's rows are written to the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:  # no later plan reads it
            removed(spark, last)
        last = docs
    return docs
