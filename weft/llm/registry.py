"""Queries of the training-data operators, and the oracle statements of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, dedup_substrings, jaccard, licenses, mixing, oracles, pii, quality, secrets, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality.quality_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with the spans that weak supervision adds."""
    return pii.detect(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of every document for the sources' targets."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places and labels of every document."""
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity categories of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_chain(docs, _table(spark, sf_dir, "labels")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted text of every conversation."""
    return chat.read_back(chat.format_conversations(chat.with_probe(_table(spark, sf_dir, "conversations"))))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, judged by how many owners hold them."""
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_dedup_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 400 bytes leave of every document."""
    return dedup_substrings.dedup_substrings(_table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii, "op2_mix_sources": op2_mix_sources, "op3_license_scan": op3_license_scan, "op4_toxicity": op4_toxicity, "op5_chat_format": op5_chat_format, "op6_jaccard_join": op6_jaccard_join, "op7_secret_scan": op7_secret_scan, "op8_decontaminate": op8_decontaminate, "op9_quality_rules": op9_quality_rules, "op10_dedup_substrings": op10_dedup_substrings}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
