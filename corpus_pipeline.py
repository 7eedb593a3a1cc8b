"""From raw documents to token records: five stages, each written and read back as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import langid, minhash, mixing, records, templates
from fleetlens.llm.common import table
from fleetlens.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept; those without a letter or unlike every language go."""
    return langid.accepted(docs, langid.learned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    return minhash.first_of_group(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return templates.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token records give back, one row per document."""
    return records.token_records(docs)


STAGES = [
    ("language ID", language_id), ("near duplicates", near_duplicates), ("decontamination", decontamination),
    ("mixing", mixing_to_weights), ("token records", token_records),
]
#: Models, sampling and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
