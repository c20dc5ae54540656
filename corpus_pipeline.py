"""The corpus pipeline: stages over the documents table, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs. Null ids and
texts, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import materialize, table
from factloom.llm.decontam import keep_uncontaminated
from factloom.llm.langid import keep_identified
from factloom.llm.neardup import keep_representatives
from factloom.llm.packing import pack_documents
from factloom.llm.secret_scan import find_secrets, redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learnt language go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays, that of the smallest id."""
    return keep_representatives(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that are no widely copied examples are replaced in the texts; all documents stay."""
    return redact(docs, find_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]
#: SQL cannot express the stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
