"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalink.llm import decontam, mixing, quality, simhash_wide, tokens
from vitalink.llm.common import drop_dir, shared_dir
from vitalink.llm.queries import TOKENIZER, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed thresholds and the learned rules keep.

    Null and blank texts have no words and go; repeated rows share their fate; without labels only the fixed thresholds
    judge; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-copies (similarity 0.8 or more, five-word shingles).

    Ties in the id go by text; null ids come last, blank texts are copies of each other, and of rows with equal id and
    text one stays; an empty table stays empty.
    """
    return simhash_wide.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match no benchmark item.

    Null and blank texts match nothing and stay, repeated rows share their fate, and without items all stay.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, a row for each time.

    Null sources are a source of their own, texts without words are not taken, and repeated rows and ids are rows of
    their own, taken each by its own place; an empty table stays empty.
    """
    return mixing.mixed(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token records of the documents, written and read back.

    Null texts have the end id only, null ids come first, each repeated row gives a record; no documents, no records.
    """
    return tokens.token_records(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_records),
]

#: No SQL engine has the fingerprints, the alignment and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again; of the folders the last one's stays."""
    docs = table(spark, sf_dir, "documents")
    base = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            drop_dir(spark, f"{base}/{k - 1}")
    return docs
