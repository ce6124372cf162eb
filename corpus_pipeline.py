"""The corpus pipeline: five stages over documents, each written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontam, exact_dedup, langid, packing, simhash
from foliospark.llm.common import stored
from foliospark.session import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected.

    Null and empty texts, and texts without letters, have no language and go. Repeated rows share one fate; an empty table stays
    empty. Every stage but the last returns the columns of its input, extra ones too, whatever their names.
    """
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case, null as empty) keep the row with the largest doc_id; of rows equal in both, one.

    Null doc_ids rank below all others.
    """
    return exact_dedup.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the row with the smallest doc_id.

    Null doc_ids rank last, ties go to the smaller text digest, null and empty texts have no near copies and stay.
    """
    return simhash.keep_near(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage; null and empty texts hold none, equal texts share one fate, an empty benchmark drops none."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 2048, one row per piece; a null or empty text is its end id alone, an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: A tokenizer and a trained model are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
