"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Defined cases, for every stage: an empty table gives an empty table; columns beyond those of documents, whatever their names, stay
until the last stage; nulls, empty texts, repeated rows and rows without doc_id are as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphloom.llm import decontaminate, language, near_dup, pieces, secret_scan
from glyphloom.llm.queries import tokenizer_file
from glyphloom.llm.shared import materialise, release, table

NEAR_SHARE = 80  # of a hundred word shingles


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches; null, empty, letterless and foreign texts go. Repeated rows share their fate."""
    return language.in_known_language(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies, alike by 0.8 or more, one row an id.

    Texts without words and rows without doc_id are in no group and stay.
    """
    return near_dup.one_of_each(docs, NEAR_SHARE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, rows without doc_id are searched like all others."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; n_chars is the new text's length, null for a null text."""
    from pyspark.sql import functions as F

    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids (none for a null or empty text), and checksums of ids and decoded text, a row for each row."""
    return pieces.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), keep_ids=True)


STAGES = [("language", known_language), ("near-duplicates", one_of_each_group), ("decontamination", without_benchmark), ("secrets", without_secrets), ("pieces", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        release(before)  # nothing for the table of documents, which no stage wrote
    return docs
