"""From raw documents to packed training sequences.

STAGES are applied one after another; each result is written as Parquet and read again as the next stage's
documents. All but the last keep the columns of documents.

Defined results: documents with a null text, or one without letters, go at the first stage, so the later ones see texts
only; a null doc_id, lang or source is carried along; of repeated rows the second stage keeps one; rows of one doc_id with
different texts are judged each. Extra columns are carried up to the last stage, whatever their names; packing returns
doc_id and its own columns. n_chars follows the text where it is masked. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontamination, language, near_duplicates, packing, pii
from quern.llm.common import table, write_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, being null or without letters, go."""
    return language.accepted(spark, docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, 0.8 or more of their 5-word shingles, stays: the one with the smallest id."""
    return near_duplicates.distinct(spark, docs, 80, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows."""
    masked = pii.mask(spark, docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack_documents(spark, docs)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminate), ("mask_pii", mask_pii), ("pack", pack)]

#: SQL can't express tokenizing, learned models or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = write_table(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
