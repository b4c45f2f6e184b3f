"""Documents to packed training sequences: five stages, each written as Parquet and read again.

Every stage but the last returns the columns it was given, whatever their names.
An empty table stays empty. Repeated rows are judged each; they share an id, so
near_dedup sees one document and keeps or drops them together. Rows without an
id are linked with nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from profseek.functions.shared import ship_package
from profseek.llm.components import stored
from profseek.llm.line_dedup import drop_widespread_lines
from profseek.llm.near_dedup import keep_one
from profseek.llm.packing import packed_documents
from profseek.llm.personal_data import redacted
from profseek.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule; null, empty and short texts do not, long ones are judged whole."""
    ship_package(spark)
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that spread over sites; a null source counts as no site, a null text stays null."""
    ship_package(spark)
    return drop_widespread_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates by five-word shingles; texts without words all stay."""
    ship_package(spark)
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null."""
    ship_package(spark)
    return redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their tokens and their places in sequences; a null or empty text is its end token."""
    ship_package(spark)
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("personal_data", personal_data), ("best_fit_packing", best_fit_packing)]

#: Candidate search and packing have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
