"""The corpus pipeline: documents to packed sequences, each stage one operator of `callmeter.llm`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callmeter.llm import decontaminate, line_runs, near_copies, packing, quality
from callmeter.llm.common import table, written


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal classifier puts below the best grade."""
    return quality.select(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that five documents or more share, but in the largest doc_id."""
    return line_runs.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each group of near copies: five-word shingles, similarity 0.8 or more; SimHash through vantage-point trees, then exact."""
    return near_copies.keep_one(docs)


def decontaminate_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 2048 ids."""
    return packing.pack(docs)


STAGES = [("quality", select_quality), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontaminate_items), ("packing", pack)]
#: Model training and tokenization have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
