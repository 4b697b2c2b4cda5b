"""Corpus pipeline: drop toxic documents, repeated lines, near copies and leaked benchmark passages, then pack.

Every stage takes (spark, docs, sf_dir), reads all rows its predecessor kept, and its result is written and read
again before the next one, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drawstat.llm import decontaminate, line_dedup, packing, simhash, toxicity
from drawstat.llm.common import keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier passes."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines covered by repeated windows; n_chars follows the text."""
    return line_dedup.clean_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in bins."""
    return packing.pack_texts(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash", drop_near_copies),
          ("decontamination", drop_leaks), ("packing", pack)]

# The classifier is trained, so SQL cannot say what it rejects; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = keep(stage(spark, rows, sf_dir), name)
    return rows
