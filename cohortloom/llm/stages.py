"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from cohortloom.llm.shared import table


def untoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, learned from the labels of sf_dir, doesn't reject. Null texts are scored as empty ones; repeated rows are scored alike and all
    stay or go; an empty table stays empty."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space, the longest (then the smallest id). Null texts count as empty, so of all
    null and empty ones a single row stays; an empty table stays empty."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies. Texts without words (null and empty ones) all stay, shorter ones than five words are one shingle;
    an empty table stays empty."""
    return near_dedup.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (up to three times, perhaps not at all). A null source is a source of its own, null texts have no words;
    an empty table stays empty."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its sequence and offset. Null texts are empty (the end id alone); repeated rows are pieces of their own; an empty
    table gives no rows."""
    return packing.packed(docs)
