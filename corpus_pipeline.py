"""The corpus pipeline: five stages, each of which reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import stages
from cohortloom.llm.shared import delete_folder, new_folder, table

STAGES = [
    ("toxicity", stages.untoxic),
    ("exact_dedup", stages.exact),
    ("near_dedup", stages.near),
    ("mixing", stages.mixed),
    ("packing", stages.packed),
]

# Tokenizer, trained model and signatures can't be said in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; an empty table gives none. What each stage says of nulls, odd texts and repeated rows holds for its own input.

    A stage's files are deleted when the next one's are there; those of the last but one stay for the frame returned.
    """
    docs, folder = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        former, folder = folder, new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if former is not None:
            delete_folder(spark, former)
    return STAGES[-1][1](spark, docs, sf_dir)
