"""Prospective cohorts: evidence captured from newly arriving files, membership on what was captured.

Either the evidence is appended to files exactly once and membership is a batch query over it, or every batch is folded into one row per patient and
criterion. Then the number of the last batch is part of the stored state: a batch that comes again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cohortloom.operators.cohort import members_from_triggers, qualified_members
from cohortloom.operators.criteria import CohortSpec, Criterion
from cohortloom.operators.evidence import evidence_rows, folded, state_of_rows, trigger_rows
from cohortloom.schemas import TABLES
from cohortloom.sources.lake import Lake


def new_rows(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """Stream of the rows of a clinical table from the parquet files that arrive in a folder."""
    return spark.readStream.schema(TABLES[table].schema).parquet(folder)


def capture_evidence(
    rows: DataFrame, table: str, criteria: list[Criterion], evidence_folder: str, checkpoint_folder: str
) -> StreamingQuery:
    """Append the evidence in all files that have arrived since the last run, then stop."""
    own = [criterion for criterion in criteria if criterion.table == table]
    return (
        evidence_rows({table: rows}, own).writeStream.format("parquet").outputMode("append")
        .option("path", evidence_folder).option("checkpointLocation", checkpoint_folder)
        .trigger(availableNow=True).start()
    )


def members_from_evidence(evidence: DataFrame, patients: DataFrame, spec: CohortSpec) -> DataFrame:
    """Members, index date and source from captured evidence rows."""
    return qualified_members({"patient": patients}, spec, state_of_rows(evidence, spec.criteria))


def fold_batch(lake: Lake, stream: str, table: str, criteria: list[Criterion], batch: DataFrame, number: int) -> bool:
    """Folds a batch of new rows of a table into the stream's state; False if the batch is already in it.

    State and number change in one step: a batch that dies half-way leaves both as they were, and comes again.
    """
    own = [criterion for criterion in criteria if criterion.table == table]
    found = trigger_rows(evidence_rows({table: batch}, own))
    return lake.supersede(folded(lake.table("captured_state", stream=stream), found), "captured_state", stream=stream, batch=number)


def merge_members(rows: DataFrame, lake: Lake, stream: str, table: str, criteria: list[Criterion], checkpoint_folder: str) -> StreamingQuery:
    """Folds all files that have arrived since the last run into the stream's state, batch by batch, then stops."""
    return (
        rows.writeStream.foreachBatch(lambda batch, number: fold_batch(lake, stream, table, criteria, batch, number) and None)
        .option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()
    )


def streamed_members(lake: Lake, streams: list[str], patients: DataFrame, spec: CohortSpec) -> DataFrame:
    """Members with index date, source and triggers from the state of streams, one for each table of the criteria."""
    return members_from_triggers({"patient": patients}, spec, lake.table("captured_state", stream=set(streams)))
