"""People behind source records: records that share identifiers, directly or through others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import checkpoint_folder

IDENTIFIER = ("identifier_type", "assigning_authority", "identifier_value")


def _staged(df: DataFrame) -> DataFrame:
    path = f"{checkpoint_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linked_people(identifiers: DataFrame, most: int = 100) -> DataFrame:
    """One patient key per source record: the lowest source key that can be reached through shared identifiers.

    An identifier with an empty part links nothing, nor does a placeholder: one that more than `most` records hold. Records of one identifier are tied to
    its lowest one only, so an identifier never makes pairs. Each round hangs everything a record is tied to, and the record itself, on the lowest of them; the
    number of rounds grows with the logarithm of the longest chain. Records without links are linked to themselves; null keys are left out.
    """
    known = identifiers.filter(F.col("source_key").isNotNull())
    usable = known.dropna(subset=list(IDENTIFIER)).select("source_key", *IDENTIFIER).distinct()
    holders = usable.groupBy(*IDENTIFIER).agg(F.min("source_key").alias("low"), F.count("*").alias("n")).filter(F.col("n").between(2, most))
    ties = _staged(usable.join(holders, list(IDENTIFIER)).filter("source_key > low").select(F.col("source_key").alias("a"), F.col("low").alias("b")).distinct())
    while True:
        both = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # Everybody a record is tied to hangs on the lowest it knows of, and so does the record itself.
        hung = both.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lowest.select("a", F.col("low").alias("b")))
        after = _staged(hung.filter("a > b").distinct())
        if after.exceptAll(ties).isEmpty() and ties.exceptAll(after).isEmpty():
            break
        ties = after
    people = ties.groupBy("a").agg(F.min("b").alias("patient_sk"))
    own = known.select("source_key").distinct()
    return own.join(people, F.col("source_key") == F.col("a"), "left").select("source_key", F.coalesce("patient_sk", "source_key").alias("patient_sk"))
