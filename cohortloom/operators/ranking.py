"""Positions within a group, newest rows per group and latest state per key, safe for very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group.

    Spark cuts each group to k rows inside every input task before the shuffle (WindowGroupLimit), so
    a group that holds a large part of the table is never gathered.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).filter(F.col("_position") <= k).drop("_position")


def key_block(day: Column, key: Column) -> Column:
    """Bucket of a row in the order of (day, key), days that are null first: its day, else a block of 1,000 keys that follow one another."""
    place = F.lpad((key.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.coalesce(day.cast("string"), F.concat(F.lit(" "), F.substr(place, F.lit(1), F.lit(17))))


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str, before_name: str | None = None) -> DataFrame:
    """row_number() within each group, without sorting a whole group in one task.

    `bucket` must be a text that follows the order (the day of the ordering time, leading digits of
    a hash); rows without one come first. Rows are numbered within (group, bucket); the number of rows
    in earlier buckets is added. Counting them needs one small row per group and bucket, and the join
    runs on the partitioning the numbering already made. Keys must not be null. `before_name` also gives the number of rows in earlier buckets.
    """
    rows = df.withColumn("_bucket", F.coalesce(bucket.cast("string"), F.lit("")))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        rows.withColumn("_local", local)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
        .withColumn(before_name or "_before", F.col("_before"))
        .drop("_bucket", "_local", "_before")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by an aggregation that is combined before the shuffle."""
    rest = [column for column in df.columns if column not in keys and column not in order]
    newest = F.max(F.struct(*order, F.struct(*rest).alias("_rest") if rest else F.lit(None).alias("_rest")))
    out = df.groupBy(*keys).agg(newest.alias("_row"))
    columns = []
    for column in df.columns:
        if column in keys:
            columns.append(F.col(column))
        elif column in order:
            columns.append(F.col(f"_row.{column}").alias(column))
        else:
            columns.append(F.col(f"_row._rest.{column}").alias(column))
    return out.select(*columns)


def encounter_index(encounters: DataFrame) -> DataFrame:
    """Position of each encounter in its patient's history from 0, and whether it is the first."""
    ordered = numbered(
        encounters, ["patient_sk"], key_block(F.col("period_start").cast("date"), F.col("encounter_sk")),
        [F.col("period_start").asc_nulls_first(), F.col("encounter_sk")], "_position",
    )
    return (
        ordered.withColumn("encounter_index", F.col("_position") - 1)
        .withColumn("is_first", F.col("encounter_index") == 0)
        .drop("_position")
    )


def diagnosis_rank(conditions: DataFrame, background: list[str]) -> DataFrame:
    """Rank of a diagnosis within its encounter: 1 is primary; background findings share the last place.

    Diagnoses outside any encounter have no rank.
    """
    is_background = F.coalesce(F.col("condition_code").isin(background), F.lit(False))
    outside = conditions.filter(F.col("encounter_sk").isNull()).withColumn("diagnosis_rank", F.lit(None).cast("long"))
    # Background findings form the last buckets of an encounter: what lies before the first of these are its primary diagnoses.
    place = F.concat(F.lit("a"), key_block(F.col("recorded_date").cast("date"), F.col("condition_sk")))
    inside = numbered(
        conditions.filter(F.col("encounter_sk").isNotNull()), ["encounter_sk"], F.when(is_background, "b").otherwise(place),
        [F.col("recorded_date").asc_nulls_first(), F.col("condition_sk")], "_position", "_earlier",
    )
    ranked = inside.withColumn("diagnosis_rank", F.when(is_background, F.col("_earlier") + 1).otherwise(F.col("_position")).cast("long"))
    return ranked.drop("_position", "_earlier").unionByName(outside)


def latest_values(observations: DataFrame, codes: dict[str, str], extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Newest numeric value per patient for each code; equal times are decided by the higher key."""
    measures = [
        F.max(F.when(
            F.col("observation_code") == code, F.struct("effective_datetime", "observation_sk", "value_numeric")
        ))["value_numeric"].alias(name)
        for name, code in codes.items()
    ]
    wanted = observations.filter(F.col("observation_code").isin(list(codes.values())) & F.col("value_numeric").isNotNull())
    return wanted.groupBy("patient_sk", *extra_keys).agg(*measures)


def latest_signed_note(versions: DataFrame) -> DataFrame:
    """Of all versions of a note, the newest that is signed."""
    return latest_per_key(versions.filter(F.col("status").isin("signed", "addended")), ["note_id"], ["filed_at", "version_id"])
