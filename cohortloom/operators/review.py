"""Review of stored cohorts: lists, members, evidence, counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.schemas import PAGE_SIZE


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table; every count is one partial aggregate per task."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = counts[0]
    for count in counts[1:]:
        out = out.unionByName(count)
    return out


def kpi_row(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row of counts: patients, encounters, conditions, notes, cohorts, members."""
    names = {
        "n_patients": "patient", "n_encounters": "encounter", "n_conditions": "condition",
        "n_notes": "clinical_note", "n_cohorts": "cohort_definition", "n_members": "cohort_member",
    }
    counts = row_counts({column: tables[table] for column, table in names.items()})
    return counts.agg(*[F.max(F.when(F.col("table_name") == column, F.col("n_rows"))).alias(column) for column in names])


def filter_definitions(definitions: DataFrame, types=(), categories=(), statuses=()) -> DataFrame:
    for column, wanted in (("cohort_type", types), ("cohort_category", categories), ("status", statuses)):
        if wanted:
            definitions = definitions.filter(F.col(column).isin(list(wanted)))
    return definitions


def recent_cohorts(definitions: DataFrame, n: int = 10) -> DataFrame:
    return (
        definitions.select("cohort_sk", "name", "cohort_type", "cohort_category", "status", "created_by", "created_at")
        .orderBy(F.col("created_at").desc(), F.col("cohort_sk").desc())
        .limit(n)
    )


def member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("cohort_sk").agg(F.count("patient_sk").alias("member_count"))


def cohort_list(definitions: DataFrame, members: DataFrame, types=(), categories=(), statuses=("active",)) -> DataFrame:
    """Definitions with their member count, newest first; a cohort without members counts zero.

    Members are counted before the join, so it has one row per cohort on either side.
    """
    columns = ("cohort_sk", "name", "cohort_type", "cohort_category", "primary_concept_display", "status", "version",
               "created_by", "created_at")
    chosen = filter_definitions(definitions, types, categories, statuses).select(*columns)
    return (
        chosen.join(member_counts(members), "cohort_sk", "left")
        .withColumn("member_count", F.coalesce("member_count", F.lit(0)))
        .orderBy(F.col("created_at").desc(), "cohort_sk")
    )


def cohort_members(members: DataFrame, patients: DataFrame, cohort_sk: int) -> DataFrame:
    return (
        members.filter(F.col("cohort_sk") == cohort_sk)
        .join(patients, "patient_sk")
        .select("patient_sk", "mrn", "birth_date", "sex", "race", "state", "index_date", "qualifying_source")
    )


def member_page(members: DataFrame, patients: DataFrame, cohort_sk: int, rows: int = PAGE_SIZE) -> DataFrame:
    return cohort_members(members, patients, cohort_sk).orderBy("mrn", "patient_sk").limit(rows)


def export_rows(members: DataFrame, patients: DataFrame, cohort_sk: int, limit: int | None = None) -> DataFrame:
    """Rows of the CSV export: all members, or the first by MRN where a limit is asked for."""
    if limit is not None:
        return member_page(members, patients, cohort_sk, limit)
    return cohort_members(members, patients, cohort_sk)


def condition_listing(members: DataFrame, patients: DataFrame, conditions: DataFrame, cohort_sk: int, rows: int = 200) -> DataFrame:
    """All conditions of the members, newest first."""
    order = [F.col("recorded_date").desc_nulls_last(), F.col("condition_sk").desc()]
    chosen = members.filter(F.col("cohort_sk") == cohort_sk).select("patient_sk").join(patients.select("patient_sk"), "patient_sk", "left_semi")
    newest = conditions.join(chosen, "patient_sk", "left_semi").orderBy(*order).limit(rows)
    # MRNs are joined to the rows that are shown only.
    return newest.join(patients.select("patient_sk", "mrn"), "patient_sk").orderBy(*order).limit(rows).select(
        "mrn", "condition_code", "clinical_status", "recorded_date", "category"
    )


def definition_detail(definitions: DataFrame, cohort_sk: int) -> DataFrame:
    return definitions.filter(F.col("cohort_sk") == cohort_sk)


def current_status(definitions: DataFrame, changes: DataFrame) -> DataFrame:
    """Definitions with the status of their newest change, or their own where there is none."""
    newest = changes.groupBy("cohort_sk").agg(F.max(F.struct("changed_at", "status"))["status"].alias("_status"))
    return (
        definitions.join(newest, "cohort_sk", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status")
    )


def versioned(definitions: DataFrame) -> DataFrame:
    """Version numbers per cohort name in order of creation; all but the newest are archived."""
    by_age = Window.partitionBy("name").orderBy("created_at", "cohort_sk")
    by_name = Window.partitionBy("name").orderBy(F.col("created_at").desc(), F.col("cohort_sk").desc())
    return (
        definitions.withColumn("version", F.row_number().over(by_age))
        .withColumn("_from_newest", F.row_number().over(by_name))
        .withColumn("status", F.when(F.col("_from_newest") > 1, "archived").otherwise(F.col("status")))
        .drop("_from_newest")
    )


def newest_definition(definitions: DataFrame) -> DataFrame:
    """Key of the newest definition of each name."""
    newest = F.max(F.struct("created_at", "cohort_sk"))["cohort_sk"]
    return definitions.groupBy("name").agg(newest.alias("cohort_sk"))
