"""Per-patient timelines, for one patient or for many at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.ranking import top_per_group
from cohortloom.schemas import PAGE_SIZE


@dataclass(frozen=True)
class Section:
    """What a timeline shows of one table: columns, the time and key it is ordered by, and how many rows."""

    columns: tuple[str, ...]
    time: str
    key: str
    limit: int = PAGE_SIZE


SECTIONS: dict[str, Section] = {
    "encounter": Section(
        ("encounter_sk", "encounter_class", "encounter_type", "status", "period_start", "period_end",
         "attending_provider_name", "facility_name"),
        "period_start", "encounter_sk",
    ),
    "condition": Section(
        ("condition_sk", "condition_code", "condition_display", "category", "clinical_status", "is_chronic",
         "onset_date", "recorded_date", "resolved_date"),
        "recorded_date", "condition_sk",
    ),
    "observation": Section(
        ("observation_sk", "category", "observation_code", "observation_display", "value_numeric", "value_string",
         "unit", "interpretation", "effective_datetime", "parent_observation_sk"),
        "effective_datetime", "observation_sk", 200,
    ),
    "medication_order": Section(
        ("med_order_sk", "med_code", "med_display", "order_class", "dose_quantity", "dose_unit", "route",
         "frequency", "order_status", "start_datetime", "end_datetime"),
        "start_datetime", "med_order_sk",
    ),
    "procedure": Section(
        ("procedure_sk", "procedure_code", "procedure_display", "procedure_category", "status", "performed_datetime"),
        "performed_datetime", "procedure_sk",
    ),
    "clinical_note": Section(
        ("note_sk", "note_category", "note_type_display", "author_name", "service_date", "status"),
        "service_date", "note_sk",
    ),
}


def find_patient(patients: DataFrame, mrn: str) -> DataFrame:
    return patients.filter(F.col("mrn") == mrn.strip()).limit(1)


def patient_key(patients: DataFrame, mrn: str) -> int | None:
    """Key of the patient of an MRN; None where there is none."""
    row = find_patient(patients, mrn).select("patient_sk").first()
    return row["patient_sk"] if row else None


def rows_of_patient(df: DataFrame, patient_sk: int | None) -> DataFrame:
    """Rows of one patient by key: the filter reaches the scan, which skips the files and row groups of others."""
    return df.filter(F.lit(False) if patient_sk is None else F.col("patient_sk") == patient_sk)


def section_by_mrn(patients: DataFrame, df: DataFrame, table: str, mrn: str) -> DataFrame:
    """The newest rows of one table of the patient with this MRN, with the key."""
    what, key = SECTIONS[table], patient_key(patients, mrn)
    rows = _top_level(rows_of_patient(df, key), table)
    return rows.select("patient_sk", *_shown(df, what)).orderBy(*_newest_first(what)).limit(what.limit)


def _newest_first(section: Section) -> list[Column]:
    return [F.col(section.time).desc_nulls_last(), F.col(section.key).desc()]


def _top_level(df: DataFrame, table: str) -> DataFrame:
    """Components of a panel are shown through their panel only."""
    return df.filter(F.col("parent_observation_sk").isNull()) if table == "observation" else df


def _shown(df: DataFrame, section: Section) -> list[str]:
    return [column for column in section.columns if column in df.columns]


def section(df: DataFrame, table: str, patient_sk: int) -> DataFrame:
    """Newest rows of one table for one patient; the patient filter reaches the file scan."""
    what = SECTIONS[table]
    rows = _top_level(df.filter(F.col("patient_sk") == patient_sk), table)
    return rows.select(*_shown(df, what)).orderBy(*_newest_first(what)).limit(what.limit)


def timeline(tables: Mapping[str, DataFrame], patient_sk: int) -> dict[str, DataFrame]:
    return {table: section(tables[table], table, patient_sk) for table in SECTIONS if table in tables}


def section_for_patients(df: DataFrame, table: str, patients: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """Newest k rows of one table for each of many patients (all patients when none are named)."""
    what = SECTIONS[table]
    rows = _top_level(df, table)
    if patients is not None:
        rows = rows.join(patients.select("patient_sk"), "patient_sk", "left_semi")
    rows = rows.select("patient_sk", *_shown(df, what))
    return top_per_group(rows, ["patient_sk"], _newest_first(what), k or what.limit)


def diagnosis_counts(conditions: DataFrame, by: tuple[str, ...] = ("patient_sk",)) -> DataFrame:
    return conditions.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("clinical_status") == "active").alias("n_active"),
        F.count_if(F.col("clinical_status") == "resolved").alias("n_resolved"),
    )


def labs(observations: DataFrame) -> DataFrame:
    return observations.filter(F.col("category") == "laboratory")


def vitals(observations: DataFrame) -> DataFrame:
    return observations.filter(F.col("category") == "vital-signs")


def active_medications(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == "active")


def lab_trend(observations: DataFrame, code: str | None = None) -> DataFrame:
    """Values of one lab code over time, oldest first.

    Without a code, the patient's newest top-level lab result decides which one.
    """
    results = _top_level(labs(observations), "observation")
    if code is None:
        newest = results.agg(
            F.max(F.struct("effective_datetime", "observation_sk", "observation_code"))["observation_code"].alias("_code")
        )
        results = results.join(newest, F.col("observation_code") == F.col("_code"), "left_semi")
    else:
        results = results.filter(F.col("observation_code") == code)
    return (
        results.filter(F.col("value_numeric").isNotNull())
        .select("observation_sk", "observation_code", "effective_datetime", "value_numeric")
        .orderBy("effective_datetime", "observation_sk")
    )


def note_text(notes: DataFrame, note_sk: int) -> DataFrame:
    return notes.filter(F.col("note_sk") == note_sk).select("note_text")


def note_entities(entities: DataFrame, note_sk: int) -> DataFrame:
    """Mentions of one note, surest first."""
    return (
        entities.filter(F.col("note_sk") == note_sk)
        .orderBy(F.col("confidence").desc(), "entity_sk")
        .select("entity_type", "covered_text", "concept_code", "concept_display", "certainty", "negation",
                "temporality", "confidence")
        .limit(PAGE_SIZE)
    )
