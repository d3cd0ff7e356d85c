"""Cohort membership: building, previewing, index dates, provenance, windows, controls."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import clinical, codes
from cohortloom.operators.criteria import AllOf, CohortSpec, CriteriaRecord, Has, Not, cohort_spec
from cohortloom.operators.evidence import criterion_state, evidence_rows, state_and_evidence, trigger_rows
from cohortloom.schemas import PAGE_SIZE, TRIGGER

MEMBER_COLUMNS = ("patient_sk", "mrn", "birth_date", "sex", "race")
Tables = Mapping[str, DataFrame]


def evaluate(tables: Tables, spec: CohortSpec, state: DataFrame | None = None) -> DataFrame:
    """Patients that meet the cohort, with their criterion state.

    `state` may come from stored evidence rows; else the clinical tables are scanned for it.

    Patients without any evidence are kept in only where the expression can hold without it (for
    example a cohort of exclusions); otherwise an inner join lets the small side drive.
    """
    patients = tables["patient"].filter(spec.patient_filter)
    if not spec.criteria:
        return patients
    if state is None:
        state = criterion_state(tables, spec.criteria)
    how = "left" if spec.expression.met_without_evidence() else "inner"
    return patients.join(state, "patient_sk", how).filter(spec.expression.met())


def build_cohort(tables: Tables, spec: CohortSpec) -> DataFrame:
    """Member list: key, MRN, birth date, sex, race; one row for a patient whose row repeats."""
    return evaluate(tables, spec).select(*MEMBER_COLUMNS).distinct()


def cohort_size(members: DataFrame) -> DataFrame:
    return members.agg(F.count("*").alias("n"))


def preview(members: DataFrame, rows: int = PAGE_SIZE) -> DataFrame:
    return members.orderBy("patient_sk").limit(rows)


def qualifying_source(spec: CohortSpec) -> Column:
    """coded / nlp / both, from the criteria that the patient meets and that speak for membership."""
    wanted = set(spec.expression.required())

    def met(source: str) -> Column:
        column = F.lit(False)
        for criterion in spec.criteria:
            if criterion.source == source and criterion.id in wanted:
                column = column | Has(criterion.id).met()
        return column

    return F.when(met("coded") & met("nlp"), "both").when(met("nlp"), "nlp").otherwise("coded")


def qualified_members(tables: Tables, spec: CohortSpec, state: DataFrame | None = None) -> DataFrame:
    """Members with the date on which all entry criteria first held and how they qualified."""
    first = spec.expression.first_met()
    index_date = F.lit(None).cast("date") if first is None else first
    return evaluate(tables, spec, state).select(
        "patient_sk", index_date.alias("index_date"),
        (qualifying_source(spec) if spec.criteria else F.lit("coded")).alias("qualifying_source"),
    )


def member_evidence(tables: Tables, spec: CohortSpec, members: DataFrame) -> DataFrame:
    """All rows that support the members' inclusion criteria."""
    wanted = set(spec.expression.required())
    criteria = [criterion for criterion in spec.criteria if criterion.id in wanted]
    return evidence_rows(tables, criteria).join(members.select("patient_sk"), "patient_sk", "left_semi")


def members_with_evidence(tables: Tables, spec: CohortSpec, rows: DataFrame | None = None) -> DataFrame:
    """Members with index date, source and the array of triggering rows.

    The triggers (one row per patient and criterion) say all that membership needs, so the evidence is
    read once. `rows` may be stored evidence rows of all criteria.
    """
    if not spec.criteria:
        return qualified_members(tables, spec).dropDuplicates(["patient_sk"]).withColumn("qualifying_evidence", F.lit(None).cast(TRIGGER))
    return members_from_triggers(tables, spec, trigger_rows(evidence_rows(tables, spec.criteria) if rows is None else rows))


def members_from_triggers(tables: Tables, spec: CohortSpec, triggers: DataFrame) -> DataFrame:
    """The same from one row per patient and criterion (the row that first met it, and how many did); one row for a patient whose row repeats."""
    state = state_and_evidence(triggers, spec.criteria, spec.expression.required())
    first = spec.expression.first_met()
    return evaluate(tables, spec, state).select(
        "patient_sk", (F.lit(None).cast("date") if first is None else first).alias("index_date"),
        qualifying_source(spec).alias("qualifying_source"), "qualifying_evidence",
    ).dropDuplicates(["patient_sk"])


def events_around_index(
    members: DataFrame, events: DataFrame, event_day: Column, lookback: int | Column | None, follow_up: int | Column | None
) -> DataFrame:
    """Events of members within look-back and follow-up days of their index date; None is open."""

    joined = members.select("patient_sk", "index_date").join(events, "patient_sk")
    if lookback is not None:
        days = F.lit(lookback) if isinstance(lookback, int) else lookback
        joined = joined.filter(days.isNull() | (F.datediff("index_date", event_day) <= days))
    if follow_up is not None:
        days = F.lit(follow_up) if isinstance(follow_up, int) else follow_up
        joined = joined.filter(days.isNull() | (F.datediff(event_day, "index_date") <= days))
    return joined


def of_age_at_index(members: DataFrame, patients: DataFrame, min_age: float | None, max_age: float | None) -> DataFrame:
    """Members whose age on their index date lies within the bounds."""
    aged = members.join(patients.select("patient_sk", "birth_date"), "patient_sk").withColumn(
        "age_at_index", clinical.age_years(F.col("birth_date"), F.col("index_date"))
    )
    if min_age is not None:
        aged = aged.filter(F.col("age_at_index") >= min_age)
    if max_age is not None:
        aged = aged.filter(F.col("age_at_index") <= max_age)
    return aged.drop("birth_date")


def control_spec(record: CriteriaRecord, as_of=None) -> CohortSpec:
    """Patients of the same demographics without any of the conditions and exposures of the case cohort."""
    case = cohort_spec(record, as_of)
    return CohortSpec(case.criteria, AllOf(*[Not(Has(criterion.id)) for criterion in case.criteria]), case.patient_filter)


def control_cohort(tables: Tables, record: CriteriaRecord, as_of=None) -> DataFrame:
    return build_cohort(tables, control_spec(record, as_of))


def three_way_cohort(conditions: DataFrame, medications: DataFrame, as_of, days: int = 730) -> DataFrame:
    """Type 2 diabetes, on metformin, and cardiovascular disease recorded within the last days.

    The two condition sets come from one scan; there is no join, only one aggregation per patient.
    """
    as_of = clinical.as_date(as_of)
    recent_cvd = F.col("condition_code").isin(codes.CVD_ICD10) & (F.col("recorded_date") >= F.date_sub(as_of, days))
    t2dm = F.col("condition_code") == "E11.9"
    flags = (
        conditions.filter(t2dm | recent_cvd)
        .select("patient_sk", t2dm.alias("t2dm"), F.lit(False).alias("metformin"), recent_cvd.alias("cvd"))
        .unionByName(
            medications.filter(F.col("med_code").isin(codes.METFORMIN))
            .select("patient_sk", F.lit(False).alias("t2dm"), F.lit(True).alias("metformin"), F.lit(False).alias("cvd"))
        )
    )
    return (
        flags.groupBy("patient_sk")
        .agg(*[F.bool_or(name).alias(name) for name in ("t2dm", "metformin", "cvd")])
        .filter("t2dm AND metformin AND cvd")
        .select("patient_sk")
    )
