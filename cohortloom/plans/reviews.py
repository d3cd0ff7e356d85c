"""Queries on reviewing cohorts and exploring patients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import review, timeline
from cohortloom.operators.timeline import SECTIONS
from cohortloom.plans.registry import query
from cohortloom.sources.fixtures import clinical_view, load, with_views

MRN = "MRN-000042"

# --- cohorts -----------------------------------------------------------------------------------------


@query("kpi_row", with_views("patient", "encounter", "condition", "clinical_note", "cohort_definition", "cohort_member", then="""
SELECT (SELECT count(*) FROM patient) AS n_patients, (SELECT count(*) FROM encounter) AS n_encounters,
       (SELECT count(*) FROM condition) AS n_conditions, (SELECT count(*) FROM clinical_note) AS n_notes,
       (SELECT count(*) FROM cohort_definition) AS n_cohorts, (SELECT count(*) FROM cohort_member) AS n_members"""))
def kpi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.kpi_row(load(
        spark, sf_dir, "patient", "encounter", "condition", "clinical_note", "cohort_definition", "cohort_member"
    ))


_LIST_COLUMNS = """cd.cohort_sk, cd.name, cd.cohort_type, cd.cohort_category, cd.primary_concept_display, cd.status,
       cd.version, cd.created_by, cd.created_at"""


@query("cohort_list", with_views("cohort_definition", "cohort_member", then=f"""
SELECT {_LIST_COLUMNS}, count(cm.patient_sk) AS member_count
FROM cohort_definition AS cd LEFT JOIN cohort_member AS cm ON cd.cohort_sk = cm.cohort_sk
GROUP BY ALL"""))
def cohort_list(spark, sf_dir):
    """All definitions; the one without members counts zero."""
    tables = load(spark, sf_dir, "cohort_definition", "cohort_member")
    return review.cohort_list(tables["cohort_definition"], tables["cohort_member"], statuses=())


@query("cohort_list_filtered", with_views("cohort_definition", "cohort_member", then=f"""
SELECT {_LIST_COLUMNS}, count(cm.patient_sk) AS member_count
FROM cohort_definition AS cd LEFT JOIN cohort_member AS cm ON cd.cohort_sk = cm.cohort_sk
WHERE cohort_type IN ('condition', 'exposure', 'operational') AND cohort_category IN ('retrospective') AND status IN ('active')
GROUP BY ALL"""))
def cohort_list_filtered(spark, sf_dir):
    tables = load(spark, sf_dir, "cohort_definition", "cohort_member")
    return review.cohort_list(
        tables["cohort_definition"], tables["cohort_member"], ("condition", "exposure", "operational"), ("retrospective",)
    )


@query("recent_cohorts", with_views("definition_library", then="""
SELECT cohort_sk, name, cohort_type, cohort_category, status, created_by, created_at
FROM definition_library ORDER BY created_at DESC, cohort_sk DESC LIMIT 10"""))
def recent_cohorts(spark, sf_dir):
    return review.recent_cohorts(clinical_view(spark, sf_dir, "definition_library"))


_MEMBER_SQL = """
SELECT p.patient_sk, p.mrn, p.birth_date, p.sex, p.race, p.state, cm.index_date, cm.qualifying_source
FROM cohort_member AS cm JOIN patient AS p ON cm.patient_sk = p.patient_sk
WHERE cm.cohort_sk = 2 ORDER BY p.mrn, p.patient_sk LIMIT """


@query("cohort_member_page", with_views("cohort_member", "patient", then=_MEMBER_SQL + "50"))
def cohort_member_page(spark, sf_dir):
    tables = load(spark, sf_dir, "cohort_member", "patient")
    return review.member_page(tables["cohort_member"], tables["patient"], 2)


@query("cohort_export", with_views("cohort_member", "patient", then=_MEMBER_SQL.removesuffix(" LIMIT ")))
def cohort_export(spark, sf_dir):
    tables = load(spark, sf_dir, "cohort_member", "patient")
    return review.export_rows(tables["cohort_member"], tables["patient"], 2)


@query("cohort_condition_listing", with_views("cohort_member", "patient", "condition", then="""
SELECT mrn, condition_code, clinical_status, recorded_date, category
FROM (SELECT p.mrn, c.condition_code, c.clinical_status, c.recorded_date, c.category, c.condition_sk
      FROM cohort_member AS cm JOIN patient AS p ON cm.patient_sk = p.patient_sk JOIN condition AS c ON cm.patient_sk = c.patient_sk
      WHERE cm.cohort_sk = 0 ORDER BY c.recorded_date DESC, c.condition_sk DESC LIMIT 200) AS t"""))
def cohort_condition_listing(spark, sf_dir):
    tables = load(spark, sf_dir, "cohort_member", "patient", "condition")
    return review.condition_listing(tables["cohort_member"], tables["patient"], tables["condition"], 0)


@query("definition_detail", with_views("definition_library", then="\nSELECT * FROM definition_library WHERE cohort_sk = 17"))
def definition_detail(spark, sf_dir):
    return review.definition_detail(clinical_view(spark, sf_dir, "definition_library"), 17)


# --- timelines -----------------------------------------------------------------------------------------


@query("patient_lookup", with_views("patient", then=f"\nSELECT * FROM patient WHERE mrn = '{MRN}' LIMIT 1"))
def patient_lookup(spark, sf_dir):
    return timeline.find_patient(clinical_view(spark, sf_dir, "patient"), f"  {MRN} ")


# Columns of each section that the clinical views hold.
_SECTION_COLUMNS = {
    "encounter": "encounter_sk, encounter_class, encounter_type, status, period_start, period_end, attending_provider_name, facility_name",
    "condition": "condition_sk, condition_code, category, clinical_status, is_chronic, onset_date, recorded_date, resolved_date",
    "observation": "observation_sk, category, observation_code, value_numeric, value_string, effective_datetime, parent_observation_sk",
    "medication_order": "med_order_sk, med_code, order_status, start_datetime, end_datetime",
    "procedure": "procedure_sk, procedure_code, procedure_category, status, performed_datetime",
    "clinical_note": "note_sk, note_category, author_name, service_date, status",
}


def _register_section(table: str) -> None:
    what = SECTIONS[table]
    top_level = " AND parent_observation_sk IS NULL" if table == "observation" else ""

    @query(f"timeline_{table}", with_views("patient", table, then=f"""
SELECT patient_sk, {_SECTION_COLUMNS[table]}
FROM {table} AS t
WHERE t.patient_sk IN (SELECT patient_sk FROM patient WHERE mrn = '{MRN}'){top_level}
ORDER BY {what.time} DESC NULLS LAST, {what.key} DESC LIMIT {what.limit}"""))
    def one_patient(spark, sf_dir):
        """Newest rows of one table for the patient with this MRN."""
        tables = load(spark, sf_dir, "patient", table)
        rows = timeline.section_by_mrn(tables["patient"], tables[table], table, MRN)
        return rows.select("patient_sk", *[column for column in SECTIONS[table].columns if column in rows.columns])

    @query(f"timelines_{table}", with_views(table, then=f"""
SELECT patient_sk, {_SECTION_COLUMNS[table]}
FROM (SELECT *, row_number() OVER (PARTITION BY patient_sk ORDER BY {what.time} DESC NULLS LAST, {what.key} DESC) AS rn
      FROM {table} WHERE true{top_level}) AS t
WHERE rn <= 3"""))
    def all_patients(spark, sf_dir):
        """Newest three rows of one table for every patient."""
        return timeline.section_for_patients(clinical_view(spark, sf_dir, table), table, k=3)


for _table in SECTIONS:
    _register_section(_table)


@query("lab_vital_counts", with_views("observation", then="""
SELECT patient_sk, count(*) FILTER (WHERE category = 'laboratory') AS n_labs,
       count(*) FILTER (WHERE category = 'vital-signs') AS n_vitals
FROM observation WHERE parent_observation_sk IS NULL GROUP BY patient_sk"""))
def lab_vital_counts(spark, sf_dir):
    top_level = clinical_view(spark, sf_dir, "observation").filter(F.col("parent_observation_sk").isNull())
    return top_level.groupBy("patient_sk").agg(
        F.count_if(F.col("category") == "laboratory").alias("n_labs"),
        F.count_if(F.col("category") == "vital-signs").alias("n_vitals"),
    )


@query("lab_and_vital_rows", with_views("observation", then="""
SELECT 'labs' AS part, patient_sk, observation_sk FROM observation WHERE category = 'laboratory' AND parent_observation_sk IS NULL
UNION ALL
SELECT 'vitals', patient_sk, observation_sk FROM observation WHERE category = 'vital-signs' AND parent_observation_sk IS NULL"""))
def lab_and_vital_rows(spark, sf_dir):
    top_level = clinical_view(spark, sf_dir, "observation").filter(F.col("parent_observation_sk").isNull())
    labs = timeline.labs(top_level).select(F.lit("labs").alias("part"), "patient_sk", "observation_sk")
    return labs.unionByName(timeline.vitals(top_level).select(F.lit("vitals").alias("part"), "patient_sk", "observation_sk"))


@query("diagnosis_status_counts", with_views("condition", then="""
SELECT patient_sk, count(*) AS n_total, count(*) FILTER (WHERE clinical_status = 'active') AS n_active,
       count(*) FILTER (WHERE clinical_status = 'resolved') AS n_resolved
FROM condition GROUP BY patient_sk"""))
def diagnosis_status_counts(spark, sf_dir):
    return timeline.diagnosis_counts(clinical_view(spark, sf_dir, "condition"))


@query("active_medications", with_views("medication_order", then="""
SELECT patient_sk, med_order_sk, med_code, start_datetime FROM medication_order WHERE order_status = 'active'"""))
def active_medications(spark, sf_dir):
    active = timeline.active_medications(clinical_view(spark, sf_dir, "medication_order"))
    return active.select("patient_sk", "med_order_sk", "med_code", "start_datetime")


@query("lab_trend", with_views("patient", "observation", then=f""", own AS (
  SELECT o.* FROM observation AS o JOIN patient AS p ON o.patient_sk = p.patient_sk
  WHERE p.mrn = '{MRN}' AND category = 'laboratory' AND parent_observation_sk IS NULL)
SELECT observation_sk, observation_code, effective_datetime, value_numeric FROM own
WHERE value_numeric IS NOT NULL
  AND observation_code = (SELECT observation_code FROM own ORDER BY effective_datetime DESC, observation_sk DESC LIMIT 1)"""))
def lab_trend(spark, sf_dir):
    """Trend of the code of the patient's newest lab result."""
    tables = load(spark, sf_dir, "patient", "observation")
    key = timeline.patient_key(tables["patient"], MRN)
    return timeline.lab_trend(timeline.rows_of_patient(tables["observation"], key))


@query("note_entities", with_views("note_nlp_entity", then="""
SELECT entity_type, covered_text, concept_code, concept_display, certainty, negation, temporality, confidence
FROM note_nlp_entity WHERE note_sk = 42 ORDER BY confidence DESC, entity_sk LIMIT 50"""))
def note_entities(spark, sf_dir):
    return timeline.note_entities(clinical_view(spark, sf_dir, "note_nlp_entity"), 42)


@query("note_text_by_key", with_views("clinical_note", then="\nSELECT note_text FROM clinical_note WHERE note_sk = 42"))
def note_text_by_key(spark, sf_dir):
    return timeline.note_text(clinical_view(spark, sf_dir, "clinical_note"), 42)
