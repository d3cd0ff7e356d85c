"""Queries on stored tables: loads, saved cohorts, refreshes, streams and extraction runs, each in a lake of its own below the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortloom.operators import ingest, workflow
from cohortloom.operators.cohort import MEMBER_COLUMNS
from cohortloom.operators.criteria import AllOf, CohortSpec, Criterion, Has, Not
from cohortloom.plans.cohorts import RECORD, RECORD_SQL
from cohortloom.plans.records import CONCEPTS, _identifier_lines, _patient_lines
from cohortloom.plans.registry import AS_OF, query, values_view
from cohortloom.schemas import TABLES
from cohortloom.session import checkpoint_folder
from cohortloom.sources.fixtures import clinical_view, load, with_views
from cohortloom.sources.lake import Lake
from cohortloom.streaming import capture

_RECORD_VIEWS = ("patient", "condition", "medication_order", "note_nlp_entity")
_STORED = ("patient", "condition", "medication_order", "observation", "note_nlp_entity", "clinical_note")


def _own_lake(spark, sf_dir: str, *tables: str) -> Lake:
    lake = Lake(spark, root=f"{checkpoint_folder(spark)}/lake-{uuid.uuid4().hex}")
    lake.create()
    for name, df in load(spark, sf_dir, *tables).items():
        lake.overwrite(df, name)
    return lake


@query("reloaded_patients", with_views("patient", then="""
SELECT patient_sk, mrn, birth_date, sex, deceased_flag, CASE WHEN patient_sk % 2 = 0 THEN 'New' ELSE 'Old' END AS city, state, 'English' AS primary_language,
       'clinic' AS source_system, CAST(patient_sk AS VARCHAR) AS source_id, 'Patient' AS source_table_or_resource FROM patient"""))
def reloaded_patients(spark, sf_dir):
    """A load, a write that fails half-way, a load of changed resources (as Bundles), and the first load again: the newest version of every key, with its source."""
    lake = _own_lake(spark, sf_dir)
    lines = _patient_lines(spark, sf_dir)
    patient = F.from_json("value", "id string, identifier array<struct<system:string,value:string>>, birthDate string, gender string, deceasedBoolean boolean, address array<struct<state:string>>")

    def lived_in(city: str):
        r = lines.select(patient.alias("r"))
        address = F.transform("r.address", lambda a: F.struct(F.lit(city).alias("city"), a["state"].alias("state")))
        return r.select(F.to_json(F.struct(F.lit("Patient").alias("resourceType"), "r.id", "r.identifier", "r.birthDate", "r.gender", "r.deceasedBoolean", address.alias("address"))).alias("value"))

    first, second = (f"{checkpoint_folder(spark)}/load-{uuid.uuid4().hex}" for _ in range(2))
    lived_in("Old").write.text(first)
    changed = lived_in("New").filter(F.get_json_object("value", "$.id").cast("long") % 2 == 0)
    changed.select(F.concat(F.lit('{"resourceType":"Bundle","entry":[{"resource":'), "value", F.lit("}]}")).alias("value")).write.text(second)
    workflow.load_resources(lake, first, "clinic", "b1")
    failing = lake.table("patient").withColumn("mrn", F.when(F.col("patient_sk") >= 0, F.raise_error(F.lit("fails half-way"))).otherwise(F.col("mrn")))
    try:
        lake.overwrite(failing, "patient", ordered=False)
    except Exception as error:
        if "fails half-way" not in str(error):
            raise
    workflow.load_resources(lake, second, "clinic", "b2")
    workflow.load_resources(lake, first, "clinic", "b1")
    return lake.table("patient").select(
        "patient_sk", "mrn", "birth_date", "sex", "deceased_flag", "city", "state", "primary_language", "source_system", "source_id", "source_table_or_resource")


@query("reloaded_identifiers", with_views("identifier", then="""
, kept AS (SELECT * FROM identifier WHERE source_key % 3 <> 0 OR (source_key % 2 = 1 AND identifier_type <> 'member_id'))
SELECT source_key AS patient_sk, identifier_type, identifier_value, assigning_authority, 'Patient' AS source_table_or_resource FROM kept"""))
def reloaded_identifiers(spark, sf_dir):
    """Identifiers after a load, a load in which every third patient has fewer (or none), and the first load again."""
    lake = _own_lake(spark, sf_dir)
    lines = _identifier_lines(spark, sf_dir)
    r = F.from_json("value", "id string, identifier array<struct<value:string,type:struct<text:string>,assigner:struct<display:string>>>")
    fewer = F.filter("r.identifier", lambda i: (F.col("r.id").cast("long") % 2 == 1) & (i["type"]["text"] != "member_id"))
    changed = lines.select(r.alias("r")).filter(F.col("r.id").cast("long") % 3 == 0).select(
        F.to_json(F.struct(F.lit("Patient").alias("resourceType"), F.col("r.id").alias("id"), fewer.alias("identifier"))).alias("value"))
    first, second = (f"{checkpoint_folder(spark)}/load-{uuid.uuid4().hex}" for _ in range(2))
    lines.write.text(first)
    changed.write.text(second)
    for folder, bundle in ((first, "b1"), (second, "b2"), (first, "b1")):
        workflow.load_resources(lake, folder, "clinic", bundle)
    return lake.table("patient_identifier").select(
        "patient_sk", "identifier_type", "identifier_value", "assigning_authority", "source_table_or_resource")


@query("stored_concepts", with_views("condition", then=", " + values_view("concept", "code_system, code, display, maps_to", CONCEPTS) + """
SELECT condition_sk, condition_code, 'Known as ' || display AS concept_display, maps_to
FROM condition LEFT JOIN concept ON code_system = 'ICD-10-CM' AND code = condition_code"""))
def stored_concepts(spark, sf_dir):
    """Codes looked up in the stored terminology, after its displays were changed by a second load."""
    lake = _own_lake(spark, sf_dir)
    rows = spark.createDataFrame(CONCEPTS, "code_system string, code string, display string, maps_to string").withColumn("concept_class", F.lit("code"))
    workflow.load_concepts(lake, rows)
    workflow.load_concepts(lake, rows.withColumn("display", F.concat(F.lit("Known as "), "display")))
    found = ingest.lookup_concepts(clinical_view(spark, sf_dir, "condition"), "condition_code", "ICD-10-CM", lake.table("concept"))
    return found.select("condition_sk", "condition_code", "concept_display", "maps_to")


@query("stored_cohort_versions", with_views(*_RECORD_VIEWS, then=f"""
, size AS (SELECT count(*) AS n_members FROM (SELECT DISTINCT patient_sk FROM ({RECORD_SQL}) AS m) AS d)
SELECT 'kept' AS name, v.version, v.status, n_members FROM size, (VALUES (1, 'archived'), (2, 'active')) AS v(version, status)"""))
def stored_cohort_versions(spark, sf_dir):
    """A cohort saved twice under one name, as its definitions, states and finished runs say."""
    lake = _own_lake(spark, sf_dir, *_STORED)
    for _ in range(2):
        workflow.save_cohort(lake, RECORD, "kept", "condition", "retrospective", as_of=AS_OF)
    runs = lake.table("cohort_run").select("cohort_sk", "n_members")
    return workflow.current_definitions(lake).join(runs, "cohort_sk").select("name", "version", "status", "n_members")


@query("refreshed_members", with_views(*_RECORD_VIEWS, then=RECORD_SQL))
def refreshed_members(spark, sf_dir):
    """Members after a cohort was saved over two thirds of the coded rows and refreshed from the rest alone."""
    lake = _own_lake(spark, sf_dir, *_STORED)
    parts = ("condition", "medication_order")
    for name in parts:
        lake.overwrite(clinical_view(spark, sf_dir, name).filter(F.col(TABLES[name].key) % 3 > 0), name)
    cohort_sk = workflow.save_cohort(lake, RECORD, "grows", "condition", "prospective", as_of=AS_OF)
    for name in parts:
        lake.append(clinical_view(spark, sf_dir, name).filter(F.col(TABLES[name].key) % 3 == 0), name)
    run_id = workflow.refresh_incremental(lake, cohort_sk, AS_OF)
    if lake.table("cohort_run").filter(F.col("run_id") == run_id).first()["based_on"] is None:
        raise ValueError("the refresh read all rows again")
    return lake.table("patient").join(workflow.current_members(lake, [cohort_sk]).select("patient_sk"), "patient_sk").select(*MEMBER_COLUMNS)


@query("streamed_members", with_views("patient", "condition", then="""
SELECT p.patient_sk, min(recorded_date) AS index_date, count(*) AS n_rows
FROM condition AS c JOIN (SELECT DISTINCT patient_sk FROM patient) AS p ON p.patient_sk = c.patient_sk
WHERE condition_code = 'E11.9' AND p.patient_sk NOT IN (SELECT patient_sk FROM condition WHERE condition_code = 'I50.9')
GROUP BY p.patient_sk"""))
def streamed_members(spark, sf_dir):
    """Members after two arrivals of files and a batch that came again."""
    spec = CohortSpec(
        [Criterion("t2dm", "condition", F.col("condition_code") == "E11.9"), Criterion("hf", "condition", F.col("condition_code") == "I50.9")],
        AllOf(Has("t2dm"), Not(Has("hf"))), F.lit(True))
    lake = _own_lake(spark, sf_dir)
    root = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    conditions = clinical_view(spark, sf_dir, "condition")
    for part in range(2):
        conditions.filter(F.col("condition_sk") % 2 == part).write.mode("append").parquet(f"{root}/in")
        arrived = capture.new_rows(spark, "condition", f"{root}/in")
        capture.merge_members(arrived, lake, "conditions", "condition", spec.criteria, f"{root}/checkpoint").awaitTermination()
    last = lake.table("captured_state").agg(F.max("batch")).first()[0]
    capture.fold_batch(lake, "conditions", "condition", spec.criteria, conditions, last)
    members = capture.streamed_members(lake, ["conditions"], clinical_view(spark, sf_dir, "patient"), spec)
    return members.select("patient_sk", "index_date", F.element_at("qualifying_evidence", 1)["n_rows"].alias("n_rows"))


@query("stored_extraction_runs", with_views("clinical_note", then="""
, total AS (SELECT count(*) AS n FROM clinical_note WHERE note_text IS NOT NULL)
SELECT 1 AS place, least(50, n) AS note_count FROM total UNION ALL SELECT 2, n - least(50, n) FROM total"""))
def stored_extraction_runs(spark, sf_dir):
    """Two extraction runs, the first over the 50 notes of the lowest keys: the second answers all the others."""
    lake = _own_lake(spark, sf_dir, "clinical_note")
    runs = [workflow.run_extraction(lake, max_notes=50), workflow.run_extraction(lake)]
    answered = lake.table("note_nlp_outcome").filter("outcome = 'ok'").groupBy("nlp_run_sk").agg(F.count("*").alias("note_count"))
    return answered.select(F.when(F.col("nlp_run_sk") == runs[0], 1).otherwise(2).alias("place"), "note_count")
