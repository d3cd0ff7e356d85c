"""Jobs that write: tables, cohorts, extraction runs, exports, streaming capture."""

import base64
import csv
import glob
import hashlib
import json
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import criteria, ingest, notes, timeline, workflow
from cohortloom.operators.cohort import build_cohort, qualified_members
from cohortloom.operators.criteria import AllOf, CohortSpec, Criterion, CriteriaRecord, Has, Not, cohort_spec
from cohortloom.operators.criteria_sql import cohort_sql
from cohortloom.plans.cohorts import FIRST, LAST
from cohortloom.schemas import TABLES
from cohortloom.sources.fixtures import load
from cohortloom.sources.lake import Lake, conform, export_folder, without_internal_columns
from cohortloom.sources.snapshots import Conflict
from cohortloom.streaming import capture

AS_OF = "2001-12-31"
FILLED = ("patient", "encounter", "condition", "medication_order", "procedure", "observation", "clinical_note")
RECORD = CriteriaRecord(icd_codes="E11.9", date_from=FIRST, date_to=LAST, min_age=18, max_age=95)


@pytest.fixture(scope="module")
def lake(spark, sf_dir):
    lake = Lake(spark)
    lake.create()
    for name, df in load(spark, sf_dir, *FILLED).items():
        lake.overwrite(df, name)
    return lake


@pytest.fixture(scope="module")
def saved(lake):
    return workflow.save_cohort(lake, RECORD, "O'Brien's T2DM", "condition", "retrospective", "analyst", as_of=AS_OF)


def test_written_tables_have_the_declared_schema(lake):
    for name in FILLED:
        got = lake.table(name)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in TABLES[name].schema]
    assert lake.table("patient").select("primary_language").distinct().first()[0] == "English"
    assert lake.table("condition").filter("condition_system <> 'ICD-10-CM' OR loaded_at IS NULL").count() == 0


def test_overwrite_reports_rows_and_drops_internal_columns(lake, spark):
    df = spark.range(3).select(F.col("id").alias("procedure_sk"), F.lit(1).alias("patient_sk"), F.lit("x").alias("_phenotype"), F.lit(None).alias("status"))
    assert without_internal_columns(df).columns == ["procedure_sk", "patient_sk", "status"]
    assert without_internal_columns(df).schema["status"].dataType.simpleString() == "string"
    assert conform(df, TABLES["procedure"]).columns == TABLES["procedure"].schema.names
    before = lake.table("procedure").toPandas()
    assert lake.overwrite(df, "procedure") == 3
    lake.overwrite(lake.spark.createDataFrame(before, TABLES["procedure"].schema), "procedure")


def test_hot_patient_is_spread_over_files(spark):
    lake = Lake(spark, {"bronze": "hot_bronze", "silver": "hot_silver", "gold": "hot_gold"})
    lake.create()
    rows = spark.range(40000).select(
        F.col("id").alias("condition_sk"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("patient_sk"),
        F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 5000).cast("int")).alias("recorded_date"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    lake.overwrite(rows, "condition")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = lake.table("condition").filter("patient_sk = 7").select(F.input_file_name()).distinct().count()
    assert files > 1


def test_query_with_named_parameters(lake):
    rows = lake.query("SELECT count(*) AS n FROM {patient} WHERE sex = :sex AND mrn <> :mrn", sex="male", mrn="x' OR '1'='1")
    assert rows.first().n == 75


def test_saved_cohort(lake, saved):
    definition = workflow.current_definitions(lake).filter(F.col("cohort_sk") == saved).first()
    assert (definition.version, definition.status, definition.primary_concept_code, definition.primary_concept_system) == (1, "active", "E11.9", "ICD-10-CM")
    assert CriteriaRecord.from_json(definition.definition_logic) == RECORD
    members = workflow.current_members(lake).filter(F.col("cohort_sk") == saved)
    n = lake.table("cohort_run").filter(F.col("cohort_sk") == saved).first().n_members
    assert members.count() == n > 0
    assert members.filter("index_date IS NULL OR qualifying_source <> 'coded' OR size(qualifying_evidence) <> 1").count() == 0
    evidence = workflow.run_evidence(lake, saved)
    totals = members.select(F.explode("qualifying_evidence").alias("e")).agg(F.sum("e.n_rows")).first()[0]
    assert evidence.count() == totals
    index = members.join(evidence, "patient_sk").groupBy("patient_sk").agg(F.min("event_date").alias("d"), F.first("index_date").alias("i"))
    assert index.filter("d <> i").count() == 0


def test_saving_again_makes_a_version_and_archives_the_old(lake, saved):
    second = workflow.save_cohort(lake, RECORD, "O'Brien's T2DM", "condition", "retrospective", as_of=AS_OF)
    found = {r.cohort_sk: (r.version, r.status) for r in workflow.current_definitions(lake).filter("name = \"O'Brien's T2DM\"").collect()}
    assert found == {saved: (1, "archived"), second: (2, "active")}


def test_status_change(lake):
    cohort_sk = workflow.save_cohort(lake, RECORD, "status", "condition", "retrospective", as_of=AS_OF)
    workflow.change_status(lake, cohort_sk, "draft")
    assert workflow.current_definitions(lake).filter(F.col("cohort_sk") == cohort_sk).first().status == "draft"
    with pytest.raises(ValueError):
        workflow.change_status(lake, cohort_sk, "gone")


def test_refresh_without_new_data_keeps_everybody(lake, saved):
    changes = {r.change for r in workflow.refresh_cohort(lake, saved, AS_OF).select("change").distinct().collect()}
    assert changes == {"kept"}
    assert lake.table("cohort_run").filter(F.col("cohort_sk") == saved).count() == 2
    n = workflow.current_members(lake).filter(F.col("cohort_sk") == saved)
    assert n.count() == n.select("patient_sk").distinct().count()


def test_unfinished_run_is_not_read(lake, saved):
    before = workflow.current_members(lake).count()
    broken = workflow.current_members(lake).limit(3).withColumn("run_id", F.lit("broken"))
    lake.append(broken, "cohort_member", cohort_sk=saved, run_id="broken")
    assert workflow.current_members(lake).count() == before


def test_refresh_sees_gains_and_losses(lake, spark):
    cohort_sk = workflow.save_cohort(lake, RECORD, "moving", "condition", "prospective", as_of="1945-01-01")
    changes = {r.change: r["count"] for r in workflow.refresh_cohort(lake, cohort_sk, AS_OF).groupBy("change").count().collect()}
    assert changes.get("added", 0) > 0


def test_nightly_refresh_reads_each_table_once(lake, spark):
    other = CriteriaRecord(icd_codes="I10", exc_icd="I50.9", date_from=FIRST, date_to=LAST)
    first = workflow.save_cohort(lake, RECORD, "nightly 1", "condition", "prospective", as_of=AS_OF)
    second = workflow.save_cohort(lake, other, "nightly 2", "condition", "prospective", as_of=AS_OF)
    workflow.change_status(lake, workflow.save_cohort(lake, other, "asleep", "condition", "prospective", as_of=AS_OF), "draft")
    before = {sk: workflow.current_members(lake).filter(F.col("cohort_sk") == sk).count() for sk in (first, second)}
    changes = workflow.refresh_prospective(lake, AS_OF).groupBy("cohort_sk", "change").count().collect()
    done = {(r.cohort_sk, r.change): r["count"] for r in changes}
    assert done[(first, "kept")] == before[first] and done[(second, "kept")] == before[second]
    assert lake.table("cohort_run").filter(F.col("cohort_sk") == second).count() == 2
    sizes = {r.name: r.n for r in workflow.current_definitions(lake).join(lake.table("cohort_run"), "cohort_sk").groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert sizes["asleep"] == 1


def test_events_within_the_windows_of_the_definition(lake):
    cohort_sk = workflow.save_cohort(lake, RECORD, "windows", "condition", "retrospective", as_of=AS_OF, lookback_days=30)
    events = workflow.member_events(lake, cohort_sk, "medication_order")
    assert events.count() > 0
    assert events.filter("datediff(index_date, CAST(start_datetime AS DATE)) > 30").count() == 0
    assert events.filter("datediff(CAST(start_datetime AS DATE), index_date) > 365").count() > 0  # follow-up is open


def test_csv_export(lake, saved):
    folder = tempfile.mkdtemp(prefix="run-export-", dir="/tmp")
    path = workflow.export_members(lake, saved, folder)
    assert path.endswith(export_folder(saved, "O'Brien's T2DM")) and "O'Brien's_T2DM" in path
    (file,) = glob.glob(f"{path}/*.csv")
    rows = list(csv.DictReader(open(file)))
    assert [r["mrn"] for r in rows] == sorted(r["mrn"] for r in rows)
    assert len(rows) == workflow.current_members(lake).filter(F.col("cohort_sk") == saved).count()


def test_bundle_export(lake, saved):
    folder = tempfile.mkdtemp(prefix="run-export-", dir="/tmp") + "/bundles"
    workflow.export_bundles(lake, saved, folder)
    bundles = [json.loads(line) for file in glob.glob(f"{folder}/*.txt") for line in open(file)]
    assert len(bundles) == workflow.current_members(lake).filter(F.col("cohort_sk") == saved).count()
    for bundle in bundles:
        kinds = [entry["resource"]["resourceType"] for entry in bundle["entry"]]
        assert kinds == ["Patient", "Condition"]


def test_extraction_run_is_resumable(lake):
    n_notes = lake.table("clinical_note").count()
    first = workflow.run_extraction(lake, max_notes=50)
    assert lake.table("note_nlp_outcome").filter(F.col("nlp_run_sk") == first).count() == 50
    second = workflow.run_extraction(lake)
    assert lake.table("note_nlp_outcome").filter(F.col("nlp_run_sk") == second).count() == n_notes - 50
    third = workflow.run_extraction(lake)
    assert lake.table("note_nlp_outcome").filter(F.col("nlp_run_sk") == third).count() == 0
    entities = lake.table("note_nlp_entity")
    assert entities.select("entity_sk").distinct().count() == entities.count()
    empty = lake.table("note_nlp_outcome").filter("n_entities = 0")
    assert empty.count() > 0  # notes without a mention are done as well
    ledger = notes.run_ledger(lake.table("nlp_run")).filter(F.col("nlp_run_sk") == second).first()
    assert ledger.run_started_at is not None and ledger.run_finished_at >= ledger.run_started_at and ledger.note_count == n_notes - 50
    assert notes.run_summary(entities, second).count() > 0


def test_failed_notes_are_asked_again_and_total_failure_raises(lake, spark):
    other = Lake(spark, {"bronze": "fail_bronze", "silver": "fail_silver", "gold": "fail_gold"})
    other.create()
    other.overwrite(lake.table("clinical_note").limit(10), "clinical_note")

    def all_fail(batches):
        for batch in batches:
            yield pd.DataFrame({"note_sk": batch.note_sk, "outcome": "refused", "entities": None})

    def half_fail(batches):
        for batch in batches:
            ok = batch.note_sk % 2 == 0
            yield pd.DataFrame({"note_sk": batch.note_sk, "outcome": ok.map({True: "ok", False: "truncated"}), "entities": [[] if o else None for o in ok]})

    with pytest.raises(notes.ExtractionFailed):
        workflow.run_extraction(other, lambda todo: notes.run_user_function(todo, all_fail))
    workflow.run_extraction(other, lambda todo: notes.run_user_function(todo, half_fail))
    done = other.table("note_nlp_outcome").filter("outcome = 'ok'")
    left = notes.unprocessed_notes(other.table("clinical_note"), other.table("note_nlp_entity"), done)
    assert left.count() == 10 - done.count() and left.filter("note_sk % 2 = 0").count() == 0


def test_notes_and_codes_together(lake):
    record = CriteriaRecord(icd_codes="E11.9,I10", date_from=FIRST, date_to=LAST, nlp_terms="diabetes, pneumonia", nlp_patient_only=True)
    cohort_sk = workflow.save_cohort(lake, record, "both", "condition", "retrospective", as_of=AS_OF)
    members = workflow.current_members(lake).filter(F.col("cohort_sk") == cohort_sk)
    assert members.count() > 0 and members.filter("qualifying_source <> 'both' OR index_date IS NULL").count() == 0


def test_features(lake):
    assert workflow.build_features(lake, AS_OF) == lake.table("patient").count()
    assert lake.table("patient_feature").filter("feature_asof_date <> DATE '2001-12-31'").count() == 0


def test_streaming_capture_equals_batch(lake, spark):
    spec = CohortSpec(
        [
            Criterion("t2dm", "condition", criteria.condition_matches(["E11.9"], ["active"], FIRST, LAST)),
            Criterion("hf", "condition", F.col("condition_code") == "I50.9"),
        ],
        AllOf(Has("t2dm"), Not(Has("hf"))), F.lit(True),
    )
    root = tempfile.mkdtemp(prefix="run-stream-", dir="/tmp")
    conditions = lake.table("condition")
    for part in range(3):
        conditions.filter(F.col("condition_sk") % 3 == part).write.mode("append").parquet(f"{root}/in")
        rows = capture.new_rows(spark, "condition", f"{root}/in")
        capture.capture_evidence(rows, "condition", spec.criteria, f"{root}/evidence", f"{root}/checkpoint").awaitTermination()
    streamed = capture.members_from_evidence(spark.read.parquet(f"{root}/evidence"), lake.table("patient"), spec)
    batch = qualified_members({"patient": lake.table("patient"), "condition": conditions}, spec)
    same = streamed.select("patient_sk", "index_date", "qualifying_source")
    assert same.count() > 0 and same.exceptAll(batch).count() == 0 and batch.exceptAll(same).count() == 0


def test_control_cohort_is_linked_and_disjoint(lake, saved):
    control = workflow.save_control(lake, saved, "no T2DM", AS_OF)
    definition = workflow.current_definitions(lake).filter(F.col("cohort_sk") == control).first()
    assert (definition.cohort_type, definition.comparison_cohort_sk) == ("control", saved)
    members = workflow.current_members(lake)
    cases, controls = members.filter(F.col("cohort_sk") == saved), members.filter(F.col("cohort_sk") == control)
    assert controls.count() > 0 and cases.join(controls, "patient_sk").count() == 0
    assert {r.change for r in workflow.refresh_cohort(lake, control, AS_OF).collect()} == {"kept"}


def test_preview_shows_size_sample_and_query(lake):
    record = CriteriaRecord(
        icd_codes="e11.9, I10", icd_status=["active", "resolved"], med_codes="860975", lab_code="", nlp_terms="it's, 50%", nlp_concept="E11.9",
        exc_icd="I63.9", exc_meds="617312", date_from=FIRST, date_to=LAST, min_age=18, max_age=95, sex_filter=["male"],
    )
    n, sample, text = workflow.preview(lake, record, AS_OF)
    assert sample.count() == min(n, 50) and "NOT IN" in text and "it's" not in text
    for changed in (record, CriteriaRecord(lab_code="4548-4", lab_min=6.5, date_from=FIRST, date_to=LAST), RECORD):
        text, parameters = cohort_sql(changed, AS_OF)
        by_sql = lake.query(text, **parameters)
        by_builder = build_cohort(workflow._clinical_tables(lake), cohort_spec(changed, AS_OF))
        assert by_sql.exceptAll(by_builder).count() == 0 and by_builder.exceptAll(by_sql).count() == 0


def test_filters_and_columns_reach_the_scan(lake):
    lake.spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    tables = lake.tables("patient", "condition", "medication_order", "observation")
    record = CriteriaRecord(icd_codes="E11.9", med_codes="860975", lab_code="4548-4", lab_min=6.5, date_from=FIRST, date_to=LAST)
    plan = build_cohort(tables, cohort_spec(record, AS_OF))._jdf.queryExecution().executedPlan().toString()
    scans = {name: next(line for line in plan.splitlines() if "FileScan" in line and f"/{name}/data" in line) for name in tables}
    assert "In(condition_code" in scans["condition"] or "EqualTo(condition_code" in scans["condition"]
    assert "GreaterThanOrEqual(recorded_date" in scans["condition"]
    assert "GreaterThanOrEqual(start_datetime" in scans["medication_order"] and "LessThan(start_datetime" in scans["medication_order"]
    assert "GreaterThanOrEqual(value_numeric,6.5)" in scans["observation"] and "GreaterThanOrEqual(effective_datetime" in scans["observation"]
    assert "condition_display" not in scans["condition"] and "unit" not in scans["observation"].split("ReadSchema")[1]


def test_resources_are_landed_and_conformed(lake, spark):
    other = Lake(spark, {"bronze": "fhir_bronze", "silver": "fhir_silver", "gold": "fhir_gold"})
    other.create()
    folder = tempfile.mkdtemp(prefix="run-fhir-", dir="/tmp")
    lines = [
        {"resourceType": "Patient", "id": "p-1", "identifier": [{"system": "mrn", "value": "M1"}], "birthDate": "1950-02-03", "gender": "female"},
        {"resourceType": "Encounter", "id": "e-1", "subject": {"reference": "Patient/p-1"}, "status": "finished", "class": {"code": "IMP"}, "period": {"start": "2001-01-02T03:04:05+02:00", "end": "2001-01-02T03:04:05Z"}},
        {"resourceType": "Condition", "id": "c-1", "subject": {"reference": "Patient/p-1"}, "encounter": {"reference": "Encounter/e-1"}, "code": {"coding": [{"code": "E11.9"}]}, "clinicalStatus": {"coding": [{"code": "active"}]}, "recordedDate": "2001-01-02"},
        {"resourceType": "Observation", "id": "o-1", "subject": {"reference": "Patient/p-1"}, "code": {"coding": [{"code": "85354-9"}]}, "category": [{"coding": [{"code": "vital-signs"}]}], "component": [{"code": {"coding": [{"code": "8480-6"}]}, "valueQuantity": {"value": 120}}]},
        {"resourceType": "MedicationRequest", "id": "m-1", "subject": {"reference": "Patient/p-1"}, "status": "stopped", "medicationCodeableConcept": {"coding": [{"code": "860975"}]}},
        {"resourceType": "Procedure", "id": "x-1", "subject": {"reference": "Patient/p-1"}, "code": {"coding": [{"code": "93000"}]}, "status": "completed"},
        {"resourceType": "DocumentReference", "id": "d-1", "subject": {"reference": "Patient/p-1"}, "content": [{"attachment": {"contentType": "text/plain", "data": "Tm8gZmV2ZXIu"}}]},
    ]
    with open(f"{folder}/a.ndjson", "w") as file:
        file.write("\n".join(map(json.dumps, lines)))
    counts = workflow.load_resources(other, folder, "clinic", "b1")
    assert counts == {"raw_quarantine": 0, "patient": 1, "encounter": 1, "condition": 1, "observation": 2, "medication_order": 1, "procedure": 1, "clinical_note": 1}
    patient_sk = other.table("patient").first().patient_sk
    for table in ("encounter", "condition", "observation", "medication_order", "procedure", "clinical_note"):
        assert other.table(table).filter(F.col("patient_sk") != patient_sk).count() == 0
    assert other.table("condition").join(other.table("encounter"), "encounter_sk").count() == 1
    visit = other.table("encounter").select(F.date_format("period_start", "HH:mm"), F.date_format("period_end", "HH:mm")).first()
    assert tuple(visit) == ("01:04", "03:04")
    panel = other.table("observation").filter("observation_code = '85354-9'").first().observation_sk
    assert other.table("observation").filter("value_numeric = 120").first().parent_observation_sk == panel
    assert other.table("medication_order").first().order_status == "discontinued"
    assert other.table("clinical_note").first().note_text == "No fever."
    loaded = other.table("observation").select(*ingest.PROVENANCE[:3]).distinct().collect()
    assert [tuple(r) for r in loaded] == [("clinic", "o-1", "Observation")] and other.table("patient").filter("ingested_at IS NULL OR loaded_at < ingested_at").count() == 0
    before = {table: other.table(table).count() for table in counts}
    assert set(workflow.load_resources(other, folder, "clinic", "b1").values()) == {0}  # the same load again changes nothing
    lines[0]["gender"], lines[2]["verificationStatus"] = "male", {"coding": [{"code": "confirmed"}]}
    lines[3] |= {"encounter": {"reference": "Encounter/e-1"}, "valueQuantity": {"value": 1.5, "unit": "mg"}, "referenceRange": [{"low": {"value": 1}, "high": {"value": 2}}]}
    with open(f"{folder}/a.ndjson", "w") as file:
        file.write("\n".join(map(json.dumps, lines)))
    again = workflow.load_resources(other, folder, "clinic", "b1")
    assert again["patient"] == again["condition"] == 1 and again["observation"] == 2 and again["procedure"] == 0
    assert before == {table: other.table(table).count() for table in counts}
    assert other.table("patient").first().sex == "male" and other.table("condition").first().verification_status == "confirmed"
    own = other.table("observation").filter("observation_code = '85354-9'").first()
    assert (own.unit, own.reference_range_low, own.reference_range_high) == ("mg", 1.0, 2.0)
    assert own.encounter_sk == other.table("encounter").first().encounter_sk


@pytest.fixture
def own_lake(spark):
    lake = Lake(spark, root=tempfile.mkdtemp(prefix="run-lake-", dir="/tmp"))
    lake.create()
    return lake


def written(lines):
    folder = tempfile.mkdtemp(prefix="run-load-", dir="/tmp")
    with open(f"{folder}/a.ndjson", "w") as file:
        file.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return folder


def patient_line(city, **more):
    return {"resourceType": "Patient", "id": "7", "identifier": [{"system": "mrn", "value": "M7"}], "address": [{"city": city}], **more}


def test_failed_overwrite_keeps_the_table(own_lake, spark):
    own_lake.overwrite(spark.createDataFrame([(1, "M1")], "patient_sk long, mrn string"), "patient")
    bad = spark.range(1000).select(F.col("id").alias("patient_sk"), F.when(F.col("id") == 990, F.raise_error(F.lit("lost"))).otherwise("x").alias("mrn"))
    with pytest.raises(Exception, match="lost"):
        own_lake.overwrite(bad, "patient")
    assert [r.mrn for r in own_lake.table("patient").collect()] == ["M1"]
    opened = own_lake.table("patient")
    own_lake.overwrite(own_lake.table("patient").withColumn("mrn", F.lit("M2")), "patient")  # rows of the table itself
    assert [r.mrn for r in own_lake.table("patient").collect()] == ["M2"] and [r.mrn for r in opened.collect()] == ["M1"]
    assert [r.mrn for r in own_lake.table("patient", version=1).collect()] == ["M1"]
    assert own_lake.log("patient").vacuum(keep=1) >= 1 and [r.mrn for r in own_lake.table("patient").collect()] == ["M2"]


def test_of_two_writers_one_looks_again(own_lake, spark):
    log = own_lake.log("patient")
    assert log.publish(1, ["a"]) and not log.publish(1, ["b"]) and log.read().folders == ("a",)
    with pytest.raises(Conflict):
        log.commit(lambda there: there, based_on=0)
    assert log.commit(lambda there: [*there, "b"], based_on=1) == 2 and log.read().folders == ("a", "b")


def test_appends_at_once_are_all_kept(own_lake):
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: own_lake.append_record("cohort_status_change", cohort_sk=i, status="draft"), range(12)))
    assert sorted(r.cohort_sk for r in own_lake.table("cohort_status_change").collect()) == list(range(12))


def test_many_records_are_put_together(own_lake, monkeypatch):
    monkeypatch.setattr("cohortloom.sources.lake.MOST_FOLDERS", 5)
    for i in range(13):
        own_lake.append_record("cohort_status_change", cohort_sk=i, status="draft")
    assert own_lake.table("cohort_status_change").count() == 13 and len(own_lake.log("cohort_status_change").read().folders) < 6


def test_repeated_older_load_undoes_nothing(own_lake):
    first, second = written([patient_line("Old")]), written([patient_line("New")])
    city = lambda: [r.city for r in own_lake.table("patient").collect()]
    assert workflow.load_resources(own_lake, first, "clinic", "b1")["patient"] == 1 and city() == ["Old"]
    assert workflow.load_resources(own_lake, second, "clinic", "b2")["patient"] == 1 and city() == ["New"]
    assert set(workflow.load_resources(own_lake, first, "clinic", "b1").values()) == {0} and city() == ["New"]
    workflow.load_resources(own_lake, first, "clinic", "b3")  # a new bundle that says so takes it back
    assert city() == ["Old"]
    late = written([patient_line("Late", meta={"lastUpdated": "1999-01-01T00:00:00Z"})])
    assert workflow.load_resources(own_lake, late, "clinic", "b4")["patient"] == 0 and city() == ["Old"]


def test_changed_resources_replace_all_their_rows_and_only_touched_files(own_lake):
    part = lambda code, value: {"code": {"coding": [{"code": code}]}, "valueQuantity": {"value": value}}
    panel = lambda *parts: {"resourceType": "Observation", "id": "o1", "subject": {"reference": "Patient/7"}, "code": {"coding": [{"code": "85354-9"}]}, "component": list(parts)}
    other = {"resourceType": "Observation", "id": "o2", "subject": {"reference": "Patient/7"}, "code": {"coding": [{"code": "x"}]}}
    assert workflow.load_resources(own_lake, written([panel(part("a", 1), part("b", 2))]), "clinic", "b1")["observation"] == 3
    assert workflow.load_resources(own_lake, written([other]), "clinic", "b2")["observation"] == 1
    kept = own_lake.log("observation").read().folders[1]
    assert workflow.load_resources(own_lake, written([panel(part("a", 5))]), "clinic", "b3")["observation"] == 2
    assert sorted((r.observation_code, r.value_numeric) for r in own_lake.table("observation").collect()) == [("85354-9", None), ("a", 5.0), ("x", None)]
    assert own_lake.log("observation").read().folders[0] == kept


def test_bundles_are_loaded_and_other_lines_kept_apart(own_lake, lake, saved, spark):
    members = workflow.current_members(lake).filter(F.col("cohort_sk") == saved)
    lines = [r.value for r in ingest.cohort_bundles(members, lake.table("patient")).collect()]
    counts = workflow.load_resources(own_lake, written([*lines, "{broken", '{"a": 1}', "", {"resourceType": "Procedure", "code": {"coding": [{"code": "1"}]}}]), "clinic", "b1")
    assert (counts["patient"], counts["condition"], counts["raw_quarantine"], counts["procedure"]) == (members.count(), members.count(), 3, 1)
    assert {r.reason for r in own_lake.table("raw_quarantine").collect()} == {"not JSON", "no resource type", "empty line"}
    trigger = members.select(F.explode("qualifying_evidence").alias("e"), "patient_sk").select("e.ref_sk", "patient_sk", "e.code", "e.event_date")
    loaded = own_lake.table("condition").select("condition_sk", "patient_sk", "condition_code", "recorded_date")
    assert loaded.exceptAll(trigger).count() == 0 and trigger.exceptAll(loaded).count() == 0
    people = ["patient_sk", "mrn", "birth_date", "sex"]
    assert own_lake.table("patient").select(*people).exceptAll(lake.table("patient").select(*people)).count() == 0
    assert set(workflow.load_resources(own_lake, written(lines), "clinic", "b1").values()) == {0}


def test_administrations_reports_and_bodies_of_their_own(own_lake):
    encoded = lambda text: base64.b64encode(text.encode()).decode()
    who = {"subject": {"reference": "Patient/1"}}
    given = {"resourceType": "MedicationAdministration", **who, "request": {"reference": "MedicationRequest/7"}}
    dosage = {"text": "one a day", "timing": {"code": {"text": "daily"}}, "route": {"coding": [{"code": "PO", "display": "oral"}]}, "doseAndRate": [{"doseQuantity": {"value": 2.5, "unit": "mg"}}]}
    report = {"resourceType": "DiagnosticReport", **who, "status": "final", "category": [{"coding": [{"code": "SP"}]}]}
    pointing = {"resourceType": "DocumentReference", "id": "30", **who, "content": [{"attachment": {"url": "Binary/b1"}}]}
    counts = workflow.load_resources(own_lake, written([
        {"resourceType": "MedicationRequest", "id": "7", **who, "status": "active", "category": [{"coding": [{"code": "inpatient"}]}], "dosageInstruction": [dosage], "dispenseRequest": {"validityPeriod": {"end": "2001-02-03T00:00:00Z"}}},
        {**given, "id": "11", "status": "completed", "effectiveDateTime": "2001-01-02T03:04:05Z", "dosage": {"dose": {"value": 5, "unit": "mg"}, "route": {"text": "oral"}}},
        {**given, "id": "12", "status": "on-hold", "effectivePeriod": {"start": "2001-01-03T00:00:00Z"}}, {**given, "id": "13", "status": "not-done"}, {**given, "id": "14", "status": "entered-in-error"},
        {**report, "id": "21", "presentedForm": [{"url": "https://x.org/DocumentReference/30"}]}, {**report, "id": "22"},
        {**report, "id": "23", "presentedForm": [{"contentType": "text/html; charset=utf-8", "data": encoded("<p>Benign &mdash; no atypia</p>")}]},
        pointing, {"resourceType": "DocumentReference", "id": "31", **who, "content": [{"attachment": {"contentType": "application/pdf", "data": encoded("%PDF")}}]},
    ]), "clinic", "b1")
    assert (counts["medication_order"], counts["medication_administration"], counts["diagnostic_report"], counts["clinical_note"]) == (1, 4, 3, 3)
    order = own_lake.table("medication_order").first()
    assert (order.dose_quantity, order.dose_unit, order.route, order.frequency, order.sig_text, order.order_class) == ("2.5", "mg", "oral", "daily", "one a day", "inpatient") and order.end_datetime is not None
    doses = {r.med_admin_sk: r for r in own_lake.table("medication_administration").collect()}
    assert {k: r.admin_action for k, r in doses.items()} == {11: "given", 12: "held", 13: "refused", 14: None}
    assert (doses[11].med_order_sk, doses[11].dose_given, doses[11].route, doses[11].source_id) == (7, 5.0, "oral", "11") and doses[12].admin_datetime is not None
    texts = lambda: {r.note_sk: r.note_text for r in own_lake.table("clinical_note").collect()}
    notes = {r.diagnostic_report_sk: r.narrative_note_sk for r in own_lake.table("diagnostic_report").collect()}
    assert notes[21] == 30 and notes[22] is None and texts() == {30: None, 31: None, notes[23]: "Benign — no atypia"}
    body = {"resourceType": "Binary", "id": "b1", "contentType": "text/plain", "data": encoded("No fever.")}
    counts = workflow.load_resources(own_lake, written([body, {**body, "id": "b2"}]), "clinic", "b2")  # the body comes later than its document
    assert counts["clinical_note"] == 1 and texts()[30] == "No fever."
    read = ingest.reports_with_narrative(own_lake.table("diagnostic_report"), own_lake.table("clinical_note")).collect()
    assert {r.diagnostic_report_sk: r.narrative for r in read} == {21: "No fever.", 22: None, 23: "Benign — no atypia"}
    assert {r.med_order_sk: r.n_given for r in ingest.drugs_given(own_lake.table("medication_order"), own_lake.table("medication_administration")).collect()} == {7: 1}
    changed = {**body, "data": encoded("Fever."), "meta": {"lastUpdated": "2100-01-01T00:00:00Z"}}
    assert workflow.load_resources(own_lake, written([changed]), "clinic", "b3")["clinical_note"] == 1 and texts()[30] == "Fever."
    assert set(workflow.load_resources(own_lake, written([body]), "clinic", "b4").values()) == {0} and texts()[30] == "Fever."


def test_identifiers_providers_and_places(own_lake):
    who = {"identifier": [
        {"system": "mrn", "value": " M7 "}, {"system": "mrn", "value": "M7"}, {"type": {"coding": [{"code": "SS"}]}, "value": "123-45-6789", "system": "ssa"},
        {"type": {"text": "enterprise_id"}, "value": "E1", "assigner": {"display": "group"}}, {"system": "mrn", "value": ""}, {"system": "empty"}]}
    sent = [
        patient_line("Here", **who), {"resourceType": "Patient", "id": "8"},
        {"resourceType": "Practitioner", "id": "dr-1", "identifier": [{"system": "http://hl7.org/fhir/sid/us-npi", "value": "99"}], "name": [{"family": "Day", "given": ["Ann", "B."]}]},
        {"resourceType": "Practitioner", "id": "dr-2", "name": [{"text": "Dr. Bo"}], "qualification": [{"code": {"text": "Cardiology"}}]}, {"resourceType": "Practitioner", "id": "dr-3"},
        {"resourceType": "Organization", "id": "o1", "name": "North", "type": [{"coding": [{"code": "prov", "display": "Provider"}]}], "identifier": [{"system": "practiceid", "value": "195"}]},
        {"resourceType": "Location", "id": "l1", "name": "Ward 1", "managingOrganization": {"reference": "Organization/o1"}},
        {"resourceType": "Encounter", "id": "5", "subject": {"reference": "Patient/7"}, "participant": [{"individual": {"reference": "Practitioner/dr-2", "display": "Dr. Bo"}}],
         "serviceProvider": {"reference": "https://x.org/Organization/o1", "display": "North"}, "location": [{"location": {"reference": "Location/l1"}}]},
    ]
    counts = workflow.load_resources(own_lake, written(sent), "clinic", "b1")
    assert (counts["patient"], counts["provider"], counts["organization"], counts["location"], counts["encounter"]) == (2, 3, 1, 1, 1)
    held = lambda: sorted((r.patient_sk, r.identifier_type, r.identifier_value, r.assigning_authority) for r in own_lake.table("patient_identifier").collect())
    first = [(7, "MRN", "M7", "mrn"), (7, "SSN-last4", "6789", "ssa"), (7, "enterprise_id", "E1", "group")]
    assert held() == first
    people = {r.source_id: (r.npi, r.full_name, r.specialty) for r in own_lake.table("provider").collect()}
    assert people == {"dr-1": ("99", "Ann B. Day", None), "dr-2": (None, "Dr. Bo", "Cardiology"), "dr-3": (None, None, None)}
    visit = own_lake.table("encounter").join(own_lake.table("organization").select("organization_sk", "practice_id", "type"), "organization_sk").join(own_lake.table("location").select("location_sk"), "location_sk")
    attended = visit.join(own_lake.table("provider").select("provider_sk", "full_name"), F.col("attending_provider_sk") == F.col("provider_sk")).select("full_name", "facility_name", "practice_id", "type").collect()
    assert [tuple(r) for r in attended] == [("Dr. Bo", "North", "195", "Provider")]
    gone = own_lake.table("location").join(own_lake.table("organization"), "organization_sk").count()
    assert gone == 1 and set(workflow.load_resources(own_lake, written(sent), "clinic", "b1").values()) == {0} and held() == first
    fewer = {"resourceType": "Patient", "id": "7", "meta": {"lastUpdated": "2100-01-01T00:00:00Z"}}
    workflow.load_resources(own_lake, written([fewer]), "clinic", "b2")  # the newest version has no identifiers at all
    assert held() == []


def test_terminology_is_added_to_and_changed(own_lake, spark):
    columns = "code_system string, code string, display string, concept_class string, maps_to string"
    rows = [("ICD-10-CM", "I10", "Hypertension", "code", "59621000"), ("LOINC", "I10", "other", None, None), ("LOINC", None, "no code", None, None)]
    assert workflow.load_concepts(own_lake, spark.createDataFrame(rows + rows[:1], columns)) == 2
    assert workflow.load_concepts(own_lake, spark.createDataFrame(rows, columns)) == 0
    assert workflow.load_concepts(own_lake, spark.createDataFrame([("ICD-10-CM", "I10", "Raised pressure", "code", None)], columns)) == 1
    known = {(r.code_system, r.code): (r.display, r.maps_to) for r in own_lake.table("concept").collect()}
    assert known == {("ICD-10-CM", "I10"): ("Raised pressure", None), ("LOINC", "I10"): ("other", None)}


def test_lookups_by_other_columns_skip_files(own_lake, spark):
    patients = spark.range(20000).select(F.col("id").alias("patient_sk"), F.md5(F.col("id").cast("string")).alias("mrn"))
    own_lake.overwrite(patients.repartition(8), "patient", ordered=False)
    stored = own_lake.table("patient")

    def rows_read(mrn):
        """Rows that the scan hands on: those of row groups that may hold the number."""
        found = timeline.find_patient(stored, mrn).select("patient_sk")
        found = found._jdf.queryExecution()  # the executed plan keeps its metrics
        rows, scans = found.executedPlan().executeCollectPublic(), [found.executedPlan()]
        while scans and "numFiles" not in str(scans[-1].metrics().keys()):
            plan = scans.pop()
            scans += [plan.children().apply(i) for i in range(plan.children().size())]
        return [r.getLong(0) for r in rows], scans[-1].metrics().get("numOutputRows").get().value()

    found, read = rows_read(hashlib.md5(b"777").hexdigest())
    assert found == [777] and 0 < read <= 5000
    assert rows_read(hashlib.md5(b"absent").hexdigest()) == ([], 0)  # within the range of every file


def test_two_saves_at_once_get_versions_of_their_own(own_lake, lake):
    for name in FILLED:
        own_lake.overwrite(lake.table(name), name)
    with ThreadPoolExecutor(2) as pool:
        saves = list(pool.map(lambda _: workflow.save_cohort(own_lake, RECORD, "twice", "condition", "retrospective", as_of=AS_OF), range(2)))
    found = {r.cohort_sk: (r.version, r.status) for r in workflow.current_definitions(own_lake).collect()}
    assert sorted(found) == sorted(saves) and sorted(found.values()) == [(1, "archived"), (2, "active")]


def test_members_of_other_runs_are_not_read(own_lake, lake):
    for name in FILLED:
        own_lake.overwrite(lake.table(name), name)
    cohort_sk = workflow.save_cohort(own_lake, RECORD, "pruned", "condition", "retrospective", as_of=AS_OF)
    workflow.refresh_cohort(own_lake, cohort_sk, AS_OF)
    newest, older = (r.run_id for r in own_lake.table("cohort_run").orderBy(F.col("finished_at").desc()).collect())
    files = workflow.current_members(own_lake).inputFiles()
    assert files and all(f"run_id={newest}" in file for file in files)
    evidence = own_lake.table("cohort_evidence").filter(F.col("run_id") == older)  # a filter prunes the folders as well
    assert "PartitionFilters: [isnotnull(run_id" in evidence._jdf.queryExecution().executedPlan().toString()
    n = workflow.current_members(own_lake).count()
    assert workflow.expire_runs(own_lake, keep=1) == 1 and workflow.expire_runs(own_lake, keep=1) == 0
    assert [r.run_id for r in own_lake.table("cohort_run").collect()] == [newest] and workflow.current_members(own_lake).count() == n
    assert own_lake.table("cohort_evidence").filter(F.col("run_id") == older).count() == 0
    assert own_lake.log("cohort_member").vacuum(keep=1) == 1


def test_incremental_refresh_reads_new_rows_only_and_equals_a_full_run(own_lake, lake, spark):
    record = CriteriaRecord(icd_codes="E11.9,I10", med_codes="860975", exc_icd="I50.9", date_from=FIRST, date_to=LAST)
    for name in FILLED:
        df = lake.table(name)
        own_lake.overwrite(df.filter(f"{TABLES[name].key} % 3 > 0") if name in ("condition", "medication_order") else df, name)
    cohort_sk = workflow.save_cohort(own_lake, record, "grows", "condition", "prospective", as_of=AS_OF)

    def state():
        columns = [c for c in TABLES["cohort_member"].schema.names if c not in ("cohort_member_sk", "run_id", "loaded_at", "qualified_at")]
        return sorted(map(str, workflow.current_members(own_lake, [cohort_sk]).select(*columns).collect())), sorted(map(str, workflow.run_evidence(own_lake, cohort_sk).drop("run_id").collect()))

    assert workflow.refresh_incremental(own_lake, cohort_sk, AS_OF) != cohort_sk  # nothing new
    for part in (own_lake.append(lake.table(n).filter(f"{TABLES[n].key} % 3 = 0"), n) for n in ("condition", "medication_order")):
        assert part > 0
        newest = workflow.refresh_incremental(own_lake, cohort_sk, AS_OF)
    run = own_lake.table("cohort_run").filter(F.col("run_id") == newest).first()
    assert run.based_on is not None
    by_parts = state()
    workflow.run_cohort(own_lake, cohort_sk, AS_OF)
    assert state() == by_parts and len(by_parts[0]) > 0
    own_lake.overwrite(lake.table("condition").filter("condition_sk % 2 = 0"), "condition")  # rows have gone: all are read again
    newest = workflow.refresh_incremental(own_lake, cohort_sk, AS_OF)
    assert own_lake.table("cohort_run").filter(F.col("run_id") == newest).first().based_on is None
    shrunk = state()
    workflow.run_cohort(own_lake, cohort_sk, AS_OF)
    assert state() == shrunk != by_parts


def test_replayed_batches_change_nothing(own_lake, lake, spark):
    spec = CohortSpec(
        [Criterion("t2dm", "condition", F.col("condition_code") == "E11.9"), Criterion("hf", "condition", F.col("condition_code") == "I50.9")],
        AllOf(Has("t2dm"), Not(Has("hf"))), F.lit(True))
    root = tempfile.mkdtemp(prefix="run-stream-", dir="/tmp")
    conditions, patients = lake.table("condition"), lake.table("patient")
    for part in range(2):
        conditions.filter(F.col("condition_sk") % 2 == part).write.mode("append").parquet(f"{root}/in")
        rows = capture.new_rows(spark, "condition", f"{root}/in")
        capture.merge_members(rows, own_lake, "conditions", "condition", spec.criteria, f"{root}/checkpoint").awaitTermination()
    last = own_lake.table("captured_state").agg(F.max("batch")).first()[0]
    assert not capture.fold_batch(own_lake, "conditions", "condition", spec.criteria, conditions, last)  # comes again
    members = lambda: sorted(map(tuple, capture.streamed_members(own_lake, ["conditions"], patients, spec).select("patient_sk", "index_date", "qualifying_source").collect()))
    batch = sorted(map(tuple, qualified_members({"patient": patients, "condition": conditions}, spec).collect()))
    assert members() == batch and len(batch) > 0
    assert own_lake.table("captured_state").select("batch").distinct().count() == 1


def test_extracted_rows_are_landed(lake, spark):
    rows = spark.createDataFrame([(1, 2, "a", None), (1, 3, None, 2.5)], "id int, line int, text string, value double")
    assert workflow.load_extract(lake, rows, "NOTE_LINE", ["id", "line"], "b1") == 2
    raw = lake.table("raw_extract_row")
    assert sorted(r.natural_key for r in raw.collect()) == ["1|2", "1|3"]
    back = ingest.landed_rows(raw, "NOTE_LINE", "id int, line int, text string, value double")
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0


def test_empty_criteria_list(lake):
    spec = cohort_spec(CriteriaRecord(min_age=60, max_age=75), AS_OF)
    assert spec.criteria == []
    cohort_sk = workflow.save_cohort(lake, CriteriaRecord(min_age=60, max_age=75), "elderly", "operational", "retrospective", as_of=AS_OF)
    assert workflow.current_members(lake).filter(F.col("cohort_sk") == cohort_sk).count() > 0
