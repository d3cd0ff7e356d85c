"""Explicit schemas, keys and value sets of the silver (clinical) and gold (cohort) tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LONG, INT, DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
STRING, BOOL, DATE, TS = T.StringType(), T.BooleanType(), T.DateType(), T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


@dataclass(frozen=True)
class Table:
    """A table: schema, primary key, columns its files are laid out by, column defaults, NOT NULL columns, columns whose values name a folder,
    and columns that rows are looked up by though the layout is another: files hold a Bloom filter of them."""

    layer: str
    schema: T.StructType
    key: str
    layout: tuple[str, ...]
    defaults: dict
    required: tuple[str, ...] = ()
    partitions: tuple[str, ...] = ()
    lookups: tuple[str, ...] = ()


# One row of evidence that made a patient a member. The array holds one entry per criterion, so its
# length is bounded by the definition and not by the data; all rows are kept in cohort_evidence.
TRIGGER = T.ArrayType(
    _struct(criterion=STRING, source=STRING, table=STRING, ref_sk=LONG, code=STRING, event_date=DATE, n_rows=LONG)
)

NOW = "current_timestamp"

TABLES: dict[str, Table] = {
    "patient": Table(
        "silver",
        _struct(
            patient_sk=LONG, mrn=STRING, birth_date=DATE, sex=STRING, gender_identity=STRING, race=STRING,
            ethnicity=STRING, deceased_flag=BOOL, deceased_date=DATE, city=STRING, state=STRING, zip=STRING,
            primary_language=STRING, marital_status=STRING, source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "patient_sk", ("patient_sk",),
        {"deceased_flag": False, "primary_language": "English", "loaded_at": NOW},
        ("mrn",), lookups=("mrn",),
    ),
    # Every identifier a source gives a patient; linkage across sources starts here.
    "patient_identifier": Table(
        "silver",
        _struct(
            identifier_sk=LONG, patient_sk=LONG, identifier_type=STRING, identifier_value=STRING, assigning_authority=STRING,
            source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "identifier_sk", ("patient_sk",), {"loaded_at": NOW}, ("patient_sk",), lookups=("identifier_value",),
    ),
    "provider": Table(
        "silver",
        _struct(
            provider_sk=LONG, npi=STRING, full_name=STRING, specialty=STRING,
            source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "provider_sk", ("provider_sk",), {"loaded_at": NOW}, lookups=("npi",),
    ),
    "organization": Table(
        "silver",
        _struct(
            organization_sk=LONG, name=STRING, type=STRING, practice_id=STRING,
            source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "organization_sk", ("organization_sk",), {"loaded_at": NOW},
    ),
    "location": Table(
        "silver",
        _struct(
            location_sk=LONG, name=STRING, type=STRING, organization_sk=LONG,
            source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "location_sk", ("location_sk",), {"loaded_at": NOW},
    ),
    "concept": Table(
        "terminology",
        _struct(concept_sk=LONG, code_system=STRING, code=STRING, display=STRING, concept_class=STRING, maps_to=STRING, loaded_at=TS),
        "concept_sk", ("code_system", "code"), {"loaded_at": NOW}, ("code_system", "code"),
    ),
    "encounter": Table(
        "silver",
        _struct(
            encounter_sk=LONG, patient_sk=LONG, encounter_class=STRING, encounter_type=STRING, status=STRING,
            period_start=TS, period_end=TS, admit_source=STRING, discharge_disposition=STRING,
            attending_provider_name=STRING, facility_name=STRING, attending_provider_sk=LONG, organization_sk=LONG, location_sk=LONG,
            source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "encounter_sk", ("patient_sk", "period_start"), {"loaded_at": NOW}, ("patient_sk",),
    ),
    "condition": Table(
        "silver",
        _struct(
            condition_sk=LONG, patient_sk=LONG, encounter_sk=LONG, category=STRING, condition_code=STRING,
            condition_system=STRING, condition_display=STRING, clinical_status=STRING, verification_status=STRING,
            rank=INT, is_chronic=BOOL, onset_date=DATE, recorded_date=DATE, resolved_date=DATE, source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "condition_sk", ("patient_sk", "recorded_date"),
        {"condition_system": "ICD-10-CM", "is_chronic": False, "loaded_at": NOW}, ("patient_sk",),
    ),
    "observation": Table(
        "silver",
        _struct(
            observation_sk=LONG, patient_sk=LONG, encounter_sk=LONG, category=STRING, observation_code=STRING,
            observation_system=STRING, observation_display=STRING, value_numeric=DOUBLE, value_string=STRING,
            unit=STRING, reference_range_low=DOUBLE, reference_range_high=DOUBLE, interpretation=STRING,
            effective_datetime=TS, parent_observation_sk=LONG, source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "observation_sk", ("patient_sk", "effective_datetime"),
        {"observation_system": "LOINC", "loaded_at": NOW}, ("patient_sk", "category"),
    ),
    "medication_order": Table(
        "silver",
        _struct(
            med_order_sk=LONG, patient_sk=LONG, encounter_sk=LONG, med_code=STRING, med_system=STRING,
            med_display=STRING, ndc_code=STRING, order_class=STRING, dose_quantity=STRING, dose_unit=STRING,
            route=STRING, frequency=STRING, sig_text=STRING, order_status=STRING, start_datetime=TS,
            end_datetime=TS, source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "med_order_sk", ("patient_sk", "start_datetime"),
        {"med_system": "RxNorm", "loaded_at": NOW}, ("patient_sk",),
    ),
    "medication_administration": Table(
        "silver",
        _struct(
            med_admin_sk=LONG, med_order_sk=LONG, patient_sk=LONG, encounter_sk=LONG, admin_datetime=TS, scheduled_datetime=TS,
            admin_action=STRING, dose_given=DOUBLE, dose_unit=STRING, route=STRING, infusion_rate=DOUBLE,
            source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "med_admin_sk", ("patient_sk", "admin_datetime"), {"loaded_at": NOW}, ("patient_sk",),
    ),
    "diagnostic_report": Table(
        "silver",
        _struct(
            diagnostic_report_sk=LONG, patient_sk=LONG, encounter_sk=LONG, report_code=STRING, report_system=STRING,
            report_display=STRING, report_category=STRING, status=STRING, effective_datetime=TS, narrative_note_sk=LONG,
            source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "diagnostic_report_sk", ("patient_sk", "effective_datetime"), {"report_system": "LOINC", "loaded_at": NOW}, ("patient_sk",),
    ),
    "procedure": Table(
        "silver",
        _struct(
            procedure_sk=LONG, patient_sk=LONG, encounter_sk=LONG, procedure_code=STRING, procedure_system=STRING,
            procedure_display=STRING, procedure_category=STRING, status=STRING, performed_datetime=TS, source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "procedure_sk", ("patient_sk", "performed_datetime"),
        {"procedure_system": "CPT", "loaded_at": NOW}, ("patient_sk",),
    ),
    "clinical_note": Table(
        "silver",
        _struct(
            note_sk=LONG, patient_sk=LONG, encounter_sk=LONG, note_type_code=STRING, note_type_system=STRING,
            note_type_display=STRING, note_category=STRING, author_name=STRING, service_date=TS, status=STRING,
            note_text=STRING, source_system=STRING, source_id=STRING, source_table_or_resource=STRING, ingested_at=TS, loaded_at=TS,
        ),
        "note_sk", ("patient_sk", "service_date"),
        {"note_type_system": "LOINC", "status": "signed", "loaded_at": NOW}, ("patient_sk",), lookups=("note_sk",),
    ),
    "nlp_run": Table(
        "silver",
        _struct(
            nlp_run_sk=LONG, model_name=STRING, model_version=STRING, run_started_at=TS, run_finished_at=TS,
            note_count=LONG, loaded_at=TS,
        ),
        "nlp_run_sk", (), {"loaded_at": NOW}, ("model_name",),
    ),
    "note_nlp_entity": Table(
        "silver",
        _struct(
            entity_sk=LONG, note_sk=LONG, patient_sk=LONG, encounter_sk=LONG, nlp_run_sk=LONG, entity_type=STRING,
            covered_text=STRING, span_start=INT, span_end=INT, concept_code=STRING, concept_system=STRING,
            concept_display=STRING, negation=BOOL, certainty=STRING, temporality=STRING, subject=STRING,
            confidence=DOUBLE, loaded_at=TS,
        ),
        "entity_sk", ("patient_sk", "entity_type", "entity_sk"),
        {"negation": False, "subject": "patient", "loaded_at": NOW}, ("note_sk", "patient_sk", "nlp_run_sk"), lookups=("note_sk",),
    ),
    # Notes that an NLP run has answered, with the outcome: a note without any mention is done as well.
    "note_nlp_outcome": Table(
        "silver",
        _struct(nlp_run_sk=LONG, note_sk=LONG, outcome=STRING, n_entities=INT, loaded_at=TS),
        "note_sk", ("note_sk",), {"loaded_at": NOW}, ("nlp_run_sk", "note_sk"),
    ),
    "cohort_definition": Table(
        "gold",
        _struct(
            cohort_sk=LONG, name=STRING, description=STRING, cohort_type=STRING, cohort_category=STRING,
            primary_concept_code=STRING, primary_concept_system=STRING, primary_concept_display=STRING,
            definition_logic=STRING, is_nlp_derived=BOOL, index_event_description=STRING, lookback_days=INT,
            follow_up_days=INT, min_age_years=INT, max_age_years=INT, comparison_cohort_sk=LONG, status=STRING,
            version=INT, created_by=STRING, created_at=TS,
        ),
        "cohort_sk", (),
        {"is_nlp_derived": False, "status": "draft", "version": 1, "created_at": NOW}, ("name",),
    ),
    # Append-only log that stands in for UPDATE: the newest row of a cohort is its status.
    "cohort_status_change": Table(
        "gold", _struct(cohort_sk=LONG, status=STRING, changed_at=TS), "cohort_sk", (), {"changed_at": NOW},
    ),
    "cohort_member": Table(
        "gold",
        _struct(
            cohort_member_sk=LONG, cohort_sk=LONG, run_id=STRING, patient_sk=LONG, index_date=DATE,
            qualified_at=TS, qualifying_source=STRING, qualifying_evidence=TRIGGER, loaded_at=TS,
        ),
        "cohort_member_sk", ("cohort_sk", "patient_sk"), {"qualified_at": NOW, "loaded_at": NOW},
        ("cohort_sk", "patient_sk"), ("cohort_sk", "run_id"),
    ),
    "cohort_evidence": Table(
        "gold",
        _struct(
            cohort_sk=LONG, run_id=STRING, patient_sk=LONG, criterion=STRING, source=STRING, table=STRING,
            ref_sk=LONG, code=STRING, event_date=DATE,
        ),
        "ref_sk", ("cohort_sk", "patient_sk", "ref_sk"), {}, ("cohort_sk", "patient_sk"), ("cohort_sk", "run_id"),
    ),
    # For every patient and criterion of a run (members or not) the row that first met it and how many did: what a later run folds new rows into.
    "cohort_state": Table(
        "gold",
        _struct(
            cohort_sk=LONG, run_id=STRING, patient_sk=LONG, criterion=STRING, source=STRING, table=STRING,
            ref_sk=LONG, code=STRING, event_date=DATE, n_rows=LONG,
        ),
        "ref_sk", ("cohort_sk", "patient_sk"), {}, ("cohort_sk", "patient_sk"), ("cohort_sk", "run_id"),
    ),
    # The same of a stream, after its newest batch: the batch number in the folder's name is the ledger.
    "captured_state": Table(
        "gold",
        _struct(
            stream=STRING, batch=LONG, patient_sk=LONG, criterion=STRING, source=STRING, table=STRING, ref_sk=LONG,
            code=STRING, event_date=DATE, n_rows=LONG,
        ),
        "ref_sk", ("patient_sk",), {}, ("patient_sk",), ("stream", "batch"),
    ),
    # One row per evaluation of a cohort; the newest finished run of a cohort holds its members. `read_versions` are the versions of the tables it read;
    # a run that is `based_on` another read only what had been added since.
    "cohort_run": Table(
        "gold", _struct(cohort_sk=LONG, run_id=STRING, n_members=LONG, read_versions=STRING, based_on=STRING, finished_at=TS), "run_id", (),
        {"finished_at": NOW}, ("cohort_sk", "run_id"),
    ),
    "patient_feature": Table(
        "gold",
        _struct(
            patient_sk=LONG, age_years=INT, sex=STRING, race=STRING, ethnicity=STRING, encounter_count=LONG,
            inpatient_count=LONG, ed_count=LONG, active_problem_count=LONG, distinct_med_count=LONG,
            last_a1c=DOUBLE, last_bp_systolic=DOUBLE, last_bp_diastolic=DOUBLE, last_bmi=DOUBLE,
            nlp_finding_count=LONG, feature_asof_date=DATE, loaded_at=TS,
        ),
        "patient_sk", ("patient_sk",), {"loaded_at": NOW}, ("patient_sk",),
    ),
    # Raw landing of interchange resources: one generic table for every resource type.
    "raw_fhir_resource": Table(
        "bronze",
        _struct(
            resource_type=STRING, resource_id=STRING, source_system=STRING, payload=STRING, bundle_id=STRING,
            version_time=TS, digest=STRING, ingested_at=TS,
        ),
        "resource_id", (), {"ingested_at": NOW},
    ),
    # Lines of a load that are no resource.
    "raw_quarantine": Table(
        "bronze",
        _struct(payload=STRING, digest=STRING, reason=STRING, source_system=STRING, bundle_id=STRING, ingested_at=TS),
        "digest", (), {"ingested_at": NOW},
    ),
    # Raw landing of rows extracted from a relational source, whatever their table.
    "raw_extract_row": Table(
        "bronze",
        _struct(source_table=STRING, natural_key=STRING, payload=STRING, extract_batch_id=STRING, ingested_at=TS),
        "natural_key", (), {"ingested_at": NOW},
    ),
}

# Foreign keys: (child table, child column, parent table, parent column).
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("encounter", "patient_sk", "patient", "patient_sk"),
    ("encounter", "attending_provider_sk", "provider", "provider_sk"),
    ("encounter", "organization_sk", "organization", "organization_sk"),
    ("encounter", "location_sk", "location", "location_sk"),
    ("location", "organization_sk", "organization", "organization_sk"),
    ("patient_identifier", "patient_sk", "patient", "patient_sk"),
    ("condition", "patient_sk", "patient", "patient_sk"),
    ("observation", "patient_sk", "patient", "patient_sk"),
    ("medication_order", "patient_sk", "patient", "patient_sk"),
    ("procedure", "patient_sk", "patient", "patient_sk"),
    ("clinical_note", "patient_sk", "patient", "patient_sk"),
    ("medication_administration", "patient_sk", "patient", "patient_sk"),
    ("medication_administration", "med_order_sk", "medication_order", "med_order_sk"),
    ("diagnostic_report", "patient_sk", "patient", "patient_sk"),
    ("diagnostic_report", "narrative_note_sk", "clinical_note", "note_sk"),
    ("note_nlp_entity", "note_sk", "clinical_note", "note_sk"),
    ("note_nlp_entity", "patient_sk", "patient", "patient_sk"),
    ("note_nlp_entity", "nlp_run_sk", "nlp_run", "nlp_run_sk"),
    ("cohort_member", "cohort_sk", "cohort_definition", "cohort_sk"),
    ("cohort_member", "patient_sk", "patient", "patient_sk"),
    ("patient_feature", "patient_sk", "patient", "patient_sk"),
]

# The documented value sets of the coded columns.
VALUE_SETS: dict[tuple[str, str], tuple[str, ...]] = {
    ("patient", "sex"): ("male", "female", "other", "unknown"),
    ("encounter", "encounter_class"): ("inpatient", "outpatient", "emergency", "ambulatory", "telehealth"),
    ("encounter", "status"): ("planned", "arrived", "in-progress", "finished", "cancelled"),
    ("condition", "clinical_status"): ("active", "resolved", "inactive"),
    ("condition", "category"): ("problem-list-item", "encounter-diagnosis"),
    ("condition", "verification_status"): ("confirmed", "provisional"),
    ("observation", "category"): ("laboratory", "vital-signs"),
    ("observation", "interpretation"): ("normal", "high", "low", "critical", "abnormal"),
    ("medication_order", "order_class"): ("inpatient", "outpatient"),
    ("medication_order", "order_status"): ("active", "completed", "discontinued"),
    ("medication_administration", "admin_action"): ("given", "held", "refused"),
    ("diagnostic_report", "report_category"): ("LAB", "PATHOLOGY", "RADIOLOGY", "MICRO"),
    ("procedure", "procedure_category"): ("surgical", "diagnostic", "therapeutic"),
    ("procedure", "status"): ("completed", "in-progress"),
    ("clinical_note", "note_category"): (
        "discharge_summary", "progress", "hp", "consult", "pathology", "radiology", "other",
    ),
    ("clinical_note", "status"): ("preliminary", "signed", "addended"),
    ("note_nlp_entity", "entity_type"): ("problem", "medication", "lab", "procedure", "anatomy", "finding"),
    ("note_nlp_entity", "certainty"): ("positive", "negated", "uncertain", "hypothetical"),
    ("note_nlp_entity", "temporality"): ("current", "historical", "family"),
    ("note_nlp_entity", "subject"): ("patient", "family", "other"),
    ("cohort_definition", "cohort_type"): ("condition", "exposure", "control", "operational", "administrative"),
    ("cohort_definition", "cohort_category"): ("retrospective", "prospective"),
    ("cohort_definition", "status"): ("draft", "active", "archived"),
    ("cohort_member", "qualifying_source"): ("coded", "nlp", "both"),
}

PAGE_SIZE = 50

# Entities of one note as a model returns them: body = {"entities": [...]}.
MENTION = _struct(
    entity_type=STRING, covered_text=STRING, span_start=INT, span_end=INT, concept_code=STRING,
    concept_system=STRING, concept_display=STRING, negation=BOOL, certainty=STRING, temporality=STRING,
    subject=STRING, confidence=DOUBLE,
)
RESPONSE_BODY = _struct(entities=T.ArrayType(MENTION))
