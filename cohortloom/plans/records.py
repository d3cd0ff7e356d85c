"""Queries on conforming source records and on note text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import clinical, codes, text
from cohortloom.operators import cohort, enrich, ingest, linkage
from cohortloom.plans.cohorts import _EVIDENCE_SQL, _NESTED_SQL, _NESTED_VIEWS, _nested_tables, nested_spec
from cohortloom.plans.registry import query, sql_text, values_view
from cohortloom.schemas import TABLES
from cohortloom.sources.fixtures import clinical_view, load, read_driver_table, with_views
from cohortloom.sources.lake import conform, without_internal_columns

# --- text --------------------------------------------------------------------------------------------


@query("reassembled_notes", "SELECT doc_id, md5(text) AS text_md5, len(string_split(text, chr(10))) AS n_lines FROM documents")
def reassembled_notes(spark, sf_dir):
    """Texts cut into numbered lines and put together again in line order."""
    lines = read_driver_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    whole = text.reassemble_lines(lines, ["doc_id"], "line", "text")
    return whole.select("doc_id", F.md5("text").alias("text_md5"), F.size(F.split("text", "\n", -1)).alias("n_lines"))


# Lines trimmed one by one; the entities are those that the given pages hold, the ampersand last.
@query("html_notes", r"""
WITH lines AS (
  SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
    '(?i)<br\b[^>]*>|</(?:p|div|li|tr|h[1-6])\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS parts
  FROM pages),
shown AS (
  SELECT page_id, [trim(regexp_replace(
    replace(replace(replace(replace(replace(part, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) FOR part IN parts] AS parts
  FROM lines),
whole AS (SELECT page_id, array_to_string([part FOR part IN parts IF part <> ''], chr(10)) AS note_text FROM shown)
SELECT page_id, note_text, length(note_text) AS text_char_length, 'html_stripped' AS text_extraction_method FROM whole""")
def html_notes(spark, sf_dir):
    plain = text.html_to_text(F.col("html"))
    return read_driver_table(spark, sf_dir, "pages").select("page_id", plain.alias("note_text")).select(
        "page_id", "note_text", F.length("note_text").alias("text_char_length"), F.lit("html_stripped").alias("text_extraction_method")
    )


def _deidentified_sql() -> str:
    out, columns = "text", []
    for kind, pattern in text.IDENTIFIERS:
        columns.append(f"len(regexp_extract_all({out}, {sql_text(pattern)})) AS n_{kind}")
        out = f"regexp_replace({out}, {sql_text(pattern)}, '[{kind.upper()}]', 'g')"
    return f"SELECT doc_id, md5({out}) AS text_md5, {', '.join(columns)} FROM documents"


@query("deidentified_notes", _deidentified_sql())
def deidentified_notes(spark, sf_dir):
    clean, counts = text.deidentify(F.col("text"))
    return read_driver_table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(clean).alias("text_md5"), *[n.alias(f"n_{kind}") for kind, n in counts.items()]
    )


# --- crosswalks, lookups, links ------------------------------------------------------------------------


@query("crosswalked_diagnoses", with_views("diagnosis_entry", "dx_crosswalk", then="""
SELECT DISTINCT encounter_sk, icd10 FROM diagnosis_entry AS d JOIN dx_crosswalk AS x ON d.dx_id = x.dx_id"""))
def crosswalked_diagnoses(spark, sf_dir):
    tables = load(spark, sf_dir, "diagnosis_entry", "dx_crosswalk")
    return ingest.diagnoses_by_crosswalk(tables["diagnosis_entry"], tables["dx_crosswalk"])


@query("resolved_categories", "SELECT c_custkey AS patient_sk, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def resolved_categories(spark, sf_dir):
    lookup = read_driver_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    resolved = ingest.resolve_category(read_driver_table(spark, sf_dir, "customer"), "c_nationkey", lookup, "nation")
    return resolved.select(F.col("c_custkey").alias("patient_sk"), "nation")


@query("linked_identities", with_views("identifier", then="""
SELECT a.source_key, min(b.source_key) AS patient_sk
FROM identifier AS a JOIN identifier AS b
  ON a.identifier_type = b.identifier_type AND a.assigning_authority = b.assigning_authority AND a.identifier_value = b.identifier_value
GROUP BY a.source_key"""))
def linked_identities(spark, sf_dir):
    return ingest.link_identities(clinical_view(spark, sf_dir, "identifier"))


@query("linked_people", with_views("identifier", then="""
, tie AS (
  SELECT DISTINCT a.source_key AS a, b.source_key AS b FROM identifier AS a JOIN identifier AS b
    ON a.identifier_type = b.identifier_type AND a.assigning_authority = b.assigning_authority AND a.identifier_value = b.identifier_value
  WHERE (a.identifier_type, a.assigning_authority, a.identifier_value) IN (
    SELECT (identifier_type, assigning_authority, identifier_value) FROM identifier GROUP BY ALL HAVING count(DISTINCT source_key) <= 100)),
reached AS (
  WITH RECURSIVE step(a, b) AS (SELECT a, b FROM tie UNION SELECT step.a, tie.b FROM step JOIN tie ON step.b = tie.a) SELECT * FROM step)
SELECT i.source_key, least(i.source_key, coalesce(min(b), i.source_key)) AS patient_sk
FROM (SELECT DISTINCT source_key FROM identifier) AS i LEFT JOIN reached ON a = i.source_key GROUP BY i.source_key"""))
def linked_people(spark, sf_dir):
    """Records tied by shared identifiers through any number of others."""
    return linkage.linked_people(clinical_view(spark, sf_dir, "identifier"))


@query("drugs_given", with_views("medication_order", "administration", then="""
SELECT o.med_order_sk, o.patient_sk, o.med_code, count(*) AS n_given, min(admin_datetime) AS first_given, max(admin_datetime) AS last_given
FROM medication_order AS o JOIN administration AS a ON o.med_order_sk = a.med_order_sk
WHERE admin_action = 'given' GROUP BY 1, 2, 3"""))
def drugs_given(spark, sf_dir):
    """Drugs that were really given, not only ordered."""
    tables = load(spark, sf_dir, "medication_order", "administration")
    given = ingest.drugs_given(tables["medication_order"], tables["administration"])
    return given.select("med_order_sk", "patient_sk", "med_code", "n_given", "first_given", "last_given")


@query("reports_with_narrative", with_views("diagnostic_report", "clinical_note", then="""
SELECT diagnostic_report_sk, r.patient_sk, narrative_note_sk, length(note_text) AS narrative_length, md5(note_text) AS narrative_md5
FROM diagnostic_report AS r LEFT JOIN clinical_note AS n ON r.narrative_note_sk = n.note_sk"""))
def reports_with_narrative(spark, sf_dir):
    tables = load(spark, sf_dir, "diagnostic_report", "clinical_note")
    return ingest.reports_with_narrative(tables["diagnostic_report"], tables["clinical_note"]).select(
        "diagnostic_report_sk", "patient_sk", "narrative_note_sk", F.length("narrative").alias("narrative_length"), F.md5("narrative").alias("narrative_md5"),
    )


# ICD-10-CM codes with their SNOMED concept, where one is known.
CONCEPTS = [
    ("ICD-10-CM", code, display, {"E11.9": "44054006", "I10": "59621000", "I50.9": "84114007"}.get(code))
    for code, display, _ in codes.ICD10 if code != "J06.9"
] + [("RxNorm", code, display, None) for code, display, *_ in codes.MEDICATIONS]


@query("looked_up_concepts", with_views("condition", then=", " + values_view("concept", "code_system, code, display, maps_to", CONCEPTS) + """
SELECT condition_sk, condition_code, display AS concept_display, maps_to
FROM condition LEFT JOIN concept ON code_system = 'ICD-10-CM' AND code = condition_code"""))
def looked_up_concepts(spark, sf_dir):
    concepts = F.broadcast(spark.createDataFrame(CONCEPTS, "code_system string, code string, display string, maps_to string"))
    found = ingest.lookup_concepts(clinical_view(spark, sf_dir, "condition"), "condition_code", "ICD-10-CM", concepts)
    return found.select("condition_sk", "condition_code", "concept_display", "maps_to")


@query("clinical_and_billed_procedures", with_views("procedure", "billed_procedure", then="""
SELECT patient_sk, procedure_code, performed_date, bool_or(is_billed) AS is_billed
FROM (SELECT patient_sk, procedure_code, CAST(performed_datetime AS DATE) AS performed_date, false AS is_billed FROM procedure
      UNION ALL SELECT patient_sk, procedure_code, performed_date, true FROM billed_procedure) AS b
GROUP BY 1, 2, 3"""))
def clinical_and_billed_procedures(spark, sf_dir):
    tables = load(spark, sf_dir, "procedure", "billed_procedure")
    clinical_rows = tables["procedure"].withColumn("performed_date", F.col("performed_datetime").cast("date"))
    return ingest.clinical_and_billed(clinical_rows, tables["billed_procedure"], ["patient_sk", "procedure_code", "performed_date"])


@query("kept_visits", with_views("appointment", then="""
SELECT appointment_id, patient_sk, period_start, status FROM appointment WHERE status NOT IN ('booked', 'cancelled')"""))
def kept_visits(spark, sf_dir):
    return ingest.kept_visits(clinical_view(spark, sf_dir, "appointment"))


@query("conformed_with_provenance", """
SELECT o_orderkey AS encounter_sk, 'clinic' AS source_system, CAST(o_orderkey AS VARCHAR) AS source_id,
       'orders.parquet' AS source_table_or_resource, TIMESTAMP '2002-01-01' AS ingested_at, o_orderdate AS loaded_at,
       DATE '1840-12-31' + CAST(date_diff('day', DATE '1840-12-31', CAST(o_orderdate AS DATE)) AS INT) AS contact_date
FROM orders""")
def conformed_with_provenance(spark, sf_dir):
    """Conformed rows with their source, and a date stored as a day count of the source system."""
    orders = read_driver_table(spark, sf_dir, "orders")
    day_count = F.datediff(F.col("o_orderdate").cast("date"), F.lit(clinical.INTERNAL_DAY_ZERO).cast("date"))
    rows = orders.select(
        F.col("o_orderkey").alias("encounter_sk"), day_count.alias("_real"), "o_orderdate", F.col("_metadata.file_name").alias("_file")
    )
    stamped = enrich.with_provenance(
        rows, "clinic", F.col("encounter_sk"), "", F.lit("2002-01-01").cast("timestamp_ntz"), F.col("o_orderdate")
    )
    return stamped.select(
        "encounter_sk", "source_system", "source_id", F.col("_file").alias("source_table_or_resource"), "ingested_at", "loaded_at",
        clinical.internal_day(F.col("_real")).alias("contact_date"),
    )


@query("conformed_patients", with_views("patient", then="""
SELECT patient_sk, mrn, birth_date, sex, CAST(NULL AS VARCHAR) AS gender_identity, race, ethnicity, deceased_flag,
       CAST(NULL AS DATE) AS deceased_date, CAST(NULL AS VARCHAR) AS city, state, CAST(NULL AS VARCHAR) AS zip,
       CASE WHEN sex = 'male' THEN 'Spanish' ELSE 'English' END AS primary_language, CAST(NULL AS VARCHAR) AS marital_status
FROM patient"""))
def conformed_patients(spark, sf_dir):
    """Rows as the overwrite sink writes them: internal columns dropped, types and defaults of the table."""
    rows = clinical_view(spark, sf_dir, "patient").withColumns({
        "_phenotype": F.lit("general"), "city": F.lit(None), "primary_language": F.when(F.col("sex") == "male", "Spanish"),
    })
    return conform(without_internal_columns(rows), TABLES["patient"]).drop("loaded_at", *ingest.PROVENANCE)


@query("cleaned_lab_results", with_views("lab_result", then="""
SELECT result_id, coalesce(nullif(ord_num_value, 9999999.0), try_cast(trim(ord_value) AS DOUBLE)) AS value_numeric, ord_value AS value_string
FROM lab_result"""))
def cleaned_lab_results(spark, sf_dir):
    cleaned = enrich.clean_lab_results(clinical_view(spark, sf_dir, "lab_result"), "ord_num_value", "ord_value")
    return cleaned.select("result_id", "value_numeric", "value_string")


# --- interchange resources: JSON lines made from the tables, landed and conformed again --------------------


def _ref(kind: str, key: str):
    return F.struct(F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("reference"))


def _concept(column):
    return F.struct(F.array(F.struct(column.alias("code"))).alias("coding"))


def _lines(df: DataFrame, kind: str, key: str, **fields) -> DataFrame:
    body = F.struct(F.lit(kind).alias("resourceType"), F.col(key).cast("string").alias("id"), *[c.alias(n) for n, c in fields.items()])
    return df.select(F.to_json(body).alias("value"))


def _landed(lines: DataFrame) -> DataFrame:
    return ingest.land_resources(lines, "clinic", "bundle-1", F.lit("2002-01-01").cast("timestamp"))


def _patient_lines(spark, sf_dir):
    return _lines(
        clinical_view(spark, sf_dir, "patient"), "Patient", "patient_sk",
        identifier=F.array(F.struct(F.lit("ssn").alias("system"), F.lit("0").alias("value")), F.struct(F.lit("mrn").alias("system"), F.col("mrn").alias("value"))),
        birthDate=F.col("birth_date"), gender=F.col("sex"), deceasedBoolean=F.when(F.col("deceased_flag"), F.lit(True)),
        address=F.array(F.struct(F.col("state"))),
    )


def _condition_lines(spark, sf_dir):
    return _lines(
        clinical_view(spark, sf_dir, "condition"), "Condition", "condition_sk", subject=_ref("Patient", "patient_sk"),
        encounter=_ref("Encounter", "encounter_sk"), category=F.array(_concept(F.col("category"))),
        code=_concept(F.col("condition_code")), clinicalStatus=_concept(F.col("clinical_status")),
        onsetDateTime=F.col("onset_date"), recordedDate=F.col("recorded_date"),
    )


@query("landed_resources", with_views("patient", "condition", then="""
SELECT 'Patient' AS resource_type, count(*) AS n, count(DISTINCT patient_sk) AS n_ids FROM patient
UNION ALL SELECT 'Condition', count(*), count(DISTINCT condition_sk) FROM condition"""))
def landed_resources(spark, sf_dir):
    raw = _landed(_patient_lines(spark, sf_dir).unionByName(_condition_lines(spark, sf_dir)))
    return raw.groupBy("resource_type").agg(F.count("*").alias("n"), F.countDistinct("resource_id").alias("n_ids"))


@query("landed_extract_rows", """
SELECT concat(CAST(l_orderkey AS VARCHAR), '|', CAST(l_linenumber AS VARCHAR)) AS natural_key, 'lineitem' AS source_table,
       l_partkey, l_quantity, l_returnflag FROM lineitem""")
def landed_extract_rows(spark, sf_dir):
    """Rows of a source table to landed JSON and back."""
    raw = ingest.land_rows(
        read_driver_table(spark, sf_dir, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"], "batch-1", F.current_timestamp()
    )
    rows = ingest.landed_rows(raw, "lineitem", "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string")
    return rows.select(
        F.concat_ws("|", "l_orderkey", "l_linenumber").alias("natural_key"), F.lit("lineitem").alias("source_table"),
        "l_partkey", "l_quantity", "l_returnflag",
    )


@query("fhir_patients", with_views("patient", then="\nSELECT patient_sk, mrn, birth_date, sex, deceased_flag, state FROM patient"))
def fhir_patients(spark, sf_dir):
    return ingest.conform_patients(_landed(_patient_lines(spark, sf_dir))).select("patient_sk", "mrn", "birth_date", "sex", "deceased_flag", "state")


@query("fhir_encounters", with_views("encounter", then="""
SELECT encounter_sk, patient_sk, encounter_class, encounter_type, status, period_start, period_end FROM encounter"""))
def fhir_encounters(spark, sf_dir):
    classes = F.create_map(*[F.lit(v) for code, name in ingest.ENCOUNTER_CLASSES.items() for v in (name, code)])
    lines = _lines(
        clinical_view(spark, sf_dir, "encounter"), "Encounter", "encounter_sk", subject=_ref("Patient", "patient_sk"),
        status=F.col("status"), type=F.array(F.struct(F.col("encounter_type").alias("text"))),
        period=F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end")),
        **{"class": F.struct(classes[F.col("encounter_class")].alias("code"))},
    )
    return ingest.conform_encounters(_landed(lines)).select(
        "encounter_sk", "patient_sk", "encounter_class", "encounter_type", "status", "period_start", "period_end")


@query("fhir_attended_encounters", with_views("encounter", then="""
SELECT encounter_sk, attending_provider_name, facility_name, encounter_sk % 12 AS attending_provider_sk, encounter_sk % 7 AS organization_sk,
       encounter_sk % 5 AS location_sk, CASE WHEN encounter_class = 'emergency' THEN 'emd' END AS admit_source, 'Home' AS discharge_disposition FROM encounter"""))
def fhir_attended_encounters(spark, sf_dir):
    """Who attended, where, and how a stay began and ended; every second encounter names a referrer before the one who attended."""
    role = lambda code: F.array(_concept(F.lit(code)))
    who = F.struct(
        F.concat(F.lit("Practitioner/"), (F.col("encounter_sk") % 12).cast("string")).alias("reference"), F.col("attending_provider_name").alias("display"))
    other = F.struct(F.lit("Practitioner/999").alias("reference"), F.lit("Dr. Who Sent").alias("display"))
    attended, referred = F.struct(role("ATND").alias("type"), who.alias("individual")), F.struct(role("REF").alias("type"), other.alias("individual"))
    place = lambda kind, n: F.concat(F.lit(f"{kind}/"), (F.col("encounter_sk") % n).cast("string")).alias("reference")
    lines = _lines(
        clinical_view(spark, sf_dir, "encounter"), "Encounter", "encounter_sk", subject=_ref("Patient", "patient_sk"),
        participant=F.when(F.col("encounter_sk") % 2 == 0, F.array(referred, attended)).otherwise(F.array(attended)),
        serviceProvider=F.struct(place("Organization", 7), F.col("facility_name").alias("display")),
        location=F.array(F.struct(F.struct(place("Location", 5)).alias("location"))),
        hospitalization=F.struct(
            F.when(F.col("encounter_class") == "emergency", _concept(F.lit("emd"))).alias("admitSource"),
            F.struct(F.lit("Home").alias("text")).alias("dischargeDisposition")),
    )
    return ingest.conform_encounters(_landed(lines)).select(
        "encounter_sk", "attending_provider_name", "facility_name", "attending_provider_sk", "organization_sk", "location_sk", "admit_source",
        "discharge_disposition")


def _identifier_lines(spark, sf_dir):
    """Patients with all their identifiers, the first of them twice."""
    i = F.struct(
        F.col("identifier_value").alias("value"), F.struct(F.col("identifier_type").alias("text")).alias("type"),
        F.struct(F.col("assigning_authority").alias("display")).alias("assigner"))
    held = clinical_view(spark, sf_dir, "identifier").groupBy("source_key").agg(F.array_sort(F.collect_list(i)).alias("held"))
    return _lines(held, "Patient", "source_key", identifier=F.concat("held", F.slice("held", 1, 1)))


@query("fhir_patient_identifiers", with_views("identifier", then="""
SELECT source_key AS patient_sk, identifier_type, identifier_value, assigning_authority FROM identifier"""))
def fhir_patient_identifiers(spark, sf_dir):
    conformed = ingest.conform_identifiers(_landed(_identifier_lines(spark, sf_dir)))
    return conformed.select("patient_sk", "identifier_type", "identifier_value", "assigning_authority")


@query("fhir_providers", """
SELECT s_suppkey AS provider_sk, CAST(1000000000 + s_suppkey AS VARCHAR) AS npi, concat('Ann ', s_name) AS full_name, n_name AS specialty
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def fhir_providers(spark, sf_dir):
    rows = ingest.resolve_category(
        read_driver_table(spark, sf_dir, "supplier"), "s_nationkey",
        read_driver_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")), "specialty")
    number = lambda system, value: F.struct(F.lit(system).alias("system"), value.cast("string").alias("value"))
    lines = _lines(
        rows, "Practitioner", "s_suppkey",
        identifier=F.array(number("local", F.lit(0)), number("http://hl7.org/fhir/sid/us-npi", 1000000000 + F.col("s_suppkey"))),
        name=F.array(F.struct(F.array(F.lit("Ann")).alias("given"), F.col("s_name").alias("family"))),
        qualification=F.array(F.struct(_concept(F.col("specialty")).alias("code"))),
    )
    return ingest.conform_providers(_landed(lines)).select("provider_sk", "npi", "full_name", "specialty")


@query("fhir_locations", """
SELECT p_partkey AS location_sk, p_name AS location_name, p_type AS location_type, n_name AS organization_name, 'prov' AS organization_type,
       CAST(n_nationkey AS VARCHAR) AS practice_id
FROM part JOIN nation ON p_partkey % 25 = n_nationkey""")
def fhir_locations(spark, sf_dir):
    """Places with the organizations they belong to."""
    organizations = _lines(
        read_driver_table(spark, sf_dir, "nation"), "Organization", "n_nationkey", name=F.col("n_name"), type=F.array(_concept(F.lit("prov"))),
        identifier=F.array(F.struct(F.lit("urn:practiceid").alias("system"), F.col("n_nationkey").cast("string").alias("value"))))
    places = read_driver_table(spark, sf_dir, "part").withColumn("_org", F.col("p_partkey") % 25)
    locations = _lines(
        places, "Location", "p_partkey", name=F.col("p_name"), type=F.array(_concept(F.col("p_type"))), managingOrganization=_ref("Organization", "_org"))
    held = ingest.conform_locations(_landed(locations)).select("location_sk", F.col("name").alias("location_name"), F.col("type").alias("location_type"), "organization_sk")
    by = ingest.conform_organizations(_landed(organizations)).select("organization_sk", F.col("name").alias("organization_name"), F.col("type").alias("organization_type"), "practice_id")
    return held.join(by, "organization_sk").drop("organization_sk")


@query("fhir_conditions", with_views("condition", then="""
SELECT condition_sk, patient_sk, encounter_sk, category, condition_code, clinical_status, onset_date, recorded_date FROM condition"""))
def fhir_conditions(spark, sf_dir):
    return ingest.conform_conditions(_landed(_condition_lines(spark, sf_dir))).select("condition_sk", "patient_sk", "encounter_sk", "category", "condition_code", "clinical_status", "onset_date", "recorded_date")


@query("fhir_observations", with_views("observation", then="""
SELECT observation_sk AS panel_sk, patient_sk, category, observation_code,
       CASE WHEN observation_code <> '85354-9' THEN value_numeric END AS value_numeric, value_string, effective_datetime,
       CAST(NULL AS BIGINT) AS parent_observation_sk FROM observation
UNION ALL SELECT observation_sk, patient_sk, category, '8480-6', 120.0, NULL, effective_datetime, observation_sk
FROM observation WHERE observation_code = '85354-9'
UNION ALL SELECT observation_sk, patient_sk, category, '8462-4', 80.0, NULL, effective_datetime, observation_sk
FROM observation WHERE observation_code = '85354-9'"""))
def fhir_observations(spark, sf_dir):
    """Panels carry components, which become rows of their own that point to the panel."""
    systolic, diastolic = clinical.bp_parts(F.col("value_string"))
    part = lambda code, value: F.struct(_concept(F.lit(code)).alias("code"), F.struct(value.alias("value")).alias("valueQuantity"))
    lines = _lines(
        clinical_view(spark, sf_dir, "observation"), "Observation", "observation_sk", subject=_ref("Patient", "patient_sk"),
        category=F.array(_concept(F.col("category"))), code=_concept(F.col("observation_code")),
        valueQuantity=F.when(F.col("value_numeric").isNotNull(), F.struct(F.col("value_numeric").alias("value"))),
        valueString=F.col("value_string"), effectiveDateTime=F.date_format("effective_datetime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        component=F.when(F.col("observation_code") == "85354-9", F.array(part("8480-6", systolic), part("8462-4", diastolic))),
    )
    conformed = ingest.conform_observations(_landed(lines))
    return conformed.select(
        F.coalesce("parent_observation_sk", "observation_sk").alias("panel_sk"), "patient_sk", "category", "observation_code", "value_numeric",
        "value_string", "effective_datetime", "parent_observation_sk",
    )


@query("fhir_medication_orders", with_views("medication_order", then="""
SELECT med_order_sk, patient_sk, encounter_sk, med_code, order_status, start_datetime FROM medication_order"""))
def fhir_medication_orders(spark, sf_dir):
    lines = _lines(
        clinical_view(spark, sf_dir, "medication_order"), "MedicationRequest", "med_order_sk", subject=_ref("Patient", "patient_sk"),
        encounter=_ref("Encounter", "encounter_sk"), status=F.col("order_status"),
        medicationCodeableConcept=_concept(F.col("med_code")), authoredOn=F.col("start_datetime"),
    )
    return ingest.conform_medication_orders(_landed(lines)).select("med_order_sk", "patient_sk", "encounter_sk", "med_code", "order_status", "start_datetime")


@query("fhir_procedures", with_views("procedure", then="""
SELECT procedure_sk, patient_sk, encounter_sk, procedure_code, status, performed_datetime FROM procedure"""))
def fhir_procedures(spark, sf_dir):
    lines = _lines(
        clinical_view(spark, sf_dir, "procedure"), "Procedure", "procedure_sk", subject=_ref("Patient", "patient_sk"),
        encounter=_ref("Encounter", "encounter_sk"), status=F.col("status"), code=_concept(F.col("procedure_code")),
        performedDateTime=F.col("performed_datetime"),
    )
    return ingest.conform_procedures(_landed(lines)).select("procedure_sk", "patient_sk", "encounter_sk", "procedure_code", "status", "performed_datetime")


@query("fhir_notes", with_views("clinical_note", then="""
SELECT note_sk, patient_sk, note_category, CAST(service_date AS TIMESTAMP) AS service_date, 'text/plain' AS content_type,
       md5(note_text) AS text_md5, 'structured_text' AS text_extraction_method, length(note_text) AS text_char_length
FROM clinical_note"""))
def fhir_notes(spark, sf_dir):
    """Note texts as inline base64 attachments, decoded again."""
    attachment = F.struct(F.lit("text/plain").alias("contentType"), F.base64(F.encode("note_text", "UTF-8")).alias("data"))
    lines = _lines(
        clinical_view(spark, sf_dir, "clinical_note"), "DocumentReference", "note_sk", subject=_ref("Patient", "patient_sk"),
        category=F.array(_concept(F.col("note_category"))), date=F.col("service_date").cast("timestamp_ntz"),
        content=F.array(F.struct(attachment.alias("attachment"))),
    )
    decoded = ingest.conform_notes(_landed(lines))
    return decoded.withColumn("text_md5", F.md5("note_text")).drop("note_text", "encounter_sk", "note_type_code", "note_type_display")


@query("fhir_administrations", with_views("medication_order", "administration", then="""
SELECT a.med_order_sk * 10 + a.line AS med_admin_sk, a.med_order_sk, patient_sk, encounter_sk, admin_datetime, admin_action,
       CAST(a.line + 1 AS DOUBLE) AS dose_given, 'mg' AS dose_unit, 'oral' AS route
FROM administration AS a JOIN medication_order AS o ON a.med_order_sk = o.med_order_sk"""))
def fhir_administrations(spark, sf_dir):
    """Doses as they were given, with the order each belongs to."""
    tables = load(spark, sf_dir, "administration", "medication_order")
    rows = tables["administration"].join(tables["medication_order"].select("med_order_sk", "patient_sk", "encounter_sk"), "med_order_sk")
    status = F.create_map(*[F.lit(v) for v in ("given", "completed", "held", "on-hold", "refused", "not-done")])
    lines = _lines(
        rows.withColumn("med_admin_sk", F.col("med_order_sk") * 10 + F.col("line")), "MedicationAdministration", "med_admin_sk",
        subject=_ref("Patient", "patient_sk"), context=_ref("Encounter", "encounter_sk"), request=_ref("MedicationRequest", "med_order_sk"),
        status=status[F.col("admin_action")], effectiveDateTime=F.col("admin_datetime"),
        dosage=F.struct(F.struct((F.col("line") + 1).alias("value"), F.lit("mg").alias("unit")).alias("dose"), F.struct(F.lit("oral").alias("text")).alias("route")),
    )
    return ingest.conform_administrations(_landed(lines)).select(
        "med_admin_sk", "med_order_sk", "patient_sk", "encounter_sk", F.col("admin_datetime").cast("timestamp_ntz").alias("admin_datetime"),
        "admin_action", "dose_given", "dose_unit", "route")


@query("fhir_reports", with_views("diagnostic_report", then="""
SELECT diagnostic_report_sk, patient_sk, narrative_note_sk, 'RADIOLOGY' AS report_category, '18748-4' AS report_code, 'final' AS status FROM diagnostic_report"""))
def fhir_reports(spark, sf_dir):
    """Reports and the document that holds their narrative."""
    form = F.struct(F.lit("text/plain").alias("contentType"), F.concat(F.lit("DocumentReference/"), F.col("narrative_note_sk").cast("string")).alias("url"))
    lines = _lines(
        clinical_view(spark, sf_dir, "diagnostic_report"), "DiagnosticReport", "diagnostic_report_sk", subject=_ref("Patient", "patient_sk"),
        category=F.array(_concept(F.lit("RAD"))), code=_concept(F.lit("18748-4")), status=F.lit("final"),
        presentedForm=F.when(F.col("narrative_note_sk").isNotNull(), F.array(form)),
    )
    return ingest.conform_reports(_landed(lines)).select("diagnostic_report_sk", "patient_sk", "narrative_note_sk", "report_category", "report_code", "status")


@query("fhir_binary_notes", with_views("clinical_note", then="""
SELECT note_sk, patient_sk, 'text/plain' AS content_type, md5(note_text) AS text_md5, length(note_text) AS text_char_length FROM clinical_note"""))
def fhir_binary_notes(spark, sf_dir):
    """Documents whose bodies are resources of their own, sent in an earlier bundle."""
    texts = clinical_view(spark, sf_dir, "clinical_note")
    pointed = F.struct(F.struct(F.concat(F.lit("https://fhir.example.org/r4/Binary/b"), F.col("note_sk").cast("string")).alias("url")).alias("attachment"))
    documents = _lines(texts, "DocumentReference", "note_sk", subject=_ref("Patient", "patient_sk"), content=F.array(pointed))
    bodies = _lines(
        texts.withColumn("_id", F.concat(F.lit("b"), F.col("note_sk").cast("string"))), "Binary", "_id",
        contentType=F.lit("text/plain"), data=F.base64(F.encode("note_text", "UTF-8")))
    first = ingest.land_resources(bodies, "clinic", "bundle-0", F.lit("2001-12-01").cast("timestamp"))
    second = _landed(documents)
    landed = linkage._staged(first.unionByName(second))  # as a load reads them: from the landing table
    notes = ingest.conform_notes(ingest.with_attachments(landed.filter("bundle_id = 'bundle-1'"), landed, binaries=False))
    return notes.select("note_sk", "patient_sk", "content_type", F.md5("note_text").alias("text_md5"), "text_char_length")


@query("cohort_bundles", with_views(*_NESTED_VIEWS, then=_NESTED_SQL + _EVIDENCE_SQL + """
SELECT 7 AS cohort_sk, patient_sk, 'Bundle' AS resource_type, 1 + count(DISTINCT criterion) AS n_entries
FROM kept GROUP BY patient_sk"""))
def cohort_bundles(spark, sf_dir):
    """One bundle per member: the patient and the triggering rows; read back from the JSON text."""
    tables = _nested_tables(spark, sf_dir)
    members = cohort.members_with_evidence(tables, nested_spec()).withColumn("cohort_sk", F.lit(7))
    bundles = ingest.cohort_bundles(members, tables["patient"])
    return bundles.select(
        "cohort_sk", "patient_sk", F.get_json_object("value", "$.resourceType").alias("resource_type"),
        F.json_array_length(F.get_json_object("value", "$.entry")).cast("long").alias("n_entries"),
    )
