"""Clinical views over the driver tables.

The driver's tables hold no clinical data, so each clinical table is one SELECT over them: plain column
arithmetic with no random numbers. The text runs unchanged in Spark and in the SQL oracle; names in
braces are the driver tables.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# (l_orderkey, l_linenumber) is not unique, so the key mixes in part, supplier and ship date.
LINE_SK = (
    "(l_orderkey * 8 + l_linenumber) * 4000000000 + (l_partkey * 100003 + l_suppkey * 2557"
    " + year(l_shipdate) * 372 + month(l_shipdate) * 31 + day(l_shipdate)) % 4000000000"
)

VIEWS: dict[str, str] = {
    "patient": """
SELECT c_custkey AS patient_sk,
       concat('MRN-', lpad(CAST(c_custkey AS STRING), 6, '0')) AS mrn,
       CASE WHEN c_custkey % 97 = 0 THEN NULL
            ELSE DATE '1920-01-01' + CAST(c_custkey * 37 % 29000 AS INT) END AS birth_date,
       CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'White' WHEN 'AUTOMOBILE' THEN 'Asian'
            WHEN 'MACHINERY' THEN 'Black or African American' ELSE 'Other' END AS race,
       CASE WHEN c_custkey % 5 = 0 THEN 'Hispanic or Latino' ELSE 'Not Hispanic or Latino' END AS ethnicity,
       concat('S', lpad(CAST(c_nationkey AS STRING), 2, '0')) AS state,
       c_custkey % 67 = 0 AS deceased_flag
FROM {customer}""",
    "encounter": """
SELECT o_orderkey AS encounter_sk, o_custkey AS patient_sk,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'inpatient'
            WHEN '3-MEDIUM' THEN 'outpatient' WHEN '5-LOW' THEN 'telehealth' ELSE 'ambulatory' END AS encounter_class,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Emergency Department Visit' WHEN '2-HIGH' THEN 'Hospital Admission'
            WHEN '3-MEDIUM' THEN 'Outpatient Visit' WHEN '5-LOW' THEN 'Telehealth Visit'
            ELSE 'Ambulatory Care Visit' END AS encounter_type,
       CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'planned' ELSE 'in-progress' END AS status,
       o_orderdate AS period_start,
       CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderdate + INTERVAL '3' DAY ELSE o_orderdate END AS period_end,
       concat('Dr. ', CAST(o_orderkey % 12 AS STRING)) AS attending_provider_name,
       concat('Facility ', CAST(o_orderkey % 7 AS STRING)) AS facility_name
FROM {orders}""",
    "condition": f"""
SELECT {LINE_SK} AS condition_sk,
       o_custkey AS patient_sk, o_orderkey AS encounter_sk, l_linenumber AS rank,
       CASE WHEN l_linenumber = 1 THEN 'problem-list-item' ELSE 'encounter-diagnosis' END AS category,
       CASE l_partkey % 8 WHEN 0 THEN 'E11.9' WHEN 1 THEN 'I10' WHEN 2 THEN 'I25.10' WHEN 3 THEN 'I50.9'
            WHEN 4 THEN 'R73.09' WHEN 5 THEN 'E78.5' WHEN 6 THEN 'I63.9' ELSE 'J06.9' END AS condition_code,
       CASE l_returnflag WHEN 'N' THEN 'active' WHEN 'R' THEN 'resolved' ELSE 'inactive' END AS clinical_status,
       l_partkey % 8 IN (0, 1, 2, 3, 5) AS is_chronic,
       CAST(l_shipdate AS DATE) - 30 AS onset_date,
       CAST(l_shipdate AS DATE) AS recorded_date,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) + 21 END AS resolved_date
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
WHERE l_linenumber IN (1, 2, 3)""",
    "medication_order": f"""
SELECT {LINE_SK} AS med_order_sk,
       o_custkey AS patient_sk, o_orderkey AS encounter_sk,
       CASE l_suppkey % 5 WHEN 0 THEN '860975' WHEN 1 THEN '861007' WHEN 2 THEN '665035'
            WHEN 3 THEN '285129' ELSE '617312' END AS med_code,
       CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'completed' END AS order_status,
       l_shipdate AS start_datetime,
       l_shipdate + INTERVAL '90' DAY AS end_datetime
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
WHERE l_linenumber IN (4, 5)""",
    "procedure": f"""
SELECT {LINE_SK} AS procedure_sk,
       o_custkey AS patient_sk, o_orderkey AS encounter_sk,
       CASE l_partkey % 4 WHEN 0 THEN '99213' WHEN 1 THEN '93000' WHEN 2 THEN '80053' ELSE '27447' END AS procedure_code,
       CASE l_partkey % 4 WHEN 3 THEN 'surgical' ELSE 'diagnostic' END AS procedure_category,
       'completed' AS status,
       l_shipdate AS performed_datetime
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
WHERE l_linenumber IN (6, 7)""",
    "observation": """
SELECT event_id AS observation_sk, user_id AS patient_sk,
       CASE WHEN event_type IN ('purchase') THEN 'laboratory' ELSE 'vital-signs' END AS category,
       CASE event_type WHEN 'purchase' THEN '4548-4' WHEN 'click' THEN '8480-6' WHEN 'view' THEN '8462-4'
            WHEN 'error' THEN '39156-5' ELSE '85354-9' END AS observation_code,
       CASE event_type WHEN 'purchase' THEN floor(45 + value / 4) / 10 WHEN 'click' THEN floor(900 + value * 2) / 10
            WHEN 'view' THEN floor(550 + value * 10 / 6) / 10 WHEN 'error' THEN floor(170 + value * 10 / 12) / 10 END AS value_numeric,
       CASE WHEN event_type = 'signup' THEN '120/80' END AS value_string,
       ts - INTERVAL '24' YEAR AS effective_datetime,
       CASE WHEN event_type IN ('click', 'view') THEN event_id - 1 END AS parent_observation_sk
FROM {events}""",
    "clinical_note": """
SELECT doc_id AS note_sk, doc_id % (SELECT count(*) FROM {customer}) AS patient_sk,
       CASE doc_id % 4 WHEN 0 THEN 'discharge_summary' WHEN 1 THEN 'hp' WHEN 2 THEN 'progress' ELSE 'consult' END AS note_category,
       concat('Dr. ', CAST(doc_id % 12 AS STRING)) AS author_name,
       CAST(DATE '1999-01-01' + CAST(doc_id % 700 AS INT) AS TIMESTAMP) AS service_date,
       CASE WHEN doc_id % 9 = 0 THEN 'preliminary' ELSE 'signed' END AS status,
       concat(CASE doc_id % 10
         WHEN 0 THEN 'Patient has type 2 diabetes, takes metformin.'   WHEN 1 THEN 'Patient denies chest pain and cough.'
         WHEN 2 THEN 'No evidence of pneumonia.'                       WHEN 3 THEN 'Mother has type 2 diabetes.'
         WHEN 4 THEN 'Rule out pneumonia.'                             WHEN 5 THEN 'History of pancreatitis.'
         WHEN 6 THEN 'If glucose stays high, start insulin.'           WHEN 7 THEN 'Family history of coronary artery disease.'
         WHEN 8 THEN 'Known heart failure; no fever.'                  ELSE 'Visit for a form.' END, ' ', text) AS note_text
FROM {documents}""",
    "note_nlp_entity": """
SELECT doc_id * 3 + k AS entity_sk, doc_id AS note_sk, doc_id % (SELECT count(*) FROM {customer}) AS patient_sk, 1 AS nlp_run_sk,
       CASE (doc_id + k) % 3 WHEN 0 THEN 'problem' WHEN 1 THEN 'medication' ELSE 'finding' END AS entity_type,
       CASE (doc_id + k) % 3 WHEN 0 THEN 'Type 2 Diabetes' WHEN 1 THEN 'metformin' ELSE 'dry cough' END AS covered_text,
       CASE (doc_id + k) % 3 WHEN 0 THEN 'E11.9' WHEN 1 THEN '860975' END AS concept_code,
       CASE (doc_id + k) % 3 WHEN 0 THEN 'Type 2 diabetes mellitus' WHEN 2 THEN 'Cough' END AS concept_display,
       (doc_id + k) % 5 = 0 AS negation,
       CASE WHEN (doc_id + k) % 5 = 0 THEN 'negated' WHEN (doc_id + k) % 7 = 0 THEN 'uncertain'
            WHEN (doc_id + k) % 11 = 0 THEN 'hypothetical' ELSE 'positive' END AS certainty,
       CASE WHEN doc_id % 13 = 0 THEN 'family' WHEN doc_id % 6 = 0 THEN 'historical' ELSE 'current' END AS temporality,
       CASE WHEN doc_id % 13 = 0 THEN 'family' ELSE 'patient' END AS subject,
       round(CAST(n_chars % 100 AS DOUBLE) / 100, 2) AS confidence
FROM (SELECT doc_id, n_chars, {zero_to_two} AS k FROM {documents}) AS d""",
    "cohort_definition": """
SELECT r_regionkey AS cohort_sk, concat('cohort ', r_name) AS name,
       CASE r_regionkey WHEN 0 THEN 'condition' WHEN 1 THEN 'exposure' WHEN 2 THEN 'control' ELSE 'operational' END AS cohort_type,
       CASE WHEN r_regionkey % 2 = 0 THEN 'retrospective' ELSE 'prospective' END AS cohort_category,
       CASE WHEN r_regionkey = 3 THEN 'archived' ELSE 'active' END AS status, 1 AS version,
       'E11.9' AS primary_concept_display, 'analyst' AS created_by,
       CAST(DATE '2002-01-01' + r_regionkey AS TIMESTAMP) AS created_at
FROM {region}""",
    "cohort_member": """
SELECT n_regionkey AS cohort_sk, c_custkey AS patient_sk, DATE '2000-01-01' + CAST(c_custkey % 300 AS INT) AS index_date,
       CASE c_custkey % 3 WHEN 0 THEN 'coded' WHEN 1 THEN 'nlp' ELSE 'both' END AS qualifying_source
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
WHERE n_regionkey < 4 AND c_custkey % 4 <> 0""",
    # A library of stored definitions, one per part, some of them versions of one name.
    "definition_library": """
SELECT p_partkey AS cohort_sk,
       concat('cohort ', CAST(p_partkey % 500 AS STRING)) AS name,
       CASE p_partkey % 5 WHEN 0 THEN 'condition' WHEN 1 THEN 'exposure' WHEN 2 THEN 'control'
            WHEN 3 THEN 'operational' ELSE 'administrative' END AS cohort_type,
       CASE WHEN p_size % 2 = 0 THEN 'retrospective' ELSE 'prospective' END AS cohort_category,
       CASE p_partkey % 7 WHEN 0 THEN 'archived' WHEN 1 THEN 'draft' ELSE 'active' END AS status,
       concat('user ', CAST(p_size AS STRING)) AS created_by,
       CAST(DATE '2002-01-01' + CAST(p_partkey * 7919 % 1000 AS INT) AS TIMESTAMP) AS created_at,
       CASE WHEN p_partkey % 4 = 0 THEN ' e11.9 , i10,, ' WHEN p_partkey % 4 = 1 THEN '' ELSE 'I50.9' END AS icd_codes,
       CASE WHEN p_partkey % 3 = 0 THEN '860975, 861007' ELSE '' END AS med_codes,
       CASE WHEN p_partkey % 6 = 1 THEN ' 4548-4' ELSE '' END AS lab_code,
       CASE WHEN p_partkey % 5 = 0 THEN 'diabetes, dry cough' ELSE '' END AS nlp_terms,
       CASE WHEN p_partkey % 11 = 0 THEN '44054006' ELSE '' END AS nlp_concept,
       18 + p_size % 30 AS min_age
FROM {part}""",
    # Status changes of the definitions above: the newest change of a definition wins.
    "status_change": """
SELECT user_id AS cohort_sk,
       CASE event_type WHEN 'purchase' THEN 'active' WHEN 'click' THEN 'archived' ELSE 'draft' END AS status,
       ts AS changed_at, event_id AS change_id
FROM {events}""",
    # Answers of an external extraction model, one per note: some failed, cut off, refused, broken or empty.
    "response": """
SELECT concat('note-', CAST(doc_id AS STRING)) AS custom_id,
       CASE WHEN doc_id % 11 = 0 THEN 'errored' WHEN doc_id % 23 = 0 THEN 'expired' ELSE 'succeeded' END AS result_type,
       CASE WHEN doc_id % 13 = 1 THEN 'max_tokens' WHEN doc_id % 17 = 2 THEN 'refusal' ELSE 'end_turn' END AS stop_reason,
       CASE WHEN doc_id % 19 = 3 THEN 'no json here'
            WHEN doc_id % 7 = 4 THEN '{{"entities": []}}'
            ELSE concat('{{"entities": [{{"entity_type": "problem", "covered_text": "diabetes", "span_start": ',
                        CAST(doc_id % 50 AS STRING), ', "span_end": ', CAST(doc_id % 50 + 8 AS STRING),
                        ', "concept_code": "E11.9", "concept_system": "ICD-10-CM", "concept_display": null, "negation": ',
                        CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END,
                        ', "certainty": "positive", "temporality": "current", "subject": "patient", "confidence": 0.',
                        CAST(n_chars % 9 + 1 AS STRING),
                        '}}, {{"entity_type": "medication", "covered_text": "metformin", "span_start": null}}]}}') END AS body
FROM {documents}""",
    # Opening and closing entries of runs, one run per conversation: turn 0 opens it, later turns close it.
    "run_log": """
SELECT conv_id AS nlp_run_sk,
       CASE WHEN turn = 0 THEN CAST(DATE '2024-01-01' + CAST(conv_id % 300 AS INT) AS TIMESTAMP) END AS run_started_at,
       CASE WHEN turn > 0 THEN CAST(DATE '2024-01-02' + CAST(conv_id % 300 + turn AS INT) AS TIMESTAMP) END AS run_finished_at,
       CASE WHEN turn = 0 THEN length(text) END AS note_count
FROM {conversations}""",
    # Versions of notes: up to three per note, some of them not signed.
    "note_version": """
SELECT CAST(floor(doc_id / 3) AS BIGINT) AS note_id, doc_id AS version_id,
       CASE doc_id % 4 WHEN 0 THEN 'preliminary' WHEN 1 THEN 'addended' ELSE 'signed' END AS status,
       CAST(DATE '1999-01-01' + CAST(doc_id * 7 % 11 AS INT) AS TIMESTAMP) AS filed_at, n_chars
FROM {documents}""",
    # Encounter diagnoses under internal ids, and the crosswalk of these ids to ICD codes (many-to-many).
    "diagnosis_entry": """
SELECT l_orderkey AS encounter_sk, l_partkey AS dx_id, l_linenumber AS line FROM {lineitem}""",
    "dx_crosswalk": """
SELECT p_partkey AS dx_id,
       CASE p_partkey % 4 WHEN 0 THEN 'E11.9' WHEN 1 THEN 'I10' WHEN 2 THEN 'I25.10' ELSE 'E78.5' END AS icd10
FROM {part}
UNION ALL
SELECT p_partkey AS dx_id, CASE WHEN p_partkey % 2 = 0 THEN 'I10' ELSE 'J06.9' END AS icd10 FROM {part} WHERE p_size > 25""",
    "identifier": """
SELECT c_custkey AS source_key, 'MRN' AS identifier_type, concat('practice ', CAST(c_nationkey AS STRING)) AS assigning_authority,
       CAST(c_custkey AS STRING) AS identifier_value
FROM {customer}
UNION ALL
SELECT c_custkey, 'enterprise_id', 'all', CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) FROM {customer}
UNION ALL
SELECT c_custkey, 'member_id', c_mktsegment, CAST(c_custkey % 997 AS STRING) FROM {customer}""",
    "administration": f"""
SELECT {LINE_SK} AS med_order_sk, k AS line,
       CASE CAST(l_quantity AS INT) % 3 WHEN 0 THEN 'given' WHEN 1 THEN CASE WHEN k = 1 THEN 'given' ELSE 'held' END
            ELSE 'refused' END AS admin_action,
       l_shipdate + INTERVAL '6' HOUR AS admin_datetime
FROM (SELECT *, {{zero_to_two}} AS k FROM {{lineitem}} WHERE l_linenumber IN (4, 5)) AS l""",
    "diagnostic_report": """
SELECT o_orderkey AS diagnostic_report_sk, o_custkey AS patient_sk,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderkey % 1500 END AS narrative_note_sk
FROM {orders}""",
    "billed_procedure": """
SELECT o_custkey AS patient_sk,
       CASE l_partkey % 4 WHEN 0 THEN '99213' WHEN 1 THEN '93000' WHEN 2 THEN '80053' ELSE '27447' END AS procedure_code,
       CAST(l_shipdate AS DATE) AS performed_date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
WHERE l_linenumber >= 6 AND l_returnflag <> 'A'""",
    "appointment": """
SELECT o_orderkey AS appointment_id, o_custkey AS patient_sk, o_orderdate AS period_start,
       CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'booked' ELSE 'cancelled' END AS status
FROM {orders}""",
    # Raw laboratory results: text values, and a sentinel number where the text is none.
    "lab_result": """
SELECT event_id AS result_id, user_id AS patient_sk,
       CASE event_type WHEN 'purchase' THEN 9999999.0 WHEN 'click' THEN 9999999.0 ELSE round(value, 1) END AS ord_num_value,
       CASE event_type WHEN 'purchase' THEN 'Positive' WHEN 'click' THEN concat(' ', CAST(event_id % 90 AS STRING), ' ')
            ELSE CAST(event_id % 90 AS STRING) END AS ord_value
FROM {events}""",
    # Blood pressure as typed text; some entries are no reading.
    "bp_text": """
SELECT event_id AS observation_sk, user_id AS patient_sk,
       CASE event_type WHEN 'signup' THEN concat(CAST(90 + event_id % 80 AS STRING), '/', CAST(50 + event_id % 50 AS STRING))
            WHEN 'view' THEN concat(' ', CAST(100 + event_id % 60 AS STRING), ' / ', CAST(60 + event_id % 30 AS STRING))
            WHEN 'click' THEN 'refused' WHEN 'error' THEN '120' END AS value_string
FROM {events}""",
}

# Views with three rows per source row; only this expression differs by engine.
ZERO_TO_TWO = {"spark": "explode(array(0, 1, 2))", "duckdb": "unnest([0, 1, 2])"}


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names_in(text: str) -> list[str]:
    return [name for name in DRIVER_TABLES if "{" + name + "}" in text]


def clinical_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The clinical table as a DataFrame over the driver tables."""
    text = VIEWS[view].replace("{zero_to_two}", ZERO_TO_TWO["spark"])
    frames = {name: read_driver_table(spark, sf_dir, name) for name in _names_in(text)}
    return spark.sql(text, **frames)


def load(spark: SparkSession, sf_dir: str, *views: str) -> dict[str, DataFrame]:
    return {view: clinical_view(spark, sf_dir, view) for view in views}


@cache
def duckdb_text(view: str) -> str:
    text = VIEWS[view].replace("{zero_to_two}", ZERO_TO_TWO["duckdb"])
    for name in _names_in(text):
        text = text.replace("{" + name + "}", name)
    return text.replace("{{", "{").replace("}}", "}").strip()


def with_views(*views: str, then: str) -> str:
    """Oracle SQL: the clinical views as CTEs, followed by `then` (further CTEs start with a comma)."""
    return "WITH " + ",\n".join(f"{view} AS (\n{duckdb_text(view)})" for view in views) + then
