"""Queries on building cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import cohort, criteria, evidence, review
from cohortloom.operators.criteria import AllOf, AnyOf, CohortSpec, Criterion, CriteriaRecord, Has, Not
from cohortloom.operators.criteria_sql import cohort_sql
from cohortloom.plans.registry import AS_OF, query
from cohortloom.schemas import TABLES
from cohortloom.sources.fixtures import clinical_view, load, with_views
from cohortloom.sources.lake import conform
from cohortloom.streaming import capture

CLINICAL = ("patient", "condition", "medication_order", "observation", "note_nlp_entity")
FIRST, LAST = "1998-01-01", "2001-12-31"
AGE = f"date_diff('day', birth_date, DATE '{AS_OF}') / 365.25"

# --- the flagship ------------------------------------------------------------------------------------


def flagship_spec() -> CohortSpec:
    """Active type 2 diabetes in the window, on metformin, 40 to 89 years old, without heart failure."""
    return CohortSpec(
        [
            Criterion("t2dm", "condition", criteria.condition_matches(["E11.9"], ["active"], FIRST, LAST)),
            Criterion(
                "metformin", "medication_order",
                F.col("med_code").isin("860975", "861007") & F.col("order_status").isin("active"),
            ),
            Criterion("hf", "condition", F.col("condition_code").isin("I50.9")),
        ],
        Has("t2dm") & Has("metformin") & Not(Has("hf")),
        criteria.patient_matches(40, 89, [], criteria.clinical.as_date(AS_OF)),
    )


@query("flagship_slice", with_views("patient", "condition", "medication_order", then=f"""
SELECT count(*) AS n, min(patient_sk) AS lo, max(patient_sk) AS hi, CAST(sum(patient_sk) AS BIGINT) AS s
FROM patient
WHERE patient_sk IN (SELECT patient_sk FROM condition WHERE condition_code IN ('E11.9') AND clinical_status IN ('active')
                     AND recorded_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}')
  AND patient_sk IN (SELECT patient_sk FROM medication_order WHERE med_code IN ('860975', '861007') AND order_status IN ('active'))
  AND {AGE} BETWEEN 40 AND 89
  AND patient_sk NOT IN (SELECT patient_sk FROM condition WHERE condition_code IN ('I50.9'))"""))
def flagship_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = cohort.evaluate(load(spark, sf_dir, "patient", "condition", "medication_order"), flagship_spec())
    return members.agg(
        F.count("*").alias("n"), F.min("patient_sk").alias("lo"), F.max("patient_sk").alias("hi"),
        F.sum("patient_sk").alias("s"),
    )


# --- a stored record with every kind of criterion --------------------------------------------------------

RECORD = CriteriaRecord(
    icd_codes=" e11.9, i10 ,", med_codes="860975, 861007", date_from=FIRST, date_to=LAST,
    nlp_terms="diabetes, Dry Cough", exc_icd="i63.9", exc_meds="617312", min_age=18, max_age=95,
    sex_filter=["male", "female"],
)

RECORD_SQL = f"""
SELECT DISTINCT patient_sk, mrn, birth_date, sex, race
FROM patient
WHERE patient_sk IN (SELECT patient_sk FROM condition WHERE condition_code IN ('E11.9', 'I10')
                     AND clinical_status IN ('active') AND recorded_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}')
  AND patient_sk IN (SELECT patient_sk FROM medication_order WHERE med_code IN ('860975', '861007')
                     AND order_status IN ('active') AND start_datetime >= DATE '{FIRST}'
                     AND start_datetime < DATE '{LAST}' + INTERVAL 1 DAY)
  AND patient_sk IN (SELECT patient_sk FROM note_nlp_entity
                     WHERE (covered_text ILIKE '%diabetes%' OR concept_display ILIKE '%diabetes%'
                            OR covered_text ILIKE '%dry cough%' OR concept_display ILIKE '%dry cough%')
                     AND negation = false AND certainty IN ('positive') AND temporality IN ('current'))
  AND {AGE} BETWEEN 18 AND 95 AND sex IN ('male', 'female')
  AND patient_sk NOT IN (SELECT patient_sk FROM condition WHERE condition_code IN ('I63.9'))
  AND patient_sk NOT IN (SELECT patient_sk FROM medication_order WHERE med_code IN ('617312'))"""


def _record_members(spark: SparkSession, sf_dir: str, record: CriteriaRecord = RECORD) -> DataFrame:
    return cohort.build_cohort(load(spark, sf_dir, *CLINICAL), criteria.cohort_spec(record, AS_OF))


@query("cohort_members", with_views("patient", "condition", "medication_order", "note_nlp_entity", then=RECORD_SQL))
def cohort_members(spark, sf_dir):
    return _record_members(spark, sf_dir)


@query("cohort_size", with_views("patient", "condition", "medication_order", "note_nlp_entity",
                                 then=f"\nSELECT count(*) AS n FROM ({RECORD_SQL}) AS m"))
def cohort_size(spark, sf_dir):
    return cohort.cohort_size(_record_members(spark, sf_dir))


WIDE_RECORD = CriteriaRecord(icd_codes="E11.9", icd_status=["active", "resolved"], date_from=FIRST, date_to=LAST)


@query("cohort_preview", with_views("patient", "condition", then=f"""
SELECT patient_sk, mrn, birth_date, sex, race FROM patient
WHERE patient_sk IN (SELECT patient_sk FROM condition WHERE condition_code = 'E11.9'
                     AND clinical_status IN ('active', 'resolved')
                     AND recorded_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}')
  AND {AGE} BETWEEN 0 AND 120
ORDER BY patient_sk LIMIT 50"""))
def cohort_preview(spark, sf_dir):
    return cohort.preview(_record_members(spark, sf_dir, WIDE_RECORD))


def _padded(code: str, n: int = 5000) -> str:
    """A list as typed of one code among n that no row has."""
    return ", ".join([*(f"{code}-{i:05d}" for i in range(n)), code])


LONG_RECORD = CriteriaRecord(
    icd_codes=_padded("E11.9"), icd_status=["active", "resolved"], date_from=FIRST, date_to=LAST, exc_icd=_padded("I63.9"), exc_meds=_padded("617312")
)


@query("cohort_of_long_code_lists", with_views("patient", "condition", "medication_order", then=f"""
SELECT patient_sk, mrn, birth_date, sex, race FROM patient
WHERE patient_sk IN (SELECT patient_sk FROM condition WHERE condition_code = 'E11.9' AND clinical_status IN ('active', 'resolved')
                     AND recorded_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}')
  AND {AGE} BETWEEN 0 AND 120
  AND patient_sk NOT IN (SELECT patient_sk FROM condition WHERE condition_code = 'I63.9')
  AND patient_sk NOT IN (SELECT patient_sk FROM medication_order WHERE med_code = '617312')"""))
def cohort_of_long_code_lists(spark, sf_dir):
    """Lists of 5,000 codes for inclusion and exclusion: joined as tables, not written into the plan."""
    return _record_members(spark, sf_dir, LONG_RECORD)


@query("stored_definition_cohort", with_views("patient", "condition", "medication_order", "note_nlp_entity", then=RECORD_SQL))
def stored_definition_cohort(spark, sf_dir):
    """Re-run of a cohort from the JSON it was stored as."""
    return _record_members(spark, sf_dir, CriteriaRecord.from_json(RECORD.to_json()))


@query("cohort_by_sql", with_views("patient", "condition", "medication_order", "note_nlp_entity", then=RECORD_SQL))
def cohort_by_sql(spark, sf_dir):
    """The readable SQL of a record, run with named parameters."""
    text, parameters = cohort_sql(RECORD, AS_OF)
    return spark.sql(text, args=parameters, **load(spark, sf_dir, "patient", "condition", "medication_order", "note_nlp_entity"))


# --- single criteria -------------------------------------------------------------------------------------


def _one_criterion(spark, sf_dir, table: str, criterion: Criterion, keep: bool = True) -> DataFrame:
    tables = load(spark, sf_dir, "patient", table)
    expression = Has(criterion.id) if keep else Not(Has(criterion.id))
    spec = CohortSpec([criterion], AllOf(expression), F.lit(True))
    return cohort.evaluate(tables, spec).select("patient_sk")


@query("criterion_condition", with_views("condition", then=f"""
SELECT DISTINCT patient_sk FROM condition
WHERE condition_code IN ('E11.9', 'I50.9') AND clinical_status = 'active'
  AND recorded_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"""))
def criterion_condition(spark, sf_dir):
    """Diagnosis codes as typed, no status named: active ones count."""
    codes = criteria.split_codes(" e11.9,,i50.9 ", upper=True)
    return _one_criterion(spark, sf_dir, "condition", Criterion("c", "condition", criteria.condition_matches(codes, [], FIRST, LAST)))


@query("criterion_medication", with_views("medication_order", then=f"""
SELECT DISTINCT patient_sk FROM medication_order
WHERE med_code IN ('860975') AND order_status IN ('completed', 'active')
  AND CAST(start_datetime AS DATE) BETWEEN DATE '1999-03-01' AND DATE '1999-06-30'"""))
def criterion_medication(spark, sf_dir):
    matches = criteria.medication_matches(["860975"], ["completed", "active"], "1999-03-01", "1999-06-30")
    return _one_criterion(spark, sf_dir, "medication_order", Criterion("m", "medication_order", matches))


@query("criterion_lab", with_views("observation", then="""
SELECT DISTINCT patient_sk FROM observation
WHERE observation_code = '4548-4' AND value_numeric >= 6.5 AND value_numeric <= 9
  AND CAST(effective_datetime AS DATE) BETWEEN DATE '2000-01-05' AND DATE '2000-01-20'"""))
def criterion_lab(spark, sf_dir):
    """The whole last day of the window counts."""
    matches = criteria.lab_matches(" 4548-4", 6.5, 9.0, "2000-01-05", "2000-01-20")
    return _one_criterion(spark, sf_dir, "observation", Criterion("l", "observation", matches))


@query("criterion_lab_strict_window", with_views("observation", then="""
SELECT DISTINCT patient_sk FROM observation
WHERE observation_code = '8480-6' AND value_numeric >= 130
  AND effective_datetime BETWEEN TIMESTAMP '2000-01-05' AND TIMESTAMP '2000-01-20'"""))
def criterion_lab_strict_window(spark, sf_dir):
    """Only the lower threshold; the window ends at midnight at the start of its last day."""
    matches = criteria.lab_matches("8480-6", 130.0, None, "2000-01-05", "2000-01-20", strict_upper=True)
    return _one_criterion(spark, sf_dir, "observation", Criterion("l", "observation", matches))


@query("criterion_note_terms", with_views("note_nlp_entity", then="""
SELECT DISTINCT patient_sk FROM note_nlp_entity
WHERE (contains(lower(covered_text), 'diab') OR contains(lower(concept_display), 'diab')
       OR contains(lower(covered_text), 'y_c') OR contains(lower(concept_display), 'y_c')
       OR contains(lower(covered_text), '%') OR contains(lower(concept_display), '%') OR concept_code = '860975')
  AND NOT negation AND certainty IN ('positive', 'uncertain') AND temporality IN ('current', 'historical')
  AND entity_type IN ('problem', 'medication', 'finding') AND subject = 'patient'"""))
def criterion_note_terms(spark, sf_dir):
    """Terms as plain substrings (no wildcards) or an exact concept code, with the full trust filter."""
    matches = criteria.mention_matches(
        ["DIAB", "y_c", "%"], " 860975 ", certainty=["positive", "uncertain"], temporality=["current", "historical"],
        entity_types=["problem", "medication", "finding"], patient_only=True,
    )
    return _one_criterion(spark, sf_dir, "note_nlp_entity", Criterion("n", "note_nlp_entity", matches, "nlp"))


@query("criterion_demographics", with_views("patient", then=f"""
SELECT patient_sk FROM patient WHERE {AGE} BETWEEN 40 AND 65 AND sex IN ('female')"""))
def criterion_demographics(spark, sf_dir):
    patients = clinical_view(spark, sf_dir, "patient")
    return patients.filter(criteria.patient_matches(40, 65, ["female"], criteria.clinical.as_date(AS_OF))).select("patient_sk")


@query("exclusion_condition", with_views("patient", "condition", then="""
SELECT patient_sk FROM patient
WHERE patient_sk NOT IN (SELECT patient_sk FROM condition WHERE condition_code IN ('E11.9', 'I10'))"""))
def exclusion_condition(spark, sf_dir):
    """Whatever the status and date of the diagnosis."""
    matches = F.col("condition_code").isin("E11.9", "I10")
    return _one_criterion(spark, sf_dir, "condition", Criterion("x", "condition", matches), keep=False)


@query("exclusion_medication", with_views("patient", "medication_order", then="""
SELECT patient_sk FROM patient
WHERE patient_sk NOT IN (SELECT patient_sk FROM medication_order WHERE med_code IN ('285129', '665035'))"""))
def exclusion_medication(spark, sf_dir):
    matches = F.col("med_code").isin("285129", "665035")
    return _one_criterion(spark, sf_dir, "medication_order", Criterion("x", "medication_order", matches), keep=False)


@query("patients_with_codes", with_views("condition", then="""
SELECT DISTINCT patient_sk FROM condition WHERE condition_code IN ('R73.09', 'J06.9')"""))
def patients_with_codes(spark, sf_dir):
    """Code list longer than a predicate should hold: joined as a table."""
    conditions = clinical_view(spark, sf_dir, "condition")
    codes = ["R73.09", "J06.9"] + [f"X{n:04d}" for n in range(criteria.INLINE_CODES)]
    return criteria.rows_with_codes(conditions, "condition_code", codes).select("patient_sk").distinct()


# --- expressions, provenance, index dates ------------------------------------------------------------------


def nested_spec() -> CohortSpec:
    """((diabetes and metformin) or a note about diabetes) and no cerebral infarction."""
    return CohortSpec(
        [
            Criterion("t2dm", "condition", criteria.condition_matches(["E11.9"], ["active"], FIRST, LAST)),
            Criterion("metformin", "medication_order", F.col("med_code").isin("860975", "861007")),
            Criterion("note", "note_nlp_entity", criteria.mention_matches(["diabetes"], ""), "nlp"),
            Criterion("stroke", "condition", F.col("condition_code") == "I63.9"),
        ],
        AllOf(AnyOf(AllOf(Has("t2dm"), Has("metformin")), Has("note")), Not(Has("stroke"))),
        F.lit(True),
    )


_NESTED_SQL = f""", flags AS (
  SELECT p.patient_sk, t.d AS t2dm, m.d AS metformin, n.d AS note,
         t.patient_sk IS NOT NULL AS has_t2dm, m.patient_sk IS NOT NULL AS has_metformin, n.patient_sk IS NOT NULL AS has_note
  FROM patient AS p
  LEFT JOIN (SELECT patient_sk, min(recorded_date) AS d FROM condition WHERE condition_code = 'E11.9'
             AND clinical_status = 'active' AND recorded_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY 1) AS t
    ON p.patient_sk = t.patient_sk
  LEFT JOIN (SELECT patient_sk, min(CAST(start_datetime AS DATE)) AS d FROM medication_order
             WHERE med_code IN ('860975', '861007') GROUP BY 1) AS m ON p.patient_sk = m.patient_sk
  LEFT JOIN (SELECT e.patient_sk, min(CAST(c.service_date AS DATE)) AS d
             FROM note_nlp_entity AS e JOIN clinical_note AS c ON e.note_sk = c.note_sk
             WHERE (covered_text ILIKE '%diabetes%' OR concept_display ILIKE '%diabetes%') AND NOT negation
             AND certainty = 'positive' AND temporality = 'current' GROUP BY 1) AS n ON p.patient_sk = n.patient_sk
  WHERE p.patient_sk NOT IN (SELECT patient_sk FROM condition WHERE condition_code = 'I63.9')),
qualified AS (
  SELECT patient_sk, has_t2dm, has_metformin, has_note,
         least(CASE WHEN has_t2dm AND has_metformin THEN greatest(t2dm, metformin) END, note) AS index_date,
         CASE WHEN (has_t2dm OR has_metformin) AND has_note THEN 'both' WHEN has_note THEN 'nlp' ELSE 'coded' END AS qualifying_source
  FROM flags WHERE (has_t2dm AND has_metformin) OR has_note)"""


def _nested_tables(spark, sf_dir):
    tables = load(spark, sf_dir, "patient", "condition", "medication_order", "clinical_note", "note_nlp_entity")
    tables["note_nlp_entity"] = evidence.with_note_date(tables["note_nlp_entity"], tables["clinical_note"])
    return tables


_NESTED_VIEWS = ("patient", "condition", "medication_order", "clinical_note", "note_nlp_entity")


@query("cohort_and_or_groups", with_views(*_NESTED_VIEWS, then=_NESTED_SQL + """
SELECT patient_sk FROM qualified"""))
def cohort_and_or_groups(spark, sf_dir):
    return cohort.evaluate(_nested_tables(spark, sf_dir), nested_spec()).select("patient_sk")


@query("cohort_index_dates", with_views(*_NESTED_VIEWS, then=_NESTED_SQL + """
SELECT patient_sk, index_date, qualifying_source FROM qualified"""))
def cohort_index_dates(spark, sf_dir):
    """First date on which the expression held, and whether codes, notes or both speak for the patient."""
    return cohort.qualified_members(_nested_tables(spark, sf_dir), nested_spec())


_EVIDENCE_SQL = f""", evidence AS (
  SELECT patient_sk, 't2dm' AS criterion, 'coded' AS source, 'condition' AS "table", condition_sk AS ref_sk,
         condition_code AS code, recorded_date AS event_date
  FROM condition WHERE condition_code = 'E11.9' AND clinical_status = 'active'
                 AND recorded_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'
  UNION ALL
  SELECT patient_sk, 'metformin', 'coded', 'medication_order', med_order_sk, med_code, CAST(start_datetime AS DATE)
  FROM medication_order WHERE med_code IN ('860975', '861007')
  UNION ALL
  SELECT e.patient_sk, 'note', 'nlp', 'note_nlp_entity', entity_sk, concept_code, CAST(service_date AS DATE)
  FROM note_nlp_entity AS e JOIN clinical_note AS c ON e.note_sk = c.note_sk
  WHERE (covered_text ILIKE '%diabetes%' OR concept_display ILIKE '%diabetes%') AND NOT negation
    AND certainty = 'positive' AND temporality = 'current'),
kept AS (SELECT * FROM evidence WHERE patient_sk IN (SELECT patient_sk FROM qualified))"""


@query("cohort_evidence_rows", with_views(*_NESTED_VIEWS, then=_NESTED_SQL + _EVIDENCE_SQL + """
SELECT patient_sk, criterion, source, "table", ref_sk, code, event_date FROM kept"""))
def cohort_evidence_rows(spark, sf_dir):
    """Every row that speaks for a member, as rows."""
    tables = _nested_tables(spark, sf_dir)
    return cohort.member_evidence(tables, nested_spec(), cohort.qualified_members(tables, nested_spec()))


@query("cohort_evidence_triggers", with_views(*_NESTED_VIEWS, then=_NESTED_SQL + _EVIDENCE_SQL + """
SELECT patient_sk, criterion, source, "table", ref_sk, code, event_date, n_rows
FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY patient_sk, criterion) AS n_rows
      FROM kept WINDOW w AS (PARTITION BY patient_sk, criterion ORDER BY event_date, ref_sk)) AS r
WHERE rn = 1"""))
def cohort_evidence_triggers(spark, sf_dir):
    """Per member and criterion the row that first met it, unpacked from the member's evidence array."""
    members = cohort.members_with_evidence(_nested_tables(spark, sf_dir), nested_spec())
    return members.select("patient_sk", F.inline("qualifying_evidence"))


@query("stored_member_rows", with_views(*_NESTED_VIEWS, then=_NESTED_SQL + _EVIDENCE_SQL + """
SELECT 7 AS cohort_sk, q.patient_sk, q.index_date, q.qualifying_source, count(DISTINCT k.criterion) AS n_triggers,
       count(k.ref_sk) AS n_rows
FROM qualified AS q JOIN kept AS k ON q.patient_sk = k.patient_sk GROUP BY ALL"""))
def stored_member_rows(spark, sf_dir):
    """Member rows in the form they are stored in: typed by the table's schema, evidence as an array."""
    members = cohort.members_with_evidence(_nested_tables(spark, sf_dir), nested_spec())
    stored = conform(members.withColumns({"cohort_sk": F.lit(7), "run_id": F.lit("run")}), TABLES["cohort_member"])
    n_rows = F.aggregate("qualifying_evidence", F.lit(0).cast("long"), lambda total, e: total + e["n_rows"])
    return stored.select(
        "cohort_sk", "patient_sk", "index_date", "qualifying_source", F.size("qualifying_evidence").alias("n_triggers"),
        n_rows.alias("n_rows"),
    )


@query("members_from_captured_evidence", with_views(*_NESTED_VIEWS, then=_NESTED_SQL + """
SELECT patient_sk, index_date, qualifying_source FROM qualified"""))
def members_from_captured_evidence(spark, sf_dir):
    """The same members from evidence rows alone, as a prospective cohort captures them."""
    tables = _nested_tables(spark, sf_dir)
    rows = evidence.evidence_rows(tables, nested_spec().criteria)
    return capture.members_from_evidence(rows, tables["patient"], nested_spec())


@query("three_way_cohort", with_views("condition", "medication_order", then=f"""
SELECT patient_sk FROM condition WHERE condition_code = 'E11.9'
INTERSECT SELECT patient_sk FROM medication_order WHERE med_code IN ('860975', '861007')
INTERSECT SELECT patient_sk FROM condition WHERE condition_code IN ('I25.10', 'I50.9', 'I63.9')
          AND recorded_date >= DATE '{AS_OF}' - 730"""))
def three_way_cohort(spark, sf_dir):
    tables = load(spark, sf_dir, "condition", "medication_order")
    return cohort.three_way_cohort(tables["condition"], tables["medication_order"], AS_OF)


@query("control_cohort", with_views("patient", "condition", "medication_order", then=f"""
SELECT patient_sk, mrn, birth_date, sex, race FROM patient
WHERE {AGE} BETWEEN 18 AND 95
  AND patient_sk NOT IN (SELECT patient_sk FROM condition WHERE condition_code IN ('E11.9')
                         AND clinical_status = 'active' AND recorded_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}')
  AND patient_sk NOT IN (SELECT patient_sk FROM medication_order WHERE med_code IN ('860975') AND order_status = 'active'
                         AND CAST(start_datetime AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}')"""))
def control_cohort(spark, sf_dir):
    """Patients without the condition and without the exposure of the case cohort."""
    record = CriteriaRecord(icd_codes="E11.9", med_codes="860975", date_from=FIRST, date_to=LAST, min_age=18, max_age=95)
    return cohort.control_cohort(load(spark, sf_dir, "patient", "condition", "medication_order"), record, AS_OF)


@query("events_around_index", with_views("cohort_member", "encounter", then="""
SELECT m.patient_sk, m.index_date, e.encounter_sk, e.period_start
FROM cohort_member AS m JOIN encounter AS e ON m.patient_sk = e.patient_sk
WHERE m.cohort_sk = 1 AND CAST(e.period_start AS DATE) BETWEEN m.index_date - 365 AND m.index_date + 180"""))
def events_around_index(spark, sf_dir):
    """Encounters of members within a year before and half a year after their index date."""
    tables = load(spark, sf_dir, "cohort_member", "encounter")
    members = tables["cohort_member"].filter("cohort_sk = 1")
    return cohort.events_around_index(
        members, tables["encounter"], F.col("period_start").cast("date"), 365, 180
    ).select("patient_sk", "index_date", "encounter_sk", "period_start")


@query("age_at_index", with_views("cohort_member", "patient", then="""
SELECT m.cohort_sk, m.patient_sk, m.index_date, round(date_diff('day', birth_date, index_date) / 365.25, 4) AS age_at_index
FROM cohort_member AS m JOIN patient AS p ON m.patient_sk = p.patient_sk
WHERE date_diff('day', birth_date, index_date) / 365.25 BETWEEN 30 AND 70"""))
def age_at_index(spark, sf_dir):
    tables = load(spark, sf_dir, "cohort_member", "patient")
    aged = cohort.of_age_at_index(tables["cohort_member"], tables["patient"], 30, 70)
    return aged.select("cohort_sk", "patient_sk", "index_date", F.round("age_at_index", 4).alias("age_at_index"))


# --- stored definitions ----------------------------------------------------------------------------------


@query("definition_primary_concept", with_views("definition_library", then="""
SELECT cohort_sk,
       CASE WHEN trim(icd_codes) <> '' THEN trim(split_part(icd_codes, ',', 1))
            WHEN trim(med_codes) <> '' THEN trim(split_part(med_codes, ',', 1))
            WHEN trim(lab_code) <> '' THEN trim(lab_code) WHEN trim(nlp_concept) <> '' THEN trim(nlp_concept)
            ELSE trim(split_part(nlp_terms, ',', 1)) END AS primary_concept_code,
       CASE WHEN trim(icd_codes) <> '' THEN 'ICD-10-CM' WHEN trim(med_codes) <> '' THEN 'RxNorm'
            WHEN trim(lab_code) <> '' THEN 'LOINC' WHEN trim(nlp_concept) <> '' THEN 'SNOMED'
            ELSE 'NLP-term' END AS primary_concept_system
FROM definition_library"""))
def definition_primary_concept(spark, sf_dir):
    library = clinical_view(spark, sf_dir, "definition_library")
    code, system = criteria.primary_concept(*[F.col(c) for c in ("icd_codes", "med_codes", "lab_code", "nlp_concept", "nlp_terms")])
    return library.select("cohort_sk", code.alias("primary_concept_code"), system.alias("primary_concept_system"))


@query("definition_logic_fields", with_views("definition_library", then="""
SELECT cohort_sk, icd_codes, med_codes, nlp_terms, min_age, CAST(NULL AS DOUBLE) AS lab_min,
       len(list_filter(list_transform(string_split(icd_codes, ','), lambda x: trim(x)), lambda x: x <> '')) AS n_icd_codes
FROM definition_library"""))
def definition_logic_fields(spark, sf_dir):
    """Definitions to JSON as they are stored, and back to typed fields; code lists parsed."""
    library = clinical_view(spark, sf_dir, "definition_library")
    stored = library.select("cohort_sk", F.to_json(F.struct(
        "icd_codes", "med_codes", "lab_code", "nlp_terms", "nlp_concept", "min_age",
        F.lit(None).cast("double").alias("lab_min"), F.array().cast("array<string>").alias("sex_filter"),
    )).alias("definition_logic"))
    fields = stored.select("cohort_sk", criteria.parse_definition_logic(F.col("definition_logic")).alias("r"))
    return fields.select(
        "cohort_sk", "r.icd_codes", "r.med_codes", "r.nlp_terms", "r.min_age", "r.lab_min",
        F.size(criteria.clinical.parse_code_list(F.col("r.icd_codes"))).alias("n_icd_codes"),
    )


@query("definition_versions", with_views("definition_library", then="""
SELECT cohort_sk, name, row_number() OVER (PARTITION BY name ORDER BY created_at, cohort_sk) AS version,
       CASE WHEN row_number() OVER (PARTITION BY name ORDER BY created_at DESC, cohort_sk DESC) > 1 THEN 'archived'
            ELSE status END AS status
FROM definition_library"""))
def definition_versions(spark, sf_dir):
    versions = review.versioned(clinical_view(spark, sf_dir, "definition_library"))
    return versions.select("cohort_sk", "name", "version", "status")


@query("newest_definition", with_views("definition_library", then="""
SELECT name, cohort_sk FROM (SELECT name, cohort_sk, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, cohort_sk DESC) AS rn
                             FROM definition_library) AS d WHERE rn = 1"""))
def newest_definition(spark, sf_dir):
    return review.newest_definition(clinical_view(spark, sf_dir, "definition_library"))


@query("definition_status", with_views("definition_library", "status_change", then="""
SELECT d.cohort_sk, coalesce(c.status, d.status) AS status
FROM definition_library AS d
LEFT JOIN (SELECT cohort_sk, status, row_number() OVER (PARTITION BY cohort_sk ORDER BY changed_at DESC, status DESC) AS rn
           FROM status_change) AS c ON d.cohort_sk = c.cohort_sk AND c.rn = 1"""))
def definition_status(spark, sf_dir):
    """Status of each definition after all logged changes."""
    tables = load(spark, sf_dir, "definition_library", "status_change")
    return review.current_status(tables["definition_library"], tables["status_change"]).select("cohort_sk", "status")
