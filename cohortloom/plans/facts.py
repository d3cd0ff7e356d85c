"""Queries on statistics, positions, features, enrichment and data quality of the clinical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import clinical, codes, text
from cohortloom.operators import enrich, features, profile, quality, ranking, review
from cohortloom.operators.evidence import with_note_date
from cohortloom.plans.registry import AS_OF, query, sql_text, values_view
from cohortloom.sources.fixtures import clinical_view, load, with_views

DAY = f"DATE '{AS_OF}'"

# --- statistics ----------------------------------------------------------------------------------------


@query("drug_share", with_views("patient", "medication_order", then="""
SELECT n_on_drug, n_patients, round(n_on_drug / n_patients * 100, 1) AS pct
FROM (SELECT count(DISTINCT patient_sk) AS n_on_drug FROM medication_order WHERE med_code IN ('860975', '861007')) AS d,
     (SELECT count(*) AS n_patients FROM patient) AS p"""))
def drug_share(spark, sf_dir):
    tables = load(spark, sf_dir, "patient", "medication_order")
    return profile.drug_share(tables["patient"], tables["medication_order"])


@query("hba1c_distribution", with_views("observation", then="""
SELECT round(avg(value_numeric), 2) AS mean_value, round(quantile_cont(value_numeric, 0.25), 2) AS p25,
       round(quantile_cont(value_numeric, 0.75), 2) AS p75, count(*) AS n
FROM observation WHERE observation_code = '4548-4'"""))
def hba1c_distribution(spark, sf_dir):
    return profile.lab_distribution(clinical_view(spark, sf_dir, "observation"), "4548-4")


@query("note_category_counts", with_views("clinical_note", then="\nSELECT note_category, count(*) AS n FROM clinical_note GROUP BY 1"))
def note_category_counts(spark, sf_dir):
    return profile.counts_by(clinical_view(spark, sf_dir, "clinical_note"), "note_category")


PHENOTYPE_SQL = """, flags AS (
  SELECT p.patient_sk,
         p.patient_sk IN (SELECT patient_sk FROM condition WHERE condition_code = 'E11.9') AS t2dm,
         p.patient_sk IN (SELECT patient_sk FROM condition WHERE condition_code IN ('I25.10', 'I50.9', 'I63.9')) AS cvd,
         p.patient_sk IN (SELECT patient_sk FROM condition WHERE condition_code = 'I10') AS htn,
         p.patient_sk IN (SELECT patient_sk FROM condition WHERE condition_code = 'R73.09') AS pre,
         p.patient_sk IN (SELECT patient_sk FROM medication_order WHERE med_code IN ('860975', '861007')) AS metformin
  FROM patient AS p),
phenotype AS (
  SELECT patient_sk, CASE WHEN t2dm AND metformin AND cvd THEN 't2dm_cvd' WHEN t2dm AND metformin THEN 't2dm_only'
         WHEN t2dm THEN 't2dm_alt_med' WHEN htn THEN 'hypertension' WHEN pre THEN 'prediabetes' ELSE 'general' END AS phenotype
  FROM flags)"""
_PHENOTYPE_VIEWS = ("patient", "condition", "medication_order")


def _phenotypes(spark, sf_dir):
    tables = load(spark, sf_dir, *_PHENOTYPE_VIEWS)
    return features.phenotypes(tables["patient"], tables["condition"], tables["medication_order"])


@query("phenotypes", with_views(*_PHENOTYPE_VIEWS, then=PHENOTYPE_SQL + "\nSELECT patient_sk, phenotype FROM phenotype"))
def phenotypes(spark, sf_dir):
    return _phenotypes(spark, sf_dir)


@query("phenotype_histogram", with_views(*_PHENOTYPE_VIEWS, then=PHENOTYPE_SQL + """
SELECT phenotype, count(*) AS n, round(count(*) / (SELECT count(*) FROM patient) * 100, 1) AS pct
FROM phenotype GROUP BY phenotype"""))
def phenotype_histogram(spark, sf_dir):
    return profile.histogram(_phenotypes(spark, sf_dir), "phenotype")


@query("hba1c_by_phenotype", with_views(*_PHENOTYPE_VIEWS, "observation", then=PHENOTYPE_SQL + """
SELECT phenotype, round(avg(value_numeric), 2) AS mean_value, count(*) AS n_results
FROM observation AS o JOIN phenotype AS p ON o.patient_sk = p.patient_sk
WHERE observation_code = '4548-4' AND value_numeric IS NOT NULL GROUP BY phenotype"""))
def hba1c_by_phenotype(spark, sf_dir):
    observations = clinical_view(spark, sf_dir, "observation")
    return profile.lab_mean_by_group(observations, _phenotypes(spark, sf_dir), "phenotype", "4548-4")


@query("children_per_parent", with_views("patient", "encounter", "condition", "medication_order", "procedure", then="""
SELECT 'encounters per patient' AS pair, round((SELECT count(*) FROM encounter) / (SELECT count(*) FROM patient), 1) AS mean_children
UNION ALL SELECT 'conditions per encounter', round((SELECT count(*) FROM condition) / (SELECT count(*) FROM encounter), 1)
UNION ALL SELECT 'orders per encounter', round((SELECT count(*) FROM medication_order) / (SELECT count(*) FROM encounter), 1)
UNION ALL SELECT 'procedures per encounter', round((SELECT count(*) FROM procedure) / (SELECT count(*) FROM encounter), 1)"""))
def children_per_parent(spark, sf_dir):
    t = load(spark, sf_dir, "patient", "encounter", "condition", "medication_order", "procedure")
    return profile.children_per_parent([
        ("encounters per patient", t["encounter"], t["patient"]),
        ("conditions per encounter", t["condition"], t["encounter"]),
        ("orders per encounter", t["medication_order"], t["encounter"]),
        ("procedures per encounter", t["procedure"], t["encounter"]),
    ])


_COUNTED = ("patient", "encounter", "condition", "observation", "medication_order", "procedure", "clinical_note")


@query("table_row_counts", with_views(*_COUNTED, then="\n" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {name}" for name in _COUNTED)))
def table_row_counts(spark, sf_dir):
    return review.row_counts(load(spark, sf_dir, *_COUNTED))


# --- positions -----------------------------------------------------------------------------------------


@query("encounter_index", with_views("encounter", then="""
SELECT patient_sk, encounter_sk, row_number() OVER w - 1 AS encounter_index, row_number() OVER w = 1 AS is_first
FROM encounter WINDOW w AS (PARTITION BY patient_sk ORDER BY period_start, encounter_sk)"""))
def encounter_index(spark, sf_dir):
    indexed = ranking.encounter_index(clinical_view(spark, sf_dir, "encounter"))
    return indexed.select("patient_sk", "encounter_sk", "encounter_index", "is_first")


@query("diagnosis_rank", with_views("condition", then="""
SELECT encounter_sk, condition_sk, condition_code,
       CASE WHEN condition_code = 'J06.9' THEN 1 + count(*) FILTER (WHERE condition_code <> 'J06.9') OVER (PARTITION BY encounter_sk)
            ELSE row_number() OVER (PARTITION BY encounter_sk, condition_code = 'J06.9' ORDER BY recorded_date, condition_sk) END AS diagnosis_rank
FROM condition"""))
def diagnosis_rank(spark, sf_dir):
    ranked = ranking.diagnosis_rank(clinical_view(spark, sf_dir, "condition"), codes.BACKGROUND_ICD10)
    return ranked.select("encounter_sk", "condition_sk", "condition_code", "diagnosis_rank")


def _latest_sql(code: str) -> str:
    return (
        "(SELECT patient_sk, value_numeric AS v FROM (SELECT *, row_number() OVER (PARTITION BY patient_sk"
        " ORDER BY effective_datetime DESC, observation_sk DESC) AS rn FROM observation"
        f" WHERE observation_code = '{code}' AND value_numeric IS NOT NULL) AS x WHERE rn = 1)"
    )


@query("latest_values", with_views("observation", then=f"""
SELECT ids.patient_sk, a.v AS last_a1c, s.v AS last_bp_systolic, d.v AS last_bp_diastolic, b.v AS last_bmi
FROM (SELECT DISTINCT patient_sk FROM observation WHERE value_numeric IS NOT NULL) AS ids
LEFT JOIN {_latest_sql("4548-4")} AS a ON ids.patient_sk = a.patient_sk
LEFT JOIN {_latest_sql("8480-6")} AS s ON ids.patient_sk = s.patient_sk
LEFT JOIN {_latest_sql("8462-4")} AS d ON ids.patient_sk = d.patient_sk
LEFT JOIN {_latest_sql("39156-5")} AS b ON ids.patient_sk = b.patient_sk"""))
def latest_values(spark, sf_dir):
    return ranking.latest_values(clinical_view(spark, sf_dir, "observation"), features.LATEST_VALUE_CODES)


@query("latest_signed_note", with_views("note_version", then="""
SELECT note_id, version_id, status, filed_at, n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY filed_at DESC, version_id DESC) AS rn
      FROM note_version WHERE status IN ('signed', 'addended')) AS v WHERE rn = 1"""))
def latest_signed_note(spark, sf_dir):
    return ranking.latest_signed_note(clinical_view(spark, sf_dir, "note_version"))


# --- features ------------------------------------------------------------------------------------------

_FEATURE_VIEWS = ("patient", "encounter", "condition", "medication_order", "observation", "clinical_note", "note_nlp_entity")


def _feature_tables(spark, sf_dir):
    tables = load(spark, sf_dir, *_FEATURE_VIEWS)
    tables["note_nlp_entity"] = with_note_date(tables["note_nlp_entity"], tables["clinical_note"])
    return tables


@query("patient_features", with_views(*_FEATURE_VIEWS, then=f"""
SELECT p.patient_sk, CAST(floor(date_diff('day', birth_date, {DAY}) / 365.25) AS INT) AS age_years, sex, race, ethnicity,
       coalesce(e.n, 0) AS encounter_count, coalesce(e.n_in, 0) AS inpatient_count, coalesce(e.n_ed, 0) AS ed_count,
       coalesce(c.n, 0) AS active_problem_count, coalesce(m.n, 0) AS distinct_med_count,
       a.v AS last_a1c, s.v AS last_bp_systolic, d.v AS last_bp_diastolic, b.v AS last_bmi,
       coalesce(f.n, 0) AS nlp_finding_count, {DAY} AS feature_asof_date
FROM patient AS p
LEFT JOIN (SELECT patient_sk, count(*) AS n, count(*) FILTER (WHERE encounter_class = 'inpatient') AS n_in,
                  count(*) FILTER (WHERE encounter_class = 'emergency') AS n_ed
           FROM encounter WHERE CAST(period_start AS DATE) <= {DAY} GROUP BY 1) AS e ON p.patient_sk = e.patient_sk
LEFT JOIN (SELECT patient_sk, count(DISTINCT condition_code) AS n FROM condition
           WHERE clinical_status = 'active' AND recorded_date <= {DAY} GROUP BY 1) AS c ON p.patient_sk = c.patient_sk
LEFT JOIN (SELECT patient_sk, count(DISTINCT med_code) AS n FROM medication_order
           WHERE CAST(start_datetime AS DATE) <= {DAY} GROUP BY 1) AS m ON p.patient_sk = m.patient_sk
LEFT JOIN {_latest_sql("4548-4")} AS a ON p.patient_sk = a.patient_sk
LEFT JOIN {_latest_sql("8480-6")} AS s ON p.patient_sk = s.patient_sk
LEFT JOIN {_latest_sql("8462-4")} AS d ON p.patient_sk = d.patient_sk
LEFT JOIN {_latest_sql("39156-5")} AS b ON p.patient_sk = b.patient_sk
LEFT JOIN (SELECT x.patient_sk, count(DISTINCT coalesce(concept_code, lower(covered_text))) AS n
           FROM note_nlp_entity AS x JOIN clinical_note AS t ON x.note_sk = t.note_sk
           WHERE NOT negation AND certainty = 'positive' AND temporality = 'current' AND CAST(service_date AS DATE) <= {DAY}
           GROUP BY 1) AS f ON p.patient_sk = f.patient_sk"""))
def patient_features(spark, sf_dir):
    return features.patient_features(_feature_tables(spark, sf_dir), AS_OF)


@query("patient_trends", with_views("patient", "encounter", "condition", "observation", then=f"""
SELECT p.patient_sk, round(o.slope, 8) AS a1c_slope_per_day,
       round(e.n / (greatest(date_diff('day', e.first, {DAY}), 1) / 365.25), 8) AS encounters_per_year,
       coalesce(c.n, 0) AS chronic_condition_count
FROM patient AS p
LEFT JOIN (SELECT patient_sk, regr_slope(value_numeric, CAST(date_diff('day', DATE '2000-01-01', CAST(effective_datetime AS DATE)) AS DOUBLE)) AS slope
           FROM observation WHERE observation_code = '4548-4' AND value_numeric IS NOT NULL
           AND CAST(effective_datetime AS DATE) <= {DAY} GROUP BY 1) AS o ON p.patient_sk = o.patient_sk
LEFT JOIN (SELECT patient_sk, count(*) AS n, min(CAST(period_start AS DATE)) AS first FROM encounter
           WHERE CAST(period_start AS DATE) <= {DAY} GROUP BY 1) AS e ON p.patient_sk = e.patient_sk
LEFT JOIN (SELECT patient_sk, count(DISTINCT condition_code) AS n FROM condition
           WHERE is_chronic AND recorded_date <= {DAY} GROUP BY 1) AS c ON p.patient_sk = c.patient_sk"""))
def patient_trends(spark, sf_dir):
    trends = features.patient_trends(load(spark, sf_dir, "patient", "encounter", "condition", "observation"), AS_OF)
    return trends.withColumns({name: F.round(name, 8) for name in ("a1c_slope_per_day", "encounters_per_year")})


@query("cardiovascular_risk", with_views("condition", "medication_order", then="""
SELECT patient_sk, bool_or(cvd) AS has_cvd, bool_or(cvd) OR (bool_or(factor) AND bool_or(treated)) AS cv_risk_flag
FROM (SELECT patient_sk, condition_code IN ('I25.10', 'I50.9', 'I63.9') AS cvd, condition_code IN ('E11.9', 'I10') AS factor,
             false AS treated FROM condition WHERE condition_code IN ('I25.10', 'I50.9', 'I63.9', 'E11.9', 'I10')
      UNION ALL SELECT patient_sk, false, false, true FROM medication_order WHERE order_status = 'active') AS f
GROUP BY patient_sk"""))
def cardiovascular_risk(spark, sf_dir):
    tables = load(spark, sf_dir, "condition", "medication_order")
    return features.cardiovascular_risk(tables["condition"], tables["medication_order"])


# --- enrichment ----------------------------------------------------------------------------------------

_READINGS = """, reading AS (
  SELECT event_id * 3 AS observation_sk, user_id AS patient_sk, 90 + floor(value / 5) + 0.25 AS sys, 55 + floor(value / 6) + 0.5 AS dia FROM events)"""


@query("bp_panels", "WITH " + _READINGS[2:] + """
SELECT observation_sk, patient_sk, '85354-9' AS observation_code, CAST(NULL AS DOUBLE) AS value_numeric,
       concat(CAST(CAST(round(sys) AS BIGINT) AS VARCHAR), '/', CAST(CAST(round(dia) AS BIGINT) AS VARCHAR)) AS value_string,
       NULL AS interpretation, CAST(NULL AS BIGINT) AS parent_observation_sk FROM reading
UNION ALL
SELECT observation_sk + 1, patient_sk, '8480-6', round(sys, 1), NULL,
       CASE WHEN sys <= 130 THEN 'normal' WHEN sys <= 160 THEN 'high' ELSE 'critical' END, observation_sk FROM reading
UNION ALL
SELECT observation_sk + 2, patient_sk, '8462-4', round(dia, 1), NULL,
       CASE WHEN dia <= 85 THEN 'normal' ELSE 'high' END, observation_sk FROM reading""")
def bp_panels(spark, sf_dir):
    readings = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("event_id") * 3).alias("observation_sk"), F.col("user_id").alias("patient_sk"),
        (90 + F.floor(F.col("value") / 5) + 0.25).alias("sys"), (55 + F.floor(F.col("value") / 6) + 0.5).alias("dia"),
    )
    return enrich.bp_panel(readings, "sys", "dia")


@query("bp_text_components", with_views("bp_text", then=r""", parsed AS (
  SELECT observation_sk, patient_sk, regexp_extract(value_string, '^\s*(\d{2,3})\s*/\s*(\d{2,3})\s*$', 1) AS s,
         regexp_extract(value_string, '^\s*(\d{2,3})\s*/\s*(\d{2,3})\s*$', 2) AS d
  FROM bp_text WHERE value_string IS NOT NULL)
SELECT observation_sk AS parent_observation_sk, patient_sk, '8480-6' AS observation_code, CAST(s AS DOUBLE) AS value_numeric
FROM parsed WHERE s <> ''
UNION ALL SELECT observation_sk, patient_sk, '8462-4', CAST(d AS DOUBLE) FROM parsed WHERE s <> ''"""))
def bp_text_components(spark, sf_dir):
    return enrich.bp_components(clinical_view(spark, sf_dir, "bp_text"))


@query("bp_component_join", with_views("observation", then="""
SELECT p.observation_sk AS panel_sk, p.value_string AS panel_value, c.observation_sk, c.patient_sk, c.observation_code, c.value_numeric
FROM observation AS c JOIN observation AS p ON c.parent_observation_sk = p.observation_sk
WHERE p.observation_code = '85354-9' AND c.observation_code IN ('8480-6', '8462-4')"""))
def bp_component_join(spark, sf_dir):
    return enrich.components_with_panel(clinical_view(spark, sf_dir, "observation"))


@query("interpreted_observations", with_views("observation", then=", " + values_view("loinc", "code, display, unit, low, high", codes.LOINC) + """
SELECT observation_sk, observation_code, value_numeric, display AS observation_display, unit,
       CASE WHEN observation_code = '8480-6' THEN CASE WHEN value_numeric <= 130 THEN 'normal' WHEN value_numeric <= 160 THEN 'high'
                                                       WHEN value_numeric IS NOT NULL THEN 'critical' END
            WHEN observation_code = '8462-4' THEN CASE WHEN value_numeric <= 85 THEN 'normal' WHEN value_numeric IS NOT NULL THEN 'high' END
            WHEN value_numeric IS NULL OR low IS NULL THEN NULL
            WHEN value_numeric BETWEEN low AND high THEN 'normal' WHEN value_numeric > high THEN 'high' ELSE 'low' END AS interpretation
FROM observation LEFT JOIN loinc ON observation_code = code"""))
def interpreted_observations(spark, sf_dir):
    out = enrich.interpreted(clinical_view(spark, sf_dir, "observation"))
    return out.select("observation_sk", "observation_code", "value_numeric", "observation_display", "unit", "interpretation")


@query("condition_names", with_views("condition", then=", " + values_view("icd", "code, display, is_chronic", codes.ICD10) + """
SELECT condition_sk, condition_code, coalesce(display, concat('Diagnosis ', condition_code)) AS condition_display
FROM condition LEFT JOIN icd ON condition_code = code"""))
def condition_names(spark, sf_dir):
    named = codes.with_code_details(
        clinical_view(spark, sf_dir, "condition"), "condition_code", "icd10", {"display": "condition_display"}, "Diagnosis"
    )
    return named.select("condition_sk", "condition_code", "condition_display")


@query("order_details", with_views("medication_order", "encounter", then=", " + values_view("rx", "code, display, dose, unit, route, frequency, sig", codes.MEDICATIONS) + """
SELECT med_order_sk, med_code, coalesce(display, concat('Medication ', med_code)) AS med_display, route, frequency,
       CASE WHEN encounter_class = 'inpatient' THEN 'inpatient' ELSE 'outpatient' END AS order_class,
       strftime(start_datetime + INTERVAL 2 DAY, '%Y-%m-%d') AS discharge_day, start_datetime - INTERVAL 2 HOUR AS lab_time,
       start_datetime + INTERVAL 30 DAY AS ends
FROM medication_order AS m LEFT JOIN rx ON med_code = code JOIN encounter AS e ON m.encounter_sk = e.encounter_sk"""))
def order_details(spark, sf_dir):
    """Drug names and directions, order class from the encounter, and the date rules."""
    tables = load(spark, sf_dir, "medication_order", "encounter")
    named = codes.with_code_details(
        tables["medication_order"], "med_code", "rxnorm",
        {"display": "med_display", "route": "route", "frequency": "frequency"}, "Medication",
    )
    start = F.col("start_datetime")
    return named.join(tables["encounter"].select("encounter_sk", "encounter_class"), "encounter_sk").select(
        "med_order_sk", "med_code", "med_display", "route", "frequency",
        clinical.order_class(F.col("encounter_class")).alias("order_class"),
        clinical.discharge_day(start).alias("discharge_day"), clinical.lab_time(start).alias("lab_time"),
        clinical.order_end(start, F.lit(30)).alias("ends"),
    )


@query("order_directions", with_views("medication_order", then=", " + values_view("rx", "code, display, dose, unit, route, frequency, sig", codes.MEDICATIONS) + """
SELECT med_order_sk, med_code, dose AS dose_quantity, unit AS dose_unit, route, frequency, sig AS sig_text
FROM medication_order LEFT JOIN rx ON med_code = code"""))
def order_directions(spark, sf_dir):
    """Dose, unit, route and directions of each order by its drug code; unknown codes keep their order."""
    take = ("dose_quantity", "dose_unit", "route", "frequency", "sig_text")
    orders = clinical_view(spark, sf_dir, "medication_order").select("med_order_sk", "med_code")
    return codes.with_code_details(orders, "med_code", "rxnorm", {name: name for name in take}).select("med_order_sk", "med_code", *take)


@query("chronic_conditions", with_views("condition", then=", " + values_view("icd", "code, display, is_chronic", codes.ICD10) + """
SELECT condition_sk, condition_code, coalesce(icd.is_chronic, false) AS is_chronic FROM condition LEFT JOIN icd ON condition_code = code"""))
def chronic_conditions(spark, sf_dir):
    """Whether a diagnosis is a chronic one by its code; unknown codes aren't."""
    conditions = clinical_view(spark, sf_dir, "condition").select("condition_sk", "condition_code")
    named = codes.with_code_details(conditions, "condition_code", "icd10", {"is_chronic": "_chronic"})
    return named.select("condition_sk", "condition_code", F.coalesce("_chronic", F.lit(False)).alias("is_chronic"))


@query("procedure_details", with_views("procedure", then=", " + values_view("cpt", "code, display, category", codes.CPT) + """
SELECT procedure_sk, procedure_code, display AS procedure_display, category AS known_category
FROM procedure LEFT JOIN cpt ON procedure_code = code"""))
def procedure_details(spark, sf_dir):
    return codes.with_code_details(
        clinical_view(spark, sf_dir, "procedure"), "procedure_code", "cpt",
        {"display": "procedure_display", "category": "known_category"},
    ).select("procedure_sk", "procedure_code", "procedure_display", "known_category")


def _categorised(spark, sf_dir):
    indexed = ranking.encounter_index(clinical_view(spark, sf_dir, "encounter"))
    return indexed.withColumn("note_category", clinical.note_category(F.col("encounter_class"), F.col("is_first")))


_CATEGORY_SQL = """, categorised AS (
  SELECT *, CASE WHEN encounter_class = 'inpatient' THEN 'discharge_summary'
            WHEN row_number() OVER (PARTITION BY patient_sk ORDER BY period_start, encounter_sk) = 1 THEN 'hp'
            ELSE 'progress' END AS note_category
  FROM encounter)"""


@query("note_categories", with_views("encounter", then=_CATEGORY_SQL + """
SELECT encounter_sk, note_category,
       CASE note_category WHEN 'discharge_summary' THEN '18842-5' WHEN 'hp' THEN '34117-2' ELSE '11506-3' END AS note_type_code,
       CASE note_category WHEN 'discharge_summary' THEN 'Discharge summary' WHEN 'hp' THEN 'History and physical note'
            ELSE 'Progress note' END AS note_type_display
FROM categorised"""))
def note_categories(spark, sf_dir):
    """Category and document type of the note each encounter calls for."""
    category = F.col("note_category")
    return _categorised(spark, sf_dir).select(
        "encounter_sk", "note_category", codes.note_type_code(category).alias("note_type_code"),
        codes.note_type_display(category).alias("note_type_display"),
    )


# What the templates below show where a row supplies nothing.
TEMPLATE_DEFAULTS = {"provider": "the doctor on duty", "facility": "the clinic", "systolic": "n/a", "diastolic": "n/a", "hba1c": "n/a", "glucose": "n/a"}
# Own short templates: note category, phenotype, template.
TEMPLATES = [
    ("progress", "general", "Progress note for {name}, seen by {provider}. BP {systolic}/{diastolic}."),
    ("progress", "general", "{name} ({mrn}) feels well on {service_date}. {unknown_key} stays."),
    ("progress", "t2dm_cvd", "{name} continues metformin for diabetes and heart disease. HbA1c {hba1c}%."),
    ("progress", "hypertension", "Blood pressure check of {name}: {systolic}/{diastolic}."),
    ("hp", "t2dm_cvd", "New patient {name}, {sex}, with diabetes and heart disease. Glucose {glucose}."),
    ("discharge_summary", "t2dm_cvd", "{name} was admitted on {admit_date} and left on {disch_date}; {provider}, {facility}."),
]


def _rendered_sql(template: str) -> str:
    """The template rules in SQL: supplied values first, defaults for the rest."""
    given = {
        "name": "concat('Patient ', CAST(patient_sk AS VARCHAR))", "mrn": "mrn", "provider": "attending_provider_name",
        "facility": "facility_name", "sex": "sex", "admit_date": "strftime(period_start, '%Y-%m-%d')",
        "service_date": "strftime(period_start, '%Y-%m-%d')", "disch_date": "strftime(period_start + INTERVAL 2 DAY, '%Y-%m-%d')",
    }
    out = template
    for key in {**given, **TEMPLATE_DEFAULTS}:
        default = sql_text(TEMPLATE_DEFAULTS.get(key, "{" + key + "}"))
        value = f"coalesce({given[key]}, {default})" if key in given else default
        out = f"replace({out}, '{{{key}}}', {value})"
    return out


_POOLS: dict[tuple[str, str], list[str]] = {}
for _category, _phenotype, _template in TEMPLATES:
    _POOLS.setdefault((_category, _phenotype), []).append(_template)
_TEMPLATE_CASE = "CASE " + " ".join(
    f"WHEN note_category = '{category}' AND phenotype = '{phenotype}' THEN [{', '.join(map(sql_text, pool))}]"
    for (category, phenotype), pool in _POOLS.items()
) + f" ELSE [{', '.join(map(sql_text, _POOLS[('progress', 'general')]))}] END"


@query("rendered_notes", with_views("encounter", *_PHENOTYPE_VIEWS, then=_CATEGORY_SQL + PHENOTYPE_SQL + f""", chosen AS (
  SELECT c.*, p.sex, p.mrn, ph.phenotype, {_TEMPLATE_CASE} AS pool
  FROM categorised AS c JOIN patient AS p ON c.patient_sk = p.patient_sk JOIN phenotype AS ph ON c.patient_sk = ph.patient_sk),
picked AS (SELECT *, pool[encounter_sk % len(pool) + 1] AS template FROM chosen)
SELECT encounter_sk, note_category, phenotype, {_rendered_sql("template")} AS note_text FROM picked"""))
def rendered_notes(spark, sf_dir):
    """A note for every encounter, from the template of its category and the patient's phenotype."""
    patients = clinical_view(spark, sf_dir, "patient").select("patient_sk", "sex", "mrn")
    encounters = _categorised(spark, sf_dir).join(patients, "patient_sk").join(_phenotypes(spark, sf_dir), "patient_sk")
    day = F.date_format("period_start", "yyyy-MM-dd")
    values = {
        "name": F.concat(F.lit("Patient "), F.col("patient_sk").cast("string")), "mrn": F.col("mrn"),
        "provider": F.col("attending_provider_name"), "facility": F.col("facility_name"), "sex": F.col("sex"),
        "admit_date": day, "service_date": day, "disch_date": clinical.discharge_day(F.col("period_start")),
    }
    return enrich.notes_from_templates(encounters, TEMPLATES, values, TEMPLATE_DEFAULTS).select("encounter_sk", "note_category", "phenotype", "note_text")


@query("clamped_values", """
SELECT event_id, round(least(greatest(value, 17.0), 55.0), 1) AS bmi, least(greatest(value, 90.0), 190.0) AS systolic,
       concat('MRN-', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS mrn
FROM events""")
def clamped_values(spark, sf_dir):
    value = F.col("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", clinical.clamp(value, 17.0, 55.0, 1).alias("bmi"), clinical.clamp(value, 90.0, 190.0).alias("systolic"),
        clinical.mrn(F.col("user_id")).alias("mrn"),
    )


# --- data quality ----------------------------------------------------------------------------------------

_FK_SQL = []
for _child, _column, _parent, _parent_column in [
    ("encounter", "patient_sk", "patient", "patient_sk"), ("condition", "patient_sk", "patient", "patient_sk"),
    ("observation", "patient_sk", "patient", "patient_sk"), ("medication_order", "patient_sk", "patient", "patient_sk"),
    ("procedure", "patient_sk", "patient", "patient_sk"), ("clinical_note", "patient_sk", "patient", "patient_sk"),
    ("note_nlp_entity", "note_sk", "clinical_note", "note_sk"), ("note_nlp_entity", "patient_sk", "patient", "patient_sk"),
    ("cohort_member", "cohort_sk", "cohort_definition", "cohort_sk"), ("cohort_member", "patient_sk", "patient", "patient_sk"),
]:
    _FK_SQL.append(
        f"SELECT '{_child}.{_column}' AS foreign_key, '{_parent}' AS parent, count(*) AS n_rows, count(DISTINCT {_column}) AS n_keys"
        f" FROM {_child} WHERE {_column} NOT IN (SELECT {_parent_column} FROM {_parent})"
    )
_FK_VIEWS = (*_COUNTED, "note_nlp_entity", "cohort_definition", "cohort_member")


@query("referential_integrity", with_views(*_FK_VIEWS, then="\n" + "\nUNION ALL ".join(_FK_SQL)))
def referential_integrity(spark, sf_dir):
    return quality.referential_integrity(load(spark, sf_dir, *_FK_VIEWS))


@query("orphan_keys", """
SELECT 'observation.patient_sk' AS foreign_key, 'patient' AS parent, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_keys
FROM lineitem WHERE l_partkey NOT IN (SELECT c_custkey FROM customer)""")
def orphan_keys(spark, sf_dir):
    """The same check on rows whose key is often not there."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("patient_sk"))
    return quality.referential_integrity({"observation": rows, "patient": clinical_view(spark, sf_dir, "patient")})


_KEYS = {"patient": ("patient_sk", "mrn"), "encounter": ("encounter_sk", "patient_sk"), "condition": ("condition_sk", "patient_sk"),
         "procedure": ("procedure_sk", "patient_sk"), "clinical_note": ("note_sk", "patient_sk")}


@query("key_checks", with_views(*_KEYS, "diagnosis_entry", then="\n" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows, count(*) FILTER (WHERE {key} IS NULL) AS n_null_keys,"
    f" (SELECT count(*) FROM (SELECT {key} FROM {name} WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1) AS r) AS n_repeated_keys,"
    f" count(*) FILTER (WHERE {required} IS NULL) AS n_null_required FROM {name}" for name, (key, required) in _KEYS.items()
) + """
UNION ALL SELECT 'nlp_run', count(*), 0, (SELECT count(*) FROM (SELECT dx_id FROM diagnosis_entry GROUP BY 1 HAVING count(*) > 1) AS r), 0
FROM diagnosis_entry"""))
def key_checks(spark, sf_dir):
    """Clinical tables, and one table whose key repeats."""
    tables = load(spark, sf_dir, *_KEYS)
    tables["nlp_run"] = clinical_view(spark, sf_dir, "diagnosis_entry").select(F.col("dx_id").alias("nlp_run_sk"))
    return quality.key_checks(tables)


@query("value_set_checks", with_views("encounter", "appointment", then="""
SELECT 'encounter.status' AS coded_column, status AS value, count(*) AS n_rows
FROM appointment WHERE status NOT IN ('planned', 'arrived', 'in-progress', 'finished', 'cancelled') GROUP BY 2"""))
def value_set_checks(spark, sf_dir):
    """Clinical tables conform; appointments taken for encounters do not."""
    tables = load(spark, sf_dir, "patient", "condition", "medication_order", "procedure", "clinical_note", "note_nlp_entity")
    tables["encounter"] = clinical_view(spark, sf_dir, "appointment")
    return quality.value_set_checks(tables)


@query("unknown_codes", with_views("medication_order", then=", " + values_view("rx", "code, display, dose, unit, route, frequency, sig", codes.MEDICATIONS[:2]) + """
SELECT med_code, count(*) AS n_rows FROM medication_order WHERE med_code NOT IN (SELECT code FROM rx) GROUP BY med_code"""))
def unknown_codes(spark, sf_dir):
    known = codes.code_table(spark, "rxnorm").filter(F.col("code").isin(codes.METFORMIN))
    return quality.unknown_codes(clinical_view(spark, sf_dir, "medication_order"), "med_code", known)
