"""One wide row per patient: demographics, utilisation, burden, newest values, note findings, trends, risk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import clinical, codes
from cohortloom.operators.criteria import trusted_mention
from cohortloom.operators.ranking import latest_values

# LOINC codes of the newest-value columns.
LATEST_VALUE_CODES = {
    "last_a1c": "4548-4", "last_bp_systolic": "8480-6", "last_bp_diastolic": "8462-4", "last_bmi": "39156-5",
}


def _until(column: str, as_of: Column) -> Column:
    """Up to and including the day; works on dates and times without casting the column."""
    return F.col(column) < F.date_add(as_of, 1)


def patient_features(tables: Mapping[str, DataFrame], as_of) -> DataFrame:
    """patient_feature as of a day; only facts up to that day count.

    Every fact table is aggregated per patient before it is joined, and all joins run on patient_sk, so
    the aggregates' own partitioning serves the joins.
    """
    day = clinical.as_date(as_of)
    encounters = (
        tables["encounter"].filter(_until("period_start", day)).groupBy("patient_sk").agg(
            F.count("*").alias("encounter_count"),
            F.count_if(F.col("encounter_class") == "inpatient").alias("inpatient_count"),
            F.count_if(F.col("encounter_class") == "emergency").alias("ed_count"),
        )
    )
    problems = (
        tables["condition"].filter(_until("recorded_date", day) & (F.col("clinical_status") == "active"))
        .groupBy("patient_sk").agg(F.countDistinct("condition_code").alias("active_problem_count"))
    )
    drugs = (
        tables["medication_order"].filter(_until("start_datetime", day))
        .groupBy("patient_sk").agg(F.countDistinct("med_code").alias("distinct_med_count"))
    )
    values = latest_values(tables["observation"].filter(_until("effective_datetime", day)), LATEST_VALUE_CODES)
    mentions = tables["note_nlp_entity"]
    if "service_date" in mentions.columns:
        mentions = mentions.filter(_until("service_date", day))
    findings = (
        mentions.filter(trusted_mention())
        .groupBy("patient_sk")
        .agg(F.countDistinct(F.coalesce("concept_code", F.lower("covered_text"))).alias("nlp_finding_count"))
    )
    counts = ("encounter_count", "inpatient_count", "ed_count", "active_problem_count", "distinct_med_count",
              "nlp_finding_count")
    out = tables["patient"].select(
        "patient_sk", F.floor(clinical.age_years(F.col("birth_date"), day)).cast("int").alias("age_years"),
        "sex", "race", "ethnicity",
    )
    for part in (encounters, problems, drugs, values, findings):
        out = out.join(part, "patient_sk", "left")
    return out.withColumns({name: F.coalesce(name, F.lit(0)) for name in counts}).withColumn("feature_asof_date", day)


def patient_trends(tables: Mapping[str, DataFrame], as_of) -> DataFrame:
    """HbA1c slope per day, encounters per year of history, number of chronic diagnoses."""
    day = clinical.as_date(as_of)
    a1c_day = F.datediff(F.col("effective_datetime").cast("date"), F.lit("2000-01-01").cast("date"))
    slope = (
        tables["observation"]
        .filter((F.col("observation_code") == "4548-4") & F.col("value_numeric").isNotNull() & _until("effective_datetime", day))
        .groupBy("patient_sk").agg(F.regr_slope(F.col("value_numeric"), a1c_day.cast("double")).alias("a1c_slope_per_day"))
    )
    rate = (
        tables["encounter"].filter(_until("period_start", day)).groupBy("patient_sk")
        .agg(F.count("*").alias("_n"), F.min(F.col("period_start").cast("date")).alias("_first"))
        .select(
            "patient_sk",
            (F.col("_n") / (F.greatest(F.datediff(day, "_first"), F.lit(1)) / 365.25)).alias("encounters_per_year"),
        )
    )
    burden = (
        tables["condition"].filter(F.col("is_chronic") & _until("recorded_date", day))
        .groupBy("patient_sk").agg(F.countDistinct("condition_code").alias("chronic_condition_count"))
    )
    return (
        tables["patient"].select("patient_sk")
        .join(slope, "patient_sk", "left").join(rate, "patient_sk", "left").join(burden, "patient_sk", "left")
        .withColumn("chronic_condition_count", F.coalesce("chronic_condition_count", F.lit(0)))
    )


def cardiovascular_risk(conditions: DataFrame, medications: DataFrame) -> DataFrame:
    """Per patient: has a cardiovascular diagnosis, or diabetes or hypertension under drug treatment.

    1 = established disease; otherwise a treated risk factor raises the flag.
    """
    cvd = F.col("condition_code").isin(codes.CVD_ICD10)
    factor = F.col("condition_code").isin("E11.9", "I10")
    facts = (
        conditions.filter(cvd | factor).select("patient_sk", cvd.alias("cvd"), factor.alias("factor"), F.lit(False).alias("treated"))
        .unionByName(
            medications.filter(F.col("order_status") == "active")
            .select("patient_sk", F.lit(False).alias("cvd"), F.lit(False).alias("factor"), F.lit(True).alias("treated"))
        )
    )
    flags = facts.groupBy("patient_sk").agg(*[F.bool_or(name).alias(name) for name in ("cvd", "factor", "treated")])
    return flags.select(
        "patient_sk", F.col("cvd").alias("has_cvd"),
        (F.col("cvd") | (F.col("factor") & F.col("treated"))).alias("cv_risk_flag"),
    )


def phenotypes(patients: DataFrame, conditions: DataFrame, medications: DataFrame) -> DataFrame:
    """Computable phenotype of every patient: the first rule that fits, general where none does."""
    code = F.col("condition_code")
    facts = (
        conditions.filter(code.isin("E11.9", "I10", "R73.09", *codes.CVD_ICD10))
        .select(
            "patient_sk", (code == "E11.9").alias("t2dm"), code.isin(codes.CVD_ICD10).alias("cvd"),
            (code == "I10").alias("htn"), (code == "R73.09").alias("pre"), F.lit(False).alias("metformin"),
        )
        .unionByName(
            medications.filter(F.col("med_code").isin(codes.METFORMIN)).select(
                "patient_sk", *[F.lit(False).alias(name) for name in ("t2dm", "cvd", "htn", "pre")],
                F.lit(True).alias("metformin"),
            )
        )
    )
    flags = facts.groupBy("patient_sk").agg(
        *[F.bool_or(name).alias(name) for name in ("t2dm", "cvd", "htn", "pre", "metformin")]
    )
    phenotype = (
        F.when(F.expr("t2dm AND metformin AND cvd"), "t2dm_cvd")
        .when(F.expr("t2dm AND metformin"), "t2dm_only")
        .when(F.col("t2dm"), "t2dm_alt_med")
        .when(F.col("htn"), "hypertension")
        .when(F.col("pre"), "prediabetes")
        .otherwise("general")
    )
    return patients.select("patient_sk").join(flags, "patient_sk", "left").select("patient_sk", phenotype.alias("phenotype"))
