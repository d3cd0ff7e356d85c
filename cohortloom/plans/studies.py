"""Queries on studies: patterns over time, comparisons, version differences, matching, survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import clinical
from cohortloom.operators import analysis, cohort, criteria
from cohortloom.operators.criteria import CriteriaRecord
from cohortloom.plans.registry import AS_OF, query
from cohortloom.sources.fixtures import load, with_views

DAY = f"DATE '{AS_OF}'"
AGE = f"date_diff('day', birth_date, {DAY}) / 365.25"


@query("condition_then_medication", with_views("condition", "medication_order", then="""
SELECT patient_sk, max(a_date) AS first_date, b_date AS then_date
FROM (SELECT a.patient_sk, a.recorded_date AS a_date, CAST(b.start_datetime AS DATE) AS b_date,
             min(CAST(b.start_datetime AS DATE)) OVER (PARTITION BY a.patient_sk) AS first_b
      FROM condition AS a JOIN medication_order AS b ON a.patient_sk = b.patient_sk
      WHERE a.condition_code = 'E11.9' AND b.med_code IN ('860975', '861007')
        AND date_diff('day', a.recorded_date, CAST(b.start_datetime AS DATE)) BETWEEN 0 AND 90) AS p
WHERE b_date = first_b GROUP BY patient_sk, b_date"""))
def condition_then_medication(spark, sf_dir):
    """Diabetes recorded, then metformin within 90 days."""
    tables = load(spark, sf_dir, "condition", "medication_order")
    first = tables["condition"].filter("condition_code = 'E11.9'").withColumn("event_date", F.col("recorded_date"))
    then = tables["medication_order"].filter(F.col("med_code").isin("860975", "861007")).withColumn(
        "event_date", F.col("start_datetime").cast("date")
    )
    return analysis.followed_within(first, then, 90)


@query("cohort_comparison", with_views("cohort_member", "patient", "condition", then=f""", arms AS (
  SELECT CASE cohort_sk WHEN 0 THEN 'case' ELSE 'control' END AS arm, patient_sk FROM cohort_member WHERE cohort_sk IN (0, 2)),
who AS (SELECT arm, sex, CAST(floor({AGE} / 10) * 10 AS INT) AS age_band FROM arms AS a JOIN patient AS p ON a.patient_sk = p.patient_sk),
total AS (SELECT arm, count(*) AS n FROM who GROUP BY arm),
counted AS (
  SELECT arm, 'age_band' AS dimension, coalesce(CAST(age_band AS VARCHAR), 'unknown') AS value, count(*) AS n FROM who GROUP BY ALL
  UNION ALL SELECT arm, 'sex', coalesce(sex, 'unknown'), count(*) FROM who GROUP BY ALL
  UNION ALL SELECT arm, 'comorbidity', condition_code, count(DISTINCT a.patient_sk)
            FROM arms AS a JOIN condition AS c ON a.patient_sk = c.patient_sk GROUP BY ALL)
SELECT c.arm, dimension, value, c.n, round(c.n / t.n * 100, 1) AS pct FROM counted AS c JOIN total AS t ON c.arm = t.arm"""))
def cohort_comparison(spark, sf_dir):
    tables = load(spark, sf_dir, "cohort_member", "patient", "condition")
    arms = tables["cohort_member"].filter("cohort_sk IN (0, 2)").select(
        F.when(F.col("cohort_sk") == 0, "case").otherwise("control").alias("arm"), "patient_sk"
    )
    return analysis.compare_cohorts(arms, tables["patient"], tables["condition"], AS_OF)


def _t2dm_members(tables, **changes):
    record = CriteriaRecord(**{"icd_codes": "E11.9", "date_from": "1998-01-01", "date_to": AS_OF, **changes})
    return cohort.build_cohort(tables, criteria.cohort_spec(record, AS_OF))


def _t2dm_sql(where: str, first: str = "1998-01-01", last: str = AS_OF) -> str:
    return (
        f"SELECT patient_sk FROM patient WHERE {where} AND patient_sk IN (SELECT patient_sk FROM condition WHERE condition_code = 'E11.9'"
        f" AND clinical_status = 'active' AND recorded_date BETWEEN DATE '{first}' AND DATE '{last}')"
    )


def _difference_sql(old: str, new: str) -> str:
    return f""", old AS ({old}), new AS ({new})
SELECT coalesce(o.patient_sk, n.patient_sk) AS patient_sk,
       CASE WHEN o.patient_sk IS NULL THEN 'added' WHEN n.patient_sk IS NULL THEN 'dropped' ELSE 'kept' END AS change
FROM old AS o FULL OUTER JOIN new AS n ON o.patient_sk = n.patient_sk"""


@query("version_difference", with_views("patient", "condition", then=_difference_sql(
    _t2dm_sql(f"{AGE} BETWEEN 0 AND 60"), _t2dm_sql(f"{AGE} BETWEEN 40 AND 120"))))
def version_difference(spark, sf_dir):
    """Who a changed age range adds and drops."""
    tables = load(spark, sf_dir, "patient", "condition")
    return analysis.membership_difference(_t2dm_members(tables, max_age=60), _t2dm_members(tables, min_age=40))


@query("membership_change", with_views("patient", "condition", then=_difference_sql(
    _t2dm_sql(f"{AGE} BETWEEN 0 AND 120", "1997-01-01", "1999-12-31"), _t2dm_sql(f"{AGE} BETWEEN 0 AND 120"))
    .replace("SELECT coalesce", "SELECT change, count(*) AS n FROM (SELECT coalesce") + ") AS d GROUP BY change"))
def membership_change(spark, sf_dir):
    """Gains and losses of a refreshed cohort against its prior run, by number."""
    tables = load(spark, sf_dir, "patient", "condition")
    prior = _t2dm_members(tables, date_from="1997-01-01", date_to="1999-12-31")
    return analysis.membership_difference(prior, _t2dm_members(tables)).groupBy("change").agg(F.count("*").alias("n"))


_MATCH_SQL = f""", about AS (
  SELECT patient_sk, sex, CAST(floor({AGE} / 10) * 10 AS INT) AS age_band FROM patient WHERE birth_date IS NOT NULL),
cases AS (SELECT DISTINCT patient_sk FROM cohort_member WHERE cohort_sk = 0),
ranked_case AS (
  SELECT a.*, row_number() OVER (PARTITION BY sex, age_band ORDER BY md5(CAST(a.patient_sk AS VARCHAR)), a.patient_sk) AS place
  FROM about AS a JOIN cases AS c ON a.patient_sk = c.patient_sk),
ranked_control AS (
  SELECT *, row_number() OVER (PARTITION BY sex, age_band ORDER BY md5(CAST(patient_sk AS VARCHAR)), patient_sk) AS place
  FROM about WHERE patient_sk NOT IN (SELECT patient_sk FROM cases))
SELECT c.patient_sk AS case_sk, k.patient_sk AS control_sk, c.sex, c.age_band
FROM ranked_case AS c JOIN ranked_control AS k ON c.sex = k.sex AND c.age_band = k.age_band AND c.place = ceil(k.place / 2)"""


@query("matched_controls", with_views("cohort_member", "patient", then=_MATCH_SQL))
def matched_controls(spark, sf_dir):
    """Two controls per case of the same sex and age band."""
    tables = load(spark, sf_dir, "cohort_member", "patient")
    cases = tables["cohort_member"].filter("cohort_sk = 0")
    return analysis.matched_controls(cases, tables["patient"], tables["patient"], AS_OF, 2)


_TIMES_SQL = f""", entry AS (
  SELECT patient_sk, min(recorded_date) AS index_date FROM condition WHERE condition_code = 'E11.9' GROUP BY 1),
first_event AS (
  SELECT e.patient_sk, min(c.recorded_date) AS d FROM entry AS e JOIN condition AS c ON e.patient_sk = c.patient_sk
  WHERE c.condition_code IN ('I25.10', 'I63.9') AND c.recorded_date BETWEEN e.index_date AND {DAY} GROUP BY 1),
times AS (
  SELECT e.patient_sk, date_diff('day', index_date, coalesce(d, {DAY})) AS days, d IS NOT NULL AS event
  FROM entry AS e LEFT JOIN first_event AS f ON e.patient_sk = f.patient_sk WHERE index_date <= {DAY})"""


def _times(spark, sf_dir):
    conditions = load(spark, sf_dir, "condition")["condition"]
    members = conditions.filter("condition_code = 'E11.9'").groupBy("patient_sk").agg(F.min("recorded_date").alias("index_date"))
    events = conditions.filter(F.col("condition_code").isin("I25.10", "I63.9")).withColumn("event_date", F.col("recorded_date"))
    return analysis.time_to_event(members, events, clinical.as_date(AS_OF))


@query("time_to_event", with_views("condition", then=_TIMES_SQL + "\nSELECT patient_sk, days, event FROM times"))
def time_to_event(spark, sf_dir):
    """Days from the first diabetes diagnosis to the first cardiovascular one, or to the end of the data."""
    return _times(spark, sf_dir)


@query("kaplan_meier", with_views("condition", then=_TIMES_SQL + """,
daily AS (SELECT days, count(*) AS n, count(*) FILTER (WHERE event) AS d FROM times GROUP BY days),
risk AS (SELECT days, d, sum(n) OVER (ORDER BY days DESC) AS at_risk FROM daily)
SELECT days, CAST(at_risk AS BIGINT) AS at_risk, d AS events, round(product(1 - d / at_risk) OVER (ORDER BY days), 6) AS survival
FROM risk WHERE d > 0"""))
def kaplan_meier(spark, sf_dir):
    return analysis.kaplan_meier(_times(spark, sf_dir)).withColumn("survival", F.round("survival", 6))
