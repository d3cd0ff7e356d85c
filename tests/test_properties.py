"""Random criteria, expressions and rows against definitions that are computed another way."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cohort, criteria
from cohortloom.operators.criteria import AllOf, AnyOf, CohortSpec, Criterion, CriteriaRecord, Has
from cohortloom.operators.criteria_sql import cohort_sql
from cohortloom.sources.fixtures import load

DAY_ONE = dt.date(2000, 1, 1)


def random_tree(rng, ids, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return Has(rng.choice(ids))
    return rng.choice([AllOf, AnyOf])(*[random_tree(rng, ids, depth - 1) for _ in range(rng.randrange(1, 4))])


def holds(tree, seen) -> bool:
    if isinstance(tree, Has):
        return tree.id in seen
    results = [holds(part, seen) for part in tree.parts]
    return all(results) if isinstance(tree, AllOf) else any(results)


@pytest.mark.parametrize("seed", range(8))
def test_index_date_is_the_first_day_on_which_the_expression_holds(spark, seed):
    rng = random.Random(seed)
    ids = ["a", "b", "c", "d"]
    events = [(n, p, rng.choice(ids), DAY_ONE + dt.timedelta(days=rng.randrange(60))) for n, p in enumerate(rng.randrange(30) for _ in range(90))]
    tree = random_tree(rng, ids)
    want = {}
    for patient in range(30):
        own = [(day, code) for _, p, code, day in events if p == patient]
        days = [day for day in sorted({day for day, _ in own}) if holds(tree, {code for d, code in own if d <= day})]
        if days:
            want[patient] = days[0]
    tables = {
        "patient": spark.range(30).select(F.col("id").alias("patient_sk"), *[F.lit("x").alias(c) for c in ("mrn", "birth_date", "sex", "race")]),
        "condition": spark.createDataFrame(events, "condition_sk long, patient_sk long, condition_code string, recorded_date date"),
    }
    spec = CohortSpec([Criterion(i, "condition", F.col("condition_code") == i) for i in ids], tree, F.lit(True))
    got = {r.patient_sk: r.index_date for r in cohort.qualified_members(tables, spec).collect()}
    assert got == want


def random_record(rng) -> CriteriaRecord:
    codes = ["E11.9", "I10", "I25.10", "I50.9", "R73.09", "e78.5", "I63.9", "J06.9", "X00"]
    drugs = ["860975", "861007", "665035", "285129", "617312"]
    some = lambda pool, most: ", ".join(rng.sample(pool, rng.randrange(0, most + 1)))
    return CriteriaRecord(
        icd_codes=some(codes, 3), icd_status=rng.sample(["active", "resolved", "inactive"], rng.randrange(3)),
        med_codes=some(drugs, 2), med_status=rng.sample(["active", "completed"], rng.randrange(3)),
        lab_code=rng.choice(["", "", "4548-4", "8480-6"]), lab_min=rng.choice([None, 6.0]), lab_max=rng.choice([None, 150.0]),
        nlp_terms=rng.choice(["", "", "diabetes", "cough, metformin"]), nlp_concept=rng.choice(["", "", "E11.9"]),
        nlp_certainty=rng.sample(["positive", "uncertain"], rng.randrange(3)),
        nlp_temporality=rng.sample(["current", "historical", "family"], rng.randrange(3)),
        nlp_patient_only=rng.random() < 0.5, exc_icd=some(codes, 1), exc_meds=some(drugs, 1),
        date_from=f"199{rng.randrange(5, 9)}-01-01", date_to=f"200{rng.randrange(0, 2)}-06-30", min_age=rng.randrange(50, 70),
        max_age=rng.randrange(70, 90), sex_filter=rng.sample(["male", "female"], rng.randrange(3)),
    )


def test_random_records_equal_their_sql(spark, sf_dir):
    """The evidence form of a cohort against the IN / NOT IN form of the same record."""
    tables = {name: df.cache() for name, df in load(spark, sf_dir, "patient", "condition", "medication_order", "observation", "note_nlp_entity").items()}
    for name, df in tables.items():
        df.createOrReplaceTempView(f"random_{name}")
    rng, sizes = random.Random(11), []
    for _ in range(25):
        record = random_record(rng)
        text, parameters = cohort_sql(record, "2001-12-31")
        for name in tables:
            text = text.replace("{" + name + "}", f"random_{name}")
        want = sorted(r.patient_sk for r in spark.sql(text, args=parameters).collect())
        got = sorted(r.patient_sk for r in cohort.build_cohort(tables, criteria.cohort_spec(record, "2001-12-31")).collect())
        assert got == want, record
        sizes.append(len(got))
    assert sum(size > 0 for size in sizes) >= 5
    for df in tables.values():
        df.unpersist()
