"""Every registered query against its SQL, and the driver contract."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_point
from cohortloom import plans
from cohortloom.operators import cohort
from cohortloom.plans import cohorts
from cohortloom.sources.fixtures import load


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.jobs()))
def test_query_equals_sql(spark, sf_dir, con, name):
    job, sql = plans.jobs()[name], plans.oracle().get(name)
    assert sql is not None, "every query has an SQL text"
    _, problem = differences(job(spark, sf_dir), con, sql)
    assert problem is None


def test_entry_point(spark):
    row = entry_point.entry(spark).first()
    assert (row.n, row.lo, row.hi, row.s) == (8, 18, 86, 456)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    for n in (1, 3, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        seen.add(cohorts.flagship_slice(spark, sf_dir).first())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_another_criterion_never_grows_a_cohort(spark, sf_dir):
    tables = load(spark, sf_dir, *cohorts.CLINICAL)
    base = cohorts.WIDE_RECORD
    narrower = cohorts.CriteriaRecord(**{**base.__dict__, "med_codes": "860975"})
    wide = {r.patient_sk for r in cohort.build_cohort(tables, cohorts.criteria.cohort_spec(base, "2001-12-31")).collect()}
    narrow = {r.patient_sk for r in cohort.build_cohort(tables, cohorts.criteria.cohort_spec(narrower, "2001-12-31")).collect()}
    assert narrow < wide
