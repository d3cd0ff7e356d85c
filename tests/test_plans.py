"""What the physical plans must and must not hold."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortloom import plans
from cohortloom.operators import cohort, criteria, notes, ranking
from cohortloom.operators.criteria import CriteriaRecord
from cohortloom.plans import cohorts
from cohortloom.plans.cohorts import CLINICAL
from cohortloom.sources.fixtures import clinical_view, load


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as on tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_cross_or_nested_loop_join(spark, sf_dir, no_broadcast):
    bad = [
        name for name, job in plans.jobs().items()
        if re.search("CartesianProduct|BroadcastNestedLoopJoin", physical(job(spark, sf_dir)))
    ]
    assert bad == []


def test_python_runs_only_in_the_user_function(spark, sf_dir):
    python = [name for name, job in plans.jobs().items() if re.search("Python|Pandas", physical(job(spark, sf_dir)))]
    assert python == ["user_function_mentions"]


def test_membership_is_combined_before_one_shuffle(spark, sf_dir, no_broadcast):
    folder, tables = tempfile.mkdtemp(prefix="run-plans-", dir="/tmp"), {}
    for name, df in load(spark, sf_dir, *CLINICAL).items():
        df.write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
    record = CriteriaRecord(icd_codes="E11.9", med_codes="860975", nlp_terms="diabetes", exc_icd="I50.9", exc_meds="617312")
    plan = physical(cohort.build_cohort(tables, criteria.cohort_spec(record, "2001-12-31")))
    assert plan.count("Exchange hashpartitioning") == 2  # patients, and the combined state
    assert plan.count("FileScan") == 4  # patient, condition, medication_order, note_nlp_entity: each once
    assert "partial_count" in plan and "SortAggregate" not in plan


def test_extraction_shuffles_nothing(spark, sf_dir, no_broadcast):
    plan = physical(notes.extract_mentions(clinical_view(spark, sf_dir, "clinical_note").select("note_sk", "note_text")))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_numbering_joins_on_its_own_partitioning(spark, no_broadcast):
    rows = spark.range(100).select((F.col("id") % 9).alias("patient_sk"), F.col("id").alias("encounter_sk"), F.date_add(F.current_date(), F.col("id").cast("int")).alias("period_start"))
    plan = physical(ranking.encounter_index(rows))
    # Rows by (patient, day) once for numbering and join; their counts by the same, by patient, and back.
    assert plan.count("Exchange hashpartitioning") == 4


def test_ranks_read_their_input_at_most_three_times(spark, no_broadcast):
    folder = tempfile.mkdtemp(prefix="run-plans-", dir="/tmp") + "/condition"
    spark.range(50).selectExpr("id % 9 AS encounter_sk", "id AS condition_sk", "'I10' AS condition_code", "current_date() AS recorded_date").write.parquet(folder)
    plan = physical(ranking.diagnosis_rank(spark.read.parquet(folder), ["J06.9"]))
    assert plan.count("FileScan") <= 3


def test_long_code_lists_are_joined(spark, sf_dir):
    plan = cohorts.cohort_of_long_code_lists(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "E11.9-04999" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
