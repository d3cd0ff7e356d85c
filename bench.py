"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the number of local cores. Every query runs to the end over its
whole tables (its result goes to the no-op sink); the time is that of the second run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortloom import plans
from cohortloom.session import local_session

HEADLINES = [
    "flagship_slice", "cohort_members", "cohort_and_or_groups", "cohort_index_dates", "cohort_evidence_triggers",
    "three_way_cohort", "control_cohort", "cohort_list", "cohort_condition_listing", "timeline_condition",
    "timelines_condition", "timelines_observation", "encounter_index", "patient_features", "phenotype_histogram",
    "hba1c_distribution", "referential_integrity", "extracted_mentions", "mentions_of_long_lexicon", "cohort_from_notes", "parsed_entities",
    "user_function_mentions", "reassembled_notes", "html_notes", "deidentified_notes", "linked_identities",
    "condition_then_medication", "cohort_comparison", "matched_controls", "kaplan_meier", "fhir_conditions",
]


def seconds(spark, job, sf_dir: str) -> float:
    start = time.perf_counter()
    job(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    jobs = plans.jobs()
    times = {}
    for name in HEADLINES:
        seconds(spark, jobs[name], sf_dir)
        times[name] = round(seconds(spark, jobs[name], sf_dir), 3)
    notes = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "notes_per_sec_extraction": round(notes / times["extracted_mentions"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
