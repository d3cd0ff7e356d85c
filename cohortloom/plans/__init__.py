"""All registered queries."""

from __future__ import annotations

from cohortloom.plans import cohorts, facts, mentions, records, reviews, stored, studies  # noqa: F401  (each module registers its queries)
from cohortloom.plans.registry import JOBS, ORACLE, Job


def jobs() -> dict[str, Job]:
    return dict(JOBS)


def oracle() -> dict[str, str]:
    return dict(ORACLE)
