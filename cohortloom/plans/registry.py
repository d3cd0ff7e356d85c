"""Registered queries: a Spark job over the given tables and, where SQL can say it, an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
ORACLE: dict[str, str] = {}

# The day all registered queries take as today.
AS_OF = "2001-12-31"


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"query {name} is registered twice")
        JOBS[name] = job
        if sql is not None:
            ORACLE[name] = sql
        return job

    return register


def sql_text(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_view(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE with the rows of a fixed list."""
    body = ", ".join("(" + ", ".join(sql_text(value) for value in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"
