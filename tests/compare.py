"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from cohortloom.sources.fixtures import DRIVER_TABLES  # noqa: E402

TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_FAMILIES = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int", "ubigint": "int",
    "double": "double", "float": "double", "string": "text", "varchar": "text", "boolean": "boolean", "date": "date",
    "timestamp": "time", "timestamp_ntz": "time", "timestamp with time zone": "time",
}


def type_families(columns: list[str], types: list[str]) -> dict[str, str]:
    return {name: _FAMILIES.get(kind.lower(), kind.lower()) for name, kind in zip(columns, types)}


def differences(spark_df, con, sql: str) -> tuple[int, str | None]:
    """Number of Spark rows, and a description of what differs (None when equal)."""
    got = rows_of(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(spark_df.columns) != sorted(rel.columns):
        return sum(got.values()), f"columns {sorted(spark_df.columns)} / {sorted(rel.columns)}"
    ours = type_families(spark_df.columns, [f.dataType.simpleString() for f in spark_df.schema.fields])
    theirs = type_families(rel.columns, [str(t) for t in rel.types])
    odd = {name: (ours[name], theirs[name]) for name in ours if ours[name] != theirs[name]}
    if odd:
        return sum(got.values()), f"types {odd}"
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        return sum(got.values()), f"{sum(got.values())} / {sum(want.values())} rows; only Spark {extra}; only SQL {missing}"
    return sum(got.values()), None


def main(sf: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from cohortloom.session import local_session

    spark = local_session(8)
    sf_dir = f"{TESTDATA}/sf{sf}"
    con = connect(sf_dir)
    oracle, bad = oracle_sql(), 0
    for name, job in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracle:
                n, problem = differences(job(spark, sf_dir), con, oracle[name])
            else:
                n, problem = job(spark, sf_dir).count(), None
        except Exception as error:  # a failing query is reported like a differing one
            n, problem = -1, f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} rows={n} {time.time() - start:.2f}s{'' if name in oracle else ' (no SQL)'} {problem or ''}", flush=True)
    print("differing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
