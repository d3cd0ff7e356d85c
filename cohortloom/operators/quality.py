"""Data-quality checks: the tables carry no enforced constraints, so these jobs watch over them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.schemas import FOREIGN_KEYS, TABLES, VALUE_SETS


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def referential_integrity(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Orphans per declared foreign key among the given tables: rows and distinct missing keys.

    All foreign keys to one parent are checked in one join. Child keys are counted before it, so a key
    on very many rows is one row there.
    """
    present = [
        key for key in FOREIGN_KEYS if key[0] in tables and key[2] in tables and key[1] in tables[key[0]].columns
    ]
    parts = []
    for parent, parent_column in dict.fromkeys((key[2], key[3]) for key in present):
        children = [
            tables[child].filter(F.col(column).isNotNull())
            .select(F.lit(f"{child}.{column}").alias("foreign_key"), F.col(column).alias("_key"))
            for child, column, *to in present if to == [parent, parent_column]
        ]
        keys = _union(children).groupBy("foreign_key", "_key").agg(F.count("*").alias("_n"))
        known = tables[parent].select(F.col(parent_column).alias("_key"))
        orphans = keys.join(known, "_key", "left_anti").select("foreign_key", F.lit(parent).alias("parent"), "_n", F.lit(1).alias("_k"))
        parts.append(orphans)
    spark = next(iter(tables.values())).sparkSession
    labels = [(f"{child}.{column}", parent, 0, 0) for child, column, parent, _ in present]
    none = spark.createDataFrame(labels, "foreign_key string, parent string, _n long, _k int")
    return _union([*parts, none]).groupBy("foreign_key", "parent").agg(
        F.sum("_n").alias("n_rows"), F.sum("_k").alias("n_keys")
    )


def key_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, null keys, keys that occur more than once, nulls in required columns."""
    parts = []
    for name, df in tables.items():
        table = TABLES[name]
        required = [column for column in table.required if column in df.columns]
        null_required = [F.count_if(F.col(column).isNull()) for column in required]
        per_key = df.groupBy(F.col(table.key).alias("_key")).agg(
            F.count("*").alias("_n"), reduce(lambda a, b: a + b, null_required, F.lit(0)).cast("long").alias("_nulls")
        )
        parts.append(per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), F.lit(0)).alias("n_null_keys"),
            F.count_if(F.col("_key").isNotNull() & (F.col("_n") > 1)).alias("n_repeated_keys"),
            F.coalesce(F.sum("_nulls"), F.lit(0)).alias("n_null_required"),
        ).select(F.lit(name).alias("table_name"), "n_rows", "n_null_keys", "n_repeated_keys", "n_null_required"))
    return _union(parts)


def value_set_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Values of coded columns that are not in their documented value set, with row counts."""
    parts = []
    for (name, column), allowed in VALUE_SETS.items():
        if name not in tables or column not in tables[name].columns:
            continue
        parts.append(
            tables[name].filter(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)))
            .groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
            .select(F.lit(f"{name}.{column}").alias("coded_column"), "value", "n_rows")
        )
    return _union(parts)


def unknown_codes(rows: DataFrame, code_column: str, known: DataFrame) -> DataFrame:
    """Codes without an entry in a code table, with row counts (counted before the join)."""
    counts = rows.groupBy(code_column).agg(F.count("*").alias("n_rows"))
    return counts.join(known.select(F.col("code").alias(code_column)), code_column, "left_anti")
