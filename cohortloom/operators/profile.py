"""Descriptive statistics of the clinical tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.session import checkpoint_folder


def drug_share(patients: DataFrame, medications: DataFrame, drug_codes: list[str] = codes.METFORMIN) -> DataFrame:
    """Patients with any order for the drug, and their share of all patients in percent."""
    on_drug = medications.filter(F.col("med_code").isin(drug_codes)).agg(F.countDistinct("patient_sk").alias("n_on_drug"))
    everyone = patients.agg(F.count("*").alias("n_patients"))
    both = on_drug.select("n_on_drug", F.lit(None).cast("long").alias("n_patients")).unionByName(
        everyone.select(F.lit(None).cast("long").alias("n_on_drug"), "n_patients")
    )
    return both.agg(F.max("n_on_drug").alias("n_on_drug"), F.max("n_patients").alias("n_patients")).withColumn(
        "pct", F.round(F.col("n_on_drug") / F.col("n_patients") * 100, 1)
    )


# Ranges a histogram has; as many rows reach the driver in one step.
_RANGES = 4096


def values_at(counted: DataFrame, value: str, count: str, ranks: list[int]) -> dict[int, float]:
    """The values at ranks (from 0) of finite numbers given as (value, how often): exact, and no task or driver holds all values.

    A histogram of equal ranges says in which range a rank lies; that range, between its own smallest and largest value, is divided next until it is one value.
    """
    least, most = counted.agg(F.min(value), F.max(value)).first()
    found, open_ranges = {}, {(least, most): [(rank, rank) for rank in ranks]}
    while open_ranges:
        (low, high), wanted = open_ranges.popitem()
        if low == high:
            found |= {rank: low for rank, _ in wanted}
            continue
        width = high / _RANGES - low / _RANGES
        place = F.floor((F.col(value) / F.lit(width)) - F.lit(low / width)) if width else F.when(F.col(value) == F.lit(low), 0).otherwise(1)
        histogram = counted.filter(F.col(value).between(low, high)).groupBy(F.greatest(F.lit(0), F.least(place, F.lit(_RANGES - 1))).alias("place"))
        rows = sorted(histogram.agg(F.sum(count).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect())
        if len(rows) == 1:  # too narrow for arithmetic: the smallest value is told from the others
            rest = counted.filter((F.col(value) > F.lit(low)) & F.col(value).between(low, high)).agg(F.min(value), F.sum(count)).first()
            rows = [(0, rows[0]["n"] - rest[1], low, low), (1, rest[1], rest[0], high)]
        for rank, within in wanted:
            for _, n, first, last in rows:
                if within < n:
                    open_ranges.setdefault((first, last), []).append((rank, within))
                    break
                within -= n
    return found


def lab_distribution(observations: DataFrame, code: str, exact: bool = True) -> DataFrame:
    """Mean, quartiles and number of results of a lab code; results that are no finite number are left out.

    Exact quartiles (interpolated between neighbours) come from refined histograms over the number of results per value; `exact=False` uses a quantile sketch.
    """
    results = observations.filter((F.col("observation_code") == code) & (F.abs("value_numeric") < F.lit(float("inf"))))
    if not exact:
        quartile = lambda q: F.percentile_approx("value_numeric", q, 10000)
        return results.agg(
            F.round(F.mean("value_numeric"), 2).alias("mean_value"), F.round(quartile(0.25), 2).alias("p25"), F.round(quartile(0.75), 2).alias("p75"), F.count("*").alias("n"))
    counted = results.groupBy("value_numeric").agg(F.count("*").alias("_n"))
    path = f"{checkpoint_folder(observations.sparkSession)}/stage-{uuid.uuid4().hex}"
    counted.write.parquet(path)
    counted = observations.sparkSession.read.schema(counted.schema).parquet(path)
    mean, n = counted.agg(F.sum(F.col("value_numeric") * F.col("_n")) / F.sum("_n"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    places = {q: (n - 1) * q for q in (0.25, 0.75)} if n else {}
    at = values_at(counted, "value_numeric", "_n", sorted({r for p in places.values() for r in (math.floor(p), math.ceil(p))})) if n else {}
    between = lambda p: at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p))
    row = [(mean, *(between(places[q]) if n else None for q in (0.25, 0.75)), n)]
    one = observations.sparkSession.createDataFrame(row, "mean_value double, p25 double, p75 double, n long").coalesce(1)
    return one.select(*(F.round(name, 2).alias(name) for name in ("mean_value", "p25", "p75")), "n")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share of all rows in percent; the total is an aggregate of its own, so no task holds all values."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") / total * 100, 1)).orderBy(
        F.col("n").desc(), column
    )


def children_per_parent(pairs: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Mean number of child rows per parent row, for each named pair (name, child, parent)."""
    parts = []
    for name, child, parent in pairs:
        parts.append(child.agg(F.count("*").alias("n")).select(F.lit(name).alias("pair"), F.lit("child").alias("side"), "n"))
        parts.append(parent.agg(F.count("*").alias("n")).select(F.lit(name).alias("pair"), F.lit("parent").alias("side"), "n"))
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts.groupBy("pair").agg(
        F.round(
            F.max(F.when(F.col("side") == "child", F.col("n"))) / F.max(F.when(F.col("side") == "parent", F.col("n"))), 1
        ).alias("mean_children")
    )


def lab_mean_by_group(observations: DataFrame, groups: DataFrame, group: str, code: str) -> DataFrame:
    """Mean value and number of results of a lab code by patient group.

    Results are summed per patient before the join: a patient with many results sends one row.
    """
    per_patient = (
        observations.filter((F.col("observation_code") == code) & F.col("value_numeric").isNotNull())
        .groupBy("patient_sk").agg(F.sum("value_numeric").alias("_sum"), F.count("*").alias("_n"))
    )
    return (
        per_patient.join(groups, "patient_sk").groupBy(group)
        .agg(F.round(F.sum("_sum") / F.sum("_n"), 2).alias("mean_value"), F.sum("_n").alias("n_results"))
    )
