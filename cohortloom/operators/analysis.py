"""Studies on cohorts: temporal patterns, comparison, version differences, matching, survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import clinical
from cohortloom.operators.ranking import numbered


def followed_within(first: DataFrame, then: DataFrame, days: int) -> DataFrame:
    """Patients for whom an event of `then` comes 0 to `days` days after an event of `first`.

    Both inputs have patient_sk and event_date. Per patient: the earliest such later event and the
    closest earlier event to it. Events are first reduced to one row per patient and day, then one
    pass in date order carries the last earlier event along, so events are never paired.
    """
    daily = (
        first.select("patient_sk", "event_date", F.lit(True).alias("a"), F.lit(False).alias("b"))
        .unionByName(then.select("patient_sk", "event_date", F.lit(False).alias("a"), F.lit(True).alias("b")))
        .filter(F.col("event_date").isNotNull())
        .groupBy("patient_sk", "event_date").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    )
    so_far = Window.partitionBy("patient_sk").orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    marked = daily.withColumn("first_date", F.last(F.when(F.col("a"), F.col("event_date")), ignorenulls=True).over(so_far))
    hits = marked.filter(F.col("b") & (F.datediff("event_date", "first_date") <= days))
    earliest = F.min(F.struct(F.col("event_date").alias("then_date"), "first_date"))
    return hits.groupBy("patient_sk").agg(earliest.alias("_hit")).select("patient_sk", "_hit.first_date", "_hit.then_date")


def age_band(age: Column) -> Column:
    """Ten-year band by its lower bound; null without an age."""
    return (F.floor(age / 10) * 10).cast("int")


def compare_cohorts(arms: DataFrame, patients: DataFrame, conditions: DataFrame, as_of) -> DataFrame:
    """Distribution of age band, sex and diagnoses in each arm: patients and share of the arm in percent.

    `arms` has arm and patient_sk (one row each). Long result: arm, dimension, value, n, pct.
    """
    day = clinical.as_date(as_of)
    who = arms.join(
        patients.select("patient_sk", "sex", age_band(clinical.age_years(F.col("birth_date"), day)).alias("age_band")), "patient_sk"
    )
    totals = who.groupBy("arm").agg(F.count("*").alias("_total"))
    demographics = who.select(
        "arm", F.inline(F.array(
            F.struct(F.lit("age_band").alias("dimension"), F.coalesce(F.col("age_band").cast("string"), F.lit("unknown")).alias("value")),
            F.struct(F.lit("sex").alias("dimension"), F.coalesce("sex", F.lit("unknown")).alias("value")),
        ))
    ).groupBy("arm", "dimension", "value").agg(F.count("*").alias("n"))
    members = arms.select("patient_sk").distinct()
    diagnoses = conditions.select("patient_sk", F.col("condition_code").alias("value")).join(members, "patient_sk", "left_semi").distinct()
    comorbidity = (
        arms.join(diagnoses, "patient_sk").groupBy("arm", "value").agg(F.count("*").alias("n"))
        .select("arm", F.lit("comorbidity").alias("dimension"), "value", "n")
    )
    return (
        demographics.unionByName(comorbidity).join(totals, "arm")
        .select("arm", "dimension", "value", "n", F.round(F.col("n") / F.col("_total") * 100, 1).alias("pct"))
    )


def membership_difference(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("patient_sk",)) -> DataFrame:
    """Patients added, dropped and kept between two member lists (two versions, or two runs of one)."""
    sides = (
        old.select(*keys, F.lit(True).alias("was"), F.lit(False).alias("is_now"))
        .unionByName(new.select(*keys, F.lit(False).alias("was"), F.lit(True).alias("is_now")))
        .groupBy(*keys).agg(F.bool_or("was").alias("was"), F.bool_or("is_now").alias("is_now"))
    )
    change = F.when(F.col("was") & F.col("is_now"), "kept").when(F.col("is_now"), "added").otherwise("dropped")
    return sides.select(*keys, change.alias("change"))


def matched_controls(cases: DataFrame, pool: DataFrame, patients: DataFrame, as_of, k: int) -> DataFrame:
    """Up to k controls per case of the same sex and ten-year age band, each control used once.

    Within a stratum cases and controls are put in the order of a hash of their key; controls
    1..k go to the first case, the next k to the second, and so on. No case is paired with all
    controls, and a stratum is numbered in pieces, so strata may be of any size.
    """
    day = clinical.as_date(as_of)
    about = patients.select(
        "patient_sk", "sex", age_band(clinical.age_years(F.col("birth_date"), day)).alias("age_band")
    ).filter(F.col("sex").isNotNull() & F.col("age_band").isNotNull())
    strata = ["sex", "age_band"]

    def in_hash_order(people: DataFrame) -> DataFrame:
        hashed = people.select("patient_sk").distinct().join(about, "patient_sk").withColumn(
            "_hash", F.md5(F.col("patient_sk").cast("string"))
        )
        return numbered(hashed, strata, F.substring("_hash", 1, 3), [F.col("_hash"), F.col("patient_sk")], "_place")

    available = pool.select("patient_sk").join(cases.select("patient_sk"), "patient_sk", "left_anti")
    slots = in_hash_order(available).select(
        *strata, F.col("patient_sk").alias("control_sk"), F.ceil(F.col("_place") / k).alias("_place")
    )
    return in_hash_order(cases).select(*strata, F.col("patient_sk").alias("case_sk"), "_place").join(
        slots, [*strata, "_place"]
    ).select("case_sk", "control_sk", *strata)


def time_to_event(members: DataFrame, events: DataFrame, censor_date: Column) -> DataFrame:
    """Days from index date to the first event on or after it, or to the censoring date.

    Events are cut to one row per patient and day before the join, so a patient with very many events sends few.
    """
    days = events.filter(F.col("event_date") <= censor_date).select("patient_sk", "event_date").distinct()
    first = (
        members.select("patient_sk", "index_date").join(days, "patient_sk")
        .filter((F.col("event_date") >= F.col("index_date")) & (F.col("event_date") <= censor_date))
        .groupBy("patient_sk").agg(F.min("event_date").alias("_first"))
    )
    return (
        members.filter(F.col("index_date") <= censor_date).join(first, "patient_sk", "left")
        .select(
            "patient_sk", F.datediff(F.coalesce("_first", censor_date), "index_date").alias("days"),
            F.col("_first").isNotNull().alias("event"),
        )
    )


def kaplan_meier(times: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Survival curve: at each time with an event, the number at risk, the events, and the estimate.

    Subjects are first counted per day; the windows then run over days, of which there are few. Where
    all at risk have the event the curve drops to zero and stays there.
    """
    daily = times.groupBy(*by, "days").agg(F.count("*").alias("_n"), F.count_if(F.col("event")).alias("events"))
    later = Window.partitionBy(*by).orderBy(F.col("days").desc()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("days").rowsBetween(Window.unboundedPreceding, 0)
    at_risk = daily.withColumn("at_risk", F.sum("_n").over(later)).filter(F.col("events") > 0)
    share = 1 - F.col("events") / F.col("at_risk")
    log_sum = F.sum(F.when(share > 0, F.log(share))).over(earlier)
    dead = F.max((share == 0).cast("int")).over(earlier) == 1
    return at_risk.select(
        *by, "days", "at_risk", "events",
        F.when(dead, 0.0).otherwise(F.exp(F.coalesce(log_sum, F.lit(0.0)))).alias("survival"),
    )
