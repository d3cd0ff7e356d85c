"""Scalar clinical rules as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversions documented for the source systems.
INTERNAL_DAY_ZERO = "1840-12-31"
NUMERIC_SENTINEL = 9999999.0


def as_date(value: str | dt.date | Column) -> Column:
    """A typed date: text and date objects become literals, columns pass through."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    return F.lit(value)


def age_years(birth_date: Column, as_of: Column) -> Column:
    """Fractional age in years of 365.25 days."""
    return F.datediff(as_of, birth_date) / 365.25


def within_days(ts: Column, first: Column, last: Column, strict_upper: bool = False) -> Column:
    """Is the time inside the date window?

    By default the whole last day counts. `strict_upper` ends the window at midnight at the start of
    the last day, which is what comparing a timestamp with a bare date does. The time column itself is
    compared, not a cast of it, so the window reaches the file scan.
    """
    if strict_upper:
        return ts.between(first, last)
    return (ts >= first) & (ts < F.date_add(last, 1))


def parse_code_list(text: Column) -> Column:
    """Comma list to an array: trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda item: F.trim(item)), lambda item: item != "")


def range_interpretation(value: Column, low: Column, high: Column) -> Column:
    """normal / high / low against a reference range; null where value or range is missing."""
    return (
        F.when(value.isNull() | low.isNull() | high.isNull(), F.lit(None).cast("string"))
        .when((value >= low) & (value <= high), "normal")
        .when(value > high, "high")
        .otherwise("low")
    )


def systolic_interpretation(value: Column) -> Column:
    return F.when(value <= 130, "normal").when(value <= 160, "high").when(value.isNotNull(), "critical")


def diastolic_interpretation(value: Column) -> Column:
    return F.when(value <= 85, "normal").when(value.isNotNull(), "high")


def interpretation(code: Column, value: Column, low: Column, high: Column) -> Column:
    """Interpretation of an observation: blood pressure has its own limits, the rest use their range."""
    return (
        F.when(code == "8480-6", systolic_interpretation(value))
        .when(code == "8462-4", diastolic_interpretation(value))
        .otherwise(range_interpretation(value, low, high))
    )


def clamp(value: Column, low: float, high: float, digits: int | None = None) -> Column:
    """Limit a value to [low, high] and round it; null stays null."""
    limited = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))
    return limited if digits is None else F.round(limited, digits)


def note_category(encounter_class: Column, is_first: Column) -> Column:
    return F.when(encounter_class == "inpatient", "discharge_summary").when(is_first, "hp").otherwise("progress")


def order_class(encounter_class: Column) -> Column:
    return F.when(encounter_class == "inpatient", "inpatient").otherwise("outpatient")


def mrn(patient_sk: Column) -> Column:
    """MRN- and the key padded with zeros to six digits; longer keys stay whole."""
    digits = patient_sk.cast("string")
    return F.concat(F.lit("MRN-"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))


def order_end(start: Column, days: Column) -> Column:
    return start + F.make_dt_interval(days)


def lab_time(visit: Column) -> Column:
    """Samples are drawn two hours before the visit."""
    return visit - F.expr("INTERVAL '2' HOUR")


def discharge_day(visit: Column) -> Column:
    return F.date_format(visit + F.expr("INTERVAL '2' DAY"), "yyyy-MM-dd")


def internal_day(days: Column) -> Column:
    """Day count of the source system, counted from its day zero, as a date."""
    return F.date_add(F.lit(dt.date.fromisoformat(INTERNAL_DAY_ZERO)), days.cast("int"))


def clean_lab_number(value: Column) -> Column:
    """The sentinel that marks a non-numeric result becomes null."""
    return F.nullif(value, F.lit(NUMERIC_SENTINEL))


def numeric_text(text: Column) -> Column:
    """Number in a result text, null where the text is none."""
    return F.trim(text).try_cast("double")


def bp_parts(text: Column) -> tuple[Column, Column]:
    """Systolic and diastolic of a reading such as 120/80; both null where the text is no reading."""
    pattern = r"^\s*(\d{2,3})\s*/\s*(\d{2,3})\s*$"
    return tuple(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double") for group in (1, 2))
