"""A criteria record as readable SQL: what a preview shows, and a query to run by hand.

Values are named parameters and never part of the text; table names are in braces for Lake.query.
"""

from __future__ import annotations

import datetime as dt

from cohortloom.operators.criteria import CriteriaRecord, split_codes


def cohort_sql(record: CriteriaRecord, as_of: str | dt.date | None = None) -> tuple[str, dict]:
    """SQL text and parameters of the members of a record."""
    parameters: dict[str, object] = {}

    def listed(name: str, values: list[str]) -> str:
        names = []
        for n, value in enumerate(values):
            parameters[f"{name}_{n}"] = value
            names.append(f":{name}_{n}")
        return ", ".join(names)

    def value(name: str, given: object) -> str:
        parameters[name] = given
        return f":{name}"

    def among(table: str, *conditions: str) -> str:
        where = "\n      AND ".join(condition for condition in conditions if condition)
        return f"patient_sk IN (\n      SELECT patient_sk FROM {{{table}}}\n      WHERE {where})"

    def in_window(column: str) -> str:
        return f"{column} >= {value('date_from', record.date_from)} AND {column} < date_add({value('date_to', record.date_to)}, 1)"

    parts = []
    if codes := split_codes(record.icd_codes, upper=True):
        parts.append(among(
            "condition", f"condition_code IN ({listed('icd', codes)})",
            f"clinical_status IN ({listed('icd_status', record.icd_status or ['active'])})", in_window("recorded_date"),
        ))
    if codes := split_codes(record.med_codes):
        parts.append(among(
            "medication_order", f"med_code IN ({listed('med', codes)})",
            f"order_status IN ({listed('med_status', record.med_status or ['active'])})", in_window("start_datetime"),
        ))
    if record.lab_code.strip():
        parts.append(among(
            "observation", f"observation_code = {value('lab', record.lab_code.strip())}",
            "" if record.lab_min is None else f"value_numeric >= {value('lab_min', float(record.lab_min))}",
            "" if record.lab_max is None else f"value_numeric <= {value('lab_max', float(record.lab_max))}",
            in_window("effective_datetime"),
        ))
    if record.uses_notes:
        wanted = []
        for n, term in enumerate(split_codes(record.nlp_terms)):
            name = value(f"term_{n}", term.lower())
            wanted.append(f"contains(lower(covered_text), {name}) OR contains(lower(concept_display), {name})")
        if record.nlp_concept.strip():
            wanted.append(f"concept_code = {value('concept', record.nlp_concept.strip())}")
        parts.append(among(
            "note_nlp_entity", "(" + " OR ".join(wanted) + ")", "NOT negation",
            f"certainty IN ({listed('certainty', record.nlp_certainty or ['positive'])})",
            f"temporality IN ({listed('temporality', record.nlp_temporality or ['current'])})",
            f"entity_type IN ({listed('entity_type', record.nlp_entity_types)})" if record.nlp_entity_types else "",
            "subject = 'patient'" if record.nlp_patient_only else "",
        ))
    today = "current_date()" if as_of is None else f"CAST({value('as_of', str(as_of))} AS DATE)"
    age = f"datediff({today}, birth_date) / 365.25 BETWEEN {value('min_age', record.min_age)} AND {value('max_age', record.max_age)}"
    parts.append(age)
    if record.sex_filter:
        parts.append(f"sex IN ({listed('sex', record.sex_filter)})")
    for name, table, column, codes in (
        ("exc_icd", "condition", "condition_code", split_codes(record.exc_icd, upper=True)),
        ("exc_med", "medication_order", "med_code", split_codes(record.exc_meds)),
    ):
        if codes:
            parts.append(f"patient_sk NOT IN (\n      SELECT patient_sk FROM {{{table}}} WHERE {column} IN ({listed(name, codes)}))")
    where = "\n  AND ".join(parts)
    return f"SELECT patient_sk, mrn, birth_date, sex, race\nFROM {{patient}}\nWHERE {where}", parameters
