"""Evidence: rows of the clinical tables that meet the criteria of a cohort.

Each clinical table is scanned once for all criteria on it, whatever their number. Membership needs only
a few fixed-width numbers per patient and criterion (count, first date), so they are aggregated before
the shuffle: a patient with very many rows sends one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.criteria import Criterion, any_of, with_code_flags

# Clinical table -> (key, code, date). Mentions carry no date of their own.
EVIDENCE_COLUMNS: dict[str, tuple[str, str, str | None]] = {
    "condition": ("condition_sk", "condition_code", "recorded_date"),
    "medication_order": ("med_order_sk", "med_code", "start_datetime"),
    "observation": ("observation_sk", "observation_code", "effective_datetime"),
    "procedure": ("procedure_sk", "procedure_code", "performed_datetime"),
    "note_nlp_entity": ("entity_sk", "concept_code", None),
}


def event_date(table: str, df: DataFrame) -> Column:
    """Date of an evidence row; a mention has one only where its note's service date was joined to it."""
    date = EVIDENCE_COLUMNS[table][2]
    if date is None:
        date = "service_date" if "service_date" in df.columns else None
    return F.lit(None).cast("date") if date is None else F.col(date).cast("date")


def _by_table(criteria: list[Criterion]) -> dict[str, list[Criterion]]:
    tables: dict[str, list[Criterion]] = {}
    for criterion in criteria:
        tables.setdefault(criterion.table, []).append(criterion)
    return tables


def criterion_state(tables: Mapping[str, DataFrame], criteria: list[Criterion]) -> DataFrame:
    """One row per patient with any evidence: n_<id> and first_<id> for each criterion."""
    parts = []
    for table, own in _by_table(criteria).items():
        df = with_code_flags(tables[table], [criterion.codes for criterion in own])
        own_ids = {criterion.id: criterion for criterion in own}
        hits = [
            (F.coalesce(own_ids[c.id].matches, F.lit(False)) if c.id in own_ids else F.lit(False)).alias(f"_{c.id}")
            for c in criteria
        ]
        parts.append(
            df.filter(any_of([criterion.matches for criterion in own]))
            .select("patient_sk", event_date(table, df).alias("_date"), *hits)
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    measures = []
    for criterion in criteria:
        hit = F.col(f"_{criterion.id}")
        measures.append(F.count(F.when(hit, 1)).alias(f"n_{criterion.id}"))
        measures.append(F.min(F.when(hit, F.col("_date"))).alias(f"first_{criterion.id}"))
    return rows.groupBy("patient_sk").agg(*measures)


def state_of_rows(rows: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """The same state from stored evidence rows."""
    measures = []
    for criterion in criteria:
        hit = F.col("criterion") == criterion.id
        measures.append(F.count_if(hit).alias(f"n_{criterion.id}"))
        measures.append(F.min(F.when(hit, F.col("event_date"))).alias(f"first_{criterion.id}"))
    return rows.groupBy("patient_sk").agg(*measures)


def evidence_rows(tables: Mapping[str, DataFrame], criteria: list[Criterion]) -> DataFrame:
    """Every row that meets a criterion: one output row per row and criterion it meets."""
    parts = []
    for table, own in _by_table(criteria).items():
        df = with_code_flags(tables[table], [criterion.codes for criterion in own])
        key, code, _ = EVIDENCE_COLUMNS[table]
        label = {c.id: F.struct(F.lit(c.id).alias("criterion"), F.lit(c.source).alias("source")) for c in own}
        matched = F.array_compact(F.array(*[F.when(c.matches, label[c.id]) for c in own]))
        parts.append(
            df.filter(any_of([criterion.matches for criterion in own]))
            .select(
                "patient_sk", F.inline(matched), F.lit(table).alias("table"), F.col(key).alias("ref_sk"),
                F.col(code).alias("code"), event_date(table, df).alias("event_date"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def trigger_rows(rows: DataFrame, keys: tuple[str, ...] = ("patient_sk",)) -> DataFrame:
    """The row that first met each criterion (earliest date, then lowest key), and how many rows met it."""
    first = F.min(F.struct(
        F.coalesce("event_date", F.lit("9999-12-31").cast("date")).alias("d"), "ref_sk", "code", "event_date"
    ))
    return (
        rows.groupBy(*keys, "criterion", "source", "table")
        .agg(first.alias("_first"), F.count("*").alias("n_rows"))
        .select(
            *keys, "criterion", "source", "table", F.col("_first.ref_sk").alias("ref_sk"),
            F.col("_first.code").alias("code"), F.col("_first.event_date").alias("event_date"), "n_rows",
        )
    )


def folded(earlier: DataFrame, later: DataFrame, keys: tuple[str, ...] = ("patient_sk",)) -> DataFrame:
    """Trigger rows of two disjoint sets of evidence as those of both."""
    first = F.min(F.struct(F.coalesce("event_date", F.lit("9999-12-31").cast("date")).alias("d"), "ref_sk", "code", "event_date"))
    columns = [*keys, "criterion", "source", "table", "ref_sk", "code", "event_date", "n_rows"]
    both = earlier.select(*columns).unionByName(later.select(*columns))
    return both.groupBy(*keys, "criterion", "source", "table").agg(first.alias("_first"), F.sum("n_rows").alias("n_rows")).select(
        *keys, "criterion", "source", "table", "_first.ref_sk", "_first.code", "_first.event_date", "n_rows")


def state_and_evidence(triggers: DataFrame, criteria: list[Criterion], required: list[str]) -> DataFrame:
    """Criterion state and sorted array of the required triggers per patient, from the trigger rows.

    A patient has at most one trigger per criterion, so the array's length follows the definition.
    """
    measures = []
    for criterion in criteria:
        own = F.col("criterion") == criterion.id
        measures.append(F.coalesce(F.max(F.when(own, F.col("n_rows"))), F.lit(0)).alias(f"n_{criterion.id}"))
        measures.append(F.max(F.when(own, F.col("event_date"))).alias(f"first_{criterion.id}"))
    entry = F.when(
        F.col("criterion").isin(required), F.struct("criterion", "source", "table", "ref_sk", "code", "event_date", "n_rows")
    )
    return triggers.groupBy("patient_sk").agg(*measures, F.sort_array(F.collect_list(entry)).alias("qualifying_evidence"))


def with_note_date(entities: DataFrame, notes: DataFrame) -> DataFrame:
    """Give mentions the service date of their note, so that they take part in date logic.

    Mentions whose note is not there stay, without a date.
    """
    return entities.join(notes.select("note_sk", "service_date"), "note_sk", "left")
