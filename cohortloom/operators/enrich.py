"""Row-level enrichment: blood pressure panels, interpretations, notes from templates, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import clinical, codes, text


def bp_panel(readings: DataFrame, systolic: str, diastolic: str) -> DataFrame:
    """A reading becomes three rows: the panel (text sys/dia) and two components that point to it.

    The input's observation_sk is the key of the panel; components get the next two keys.
    """
    sys, dia = F.col(systolic), F.col(diastolic)
    key = F.col("observation_sk")
    shown = F.concat_ws("/", F.round(sys, 0).cast("long").cast("string"), F.round(dia, 0).cast("long").cast("string"))

    def row(offset: int, code: str, value: Column, string: Column, interp: Column, parent: Column) -> Column:
        return F.struct(
            (key + offset).alias("row_sk"), F.lit(code).alias("observation_code"), value.alias("value_numeric"),
            string.alias("value_string"), interp.alias("interpretation"), parent.alias("parent_observation_sk"),
        )

    nothing = F.lit(None)
    rows = F.array(
        row(0, "85354-9", nothing.cast("double"), shown, nothing.cast("string"), nothing.cast("long")),
        row(1, "8480-6", F.round(sys, 1), nothing.cast("string"), clinical.systolic_interpretation(sys), key),
        row(2, "8462-4", F.round(dia, 1), nothing.cast("string"), clinical.diastolic_interpretation(dia), key),
    )
    return readings.select("patient_sk", F.inline(rows)).withColumnRenamed("row_sk", "observation_sk")


def bp_components(rows: DataFrame, value: str = "value_string") -> DataFrame:
    """Split readings such as 120/80 into a systolic and a diastolic row; other texts yield none."""
    systolic, diastolic = clinical.bp_parts(F.col(value))
    parts = F.array(
        F.struct(F.lit("8480-6").alias("observation_code"), systolic.alias("value_numeric")),
        F.struct(F.lit("8462-4").alias("observation_code"), diastolic.alias("value_numeric")),
    )
    return (
        rows.filter(systolic.isNotNull() & diastolic.isNotNull())
        .select(F.col("observation_sk").alias("parent_observation_sk"), "patient_sk", F.inline(parts))
    )


def components_with_panel(observations: DataFrame) -> DataFrame:
    """Blood pressure components joined to the panel they belong to."""
    panels = observations.filter(F.col("observation_code") == "85354-9").select(
        F.col("observation_sk").alias("panel_sk"), F.col("value_string").alias("panel_value")
    )
    components = observations.filter(F.col("observation_code").isin("8480-6", "8462-4"))
    return components.join(panels, components["parent_observation_sk"] == panels["panel_sk"]).select(
        "panel_sk", "panel_value", "observation_sk", "patient_sk", "observation_code", "value_numeric"
    )


def interpreted(observations: DataFrame) -> DataFrame:
    """Observations with name, unit, reference range and interpretation."""
    detailed = codes.with_code_details(
        observations, "observation_code", "loinc",
        {"display": "observation_display", "unit": "unit", "ref_low": "reference_range_low", "ref_high": "reference_range_high"},
    )
    return detailed.withColumn(
        "interpretation",
        clinical.interpretation(
            F.col("observation_code"), F.col("value_numeric"), F.col("reference_range_low"), F.col("reference_range_high")
        ),
    )


def notes_from_templates(
    encounters: DataFrame, templates: list[tuple[str, str, str]], values: dict[str, Column], defaults: dict[str, str] | None = None
) -> DataFrame:
    """Render a note for each encounter from the template of its note category and phenotype.

    `encounters` has encounter_sk, note_category and phenotype; `templates` is a list of (note category,
    phenotype, template). A category without any template uses those of progress notes, and a missing
    combination the progress note of the general phenotype. Among several templates the encounter key
    decides.
    """
    pools: dict[tuple[str, str], list[str]] = {}
    for category, phenotype, template in templates:
        pools.setdefault((category, phenotype), []).append(template)
    library = encounters.sparkSession.createDataFrame(
        [(*key, pool) for key, pool in pools.items()], "_category string, phenotype string, _own array<string>"
    )
    known = F.col("note_category").isin(sorted({category for category, _ in pools}))
    fallback = F.array(*[F.lit(template) for template in pools[("progress", "general")]])
    chosen = (
        encounters.withColumn("_category", F.when(known, F.col("note_category")).otherwise("progress"))
        .join(F.broadcast(library), ["_category", "phenotype"], "left")
        .withColumn("_pool", F.coalesce("_own", fallback))
    )
    template = F.get(F.col("_pool"), F.pmod(F.col("encounter_sk"), F.size("_pool")).cast("int"))
    return chosen.withColumn("note_text", text.render_template(template, values, defaults)).drop("_category", "_own", "_pool")


def with_provenance(df: DataFrame, source_system: str, source_id: Column, source_table: str, ingested_at: Column, loaded_at: Column) -> DataFrame:
    return df.withColumns({
        "source_system": F.lit(source_system), "source_id": source_id.cast("string"),
        "source_table_or_resource": F.lit(source_table), "ingested_at": ingested_at, "loaded_at": loaded_at,
    })


def clean_lab_results(results: DataFrame, number: str, result_text: str) -> DataFrame:
    """Numeric value without the sentinel, taken from the text where only the text has it; text kept."""
    value = F.coalesce(clinical.clean_lab_number(F.col(number)), clinical.numeric_text(F.col(result_text)))
    return results.withColumn("value_numeric", value).withColumn("value_string", F.col(result_text))
