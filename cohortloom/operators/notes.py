"""Extraction runs over clinical notes: requests, answers, mentions, ledger, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import assertion as ctx
from cohortloom.functions.mentions import Lexicon, mentions
from cohortloom.operators.criteria import trusted_mention
from cohortloom.schemas import MENTION, PAGE_SIZE, RESPONSE_BODY
from cohortloom.session import ship_package

DEFAULT_CONFIDENCE = 0.8


# --- which notes, and what is asked -----------------------------------------------------------------


def unprocessed_keys(notes: DataFrame, *processed: DataFrame, limit: int | None = None) -> DataFrame:
    """Keys of notes with text that are in none of the tables of processed notes; the first by key with a limit.

    Only keys are joined, never texts. They are made distinct before: many mentions of one note become
    one row per task.
    """
    todo = notes.filter(F.col("note_text").isNotNull()).select("note_sk")
    if processed:
        done = processed[0].select("note_sk")
        for more in processed[1:]:
            done = done.unionByName(more.select("note_sk"))
        todo = todo.join(done.distinct(), "note_sk", "left_anti")
    return todo if limit is None else todo.orderBy("note_sk").limit(limit)


def unprocessed_notes(notes: DataFrame, *processed: DataFrame, limit: int | None = None) -> DataFrame:
    """The notes of these keys, with their texts."""
    return notes.join(unprocessed_keys(notes, *processed, limit=limit), "note_sk", "left_semi")


def request_text(category: Column, note_text: Column) -> Column:
    shown = F.when(F.coalesce(category, F.lit("")) == "", "unknown").otherwise(category)
    return F.concat(F.lit("NOTE CATEGORY: "), shown, F.lit("\n\nNOTE TEXT:\n"), note_text)


def requests(notes: DataFrame) -> DataFrame:
    return notes.select(
        F.concat(F.lit("note-"), F.col("note_sk").cast("string")).alias("custom_id"),
        request_text(F.col("note_category"), F.col("note_text")).alias("request"),
    )


# --- what comes back ---------------------------------------------------------------------------------


def note_key(custom_id: Column) -> Column:
    """Key of the note an answer belongs to, from a custom id such as note-42; null for any other id."""
    return F.get(F.split(custom_id, "-", 2), F.lit(1)).try_cast("long")


def classified(responses: DataFrame) -> DataFrame:
    """Answers with their entities and outcome; an empty entity list is a good answer, a missing one is not."""
    parsed = responses.withColumn("entities", F.from_json("body", RESPONSE_BODY)["entities"])
    outcome = (
        F.when(F.col("result_type") != "succeeded", "not_succeeded")
        .when(F.col("stop_reason") == "max_tokens", "truncated")
        .when(F.col("stop_reason") == "refusal", "refused")
        .when(F.col("entities").isNull(), "parse_error")
        .otherwise("ok")
    )
    return parsed.select(note_key(F.col("custom_id")).alias("note_sk"), outcome.alias("outcome"), "entities")


def outcome_counts(answers: DataFrame) -> DataFrame:
    return answers.groupBy("outcome").agg(
        F.count("*").alias("n_notes"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "ok", F.size("entities"))), F.lit(0)).alias("n_entities"),
    )


class ExtractionFailed(RuntimeError):
    """Every note of a run failed."""


def check_outcomes(counts: DataFrame) -> dict[str, int]:
    """Number of notes per outcome (at most five rows); raises when notes were answered and none is good."""
    totals = {row["outcome"]: row["n_notes"] for row in counts.collect()}
    if sum(totals.values()) > 0 and totals.get("ok", 0) == 0:
        raise ExtractionFailed(f"all {sum(totals.values())} notes failed: {totals}")
    return totals


def normalised(mention: str = "mention") -> list[Column]:
    """Columns of one mention, with defaults and a certainty that agrees with the negation flag."""

    def get(name: str) -> Column:
        return F.col(f"{mention}.{name}")

    negation = F.coalesce(get("negation"), F.lit(False))
    certainty = F.coalesce(get("certainty"), F.lit("positive"))
    defaults = {
        "negation": negation,
        "certainty": F.when(negation & (certainty == "positive"), "negated").otherwise(certainty),
        "temporality": F.coalesce(get("temporality"), F.lit("current")),
        "subject": F.coalesce(get("subject"), F.lit("patient")),
        "confidence": F.coalesce(get("confidence"), F.lit(DEFAULT_CONFIDENCE)),
    }
    return [defaults.get(name, get(name)).alias(name) for name in MENTION.names]


def entities_of(answers: DataFrame) -> DataFrame:
    """One row per mention of the good answers, with note_sk and the place in the answer."""
    good = answers.filter(F.col("outcome") == "ok")
    return good.select("note_sk", F.posexplode("entities").alias("mention_no", "mention")).select(
        "note_sk", "mention_no", *normalised()
    )


def with_note_keys(entities: DataFrame, notes: DataFrame) -> DataFrame:
    keys = [column for column in ("patient_sk", "encounter_sk") if column in notes.columns]
    return entities.join(notes.select("note_sk", *keys), "note_sk")


# --- extractors ---------------------------------------------------------------------------------------

ANSWER_SCHEMA = T.StructType([
    T.StructField("note_sk", T.LongType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("entities", T.ArrayType(MENTION)),
])


def run_user_function(notes: DataFrame, extract: Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]]) -> DataFrame:
    """Any extraction function over batches of notes (note_sk, note_category, note_text), e.g. a model.

    It yields frames of note_sk, outcome and entities; only the columns it needs are sent to it.
    """
    return notes.select("note_sk", "note_category", "note_text").mapInPandas(extract, ANSWER_SCHEMA)


# Notes are matched against one lexicon that every Python worker holds: at most so many terms.
MOST_TERMS = 2_000_000
# Concepts of up to this many terms (some tens of MB) are broadcast to the mentions found.
BROADCAST_TERMS = 500_000
_FOUND = "_term string, covered_text string, span_start int, span_end int, negation boolean, certainty string, temporality string, subject string"
# Mentions handed on at a time.
_ROWS = 20_000
# The lexicon a Python worker has prepared last.
_PREPARED: dict[int, Lexicon] = {}


def _prepared(terms: Broadcast) -> Lexicon:
    if id(terms.value) not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[id(terms.value)] = Lexicon(terms.value)
    return _PREPARED[id(terms.value)]


def find_mentions(notes: DataFrame, terms: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """note_sk, the note columns in `carry`, and the columns of _FOUND of every mention of the terms. Notes without text have none."""
    shipped = notes.sparkSession.sparkContext.broadcast(terms)
    keys = ["note_sk", *carry]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _prepared(shipped)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("note_text").to_pylist()):
                for mention in mentions(text, lexicon):
                    at.append(i)
                    found.append(mention)
                    if len(found) == _ROWS:
                        yield _batch(batch, keys, at, found)
                        at, found = [], []
            if found:
                yield _batch(batch, keys, at, found)

    texts = notes.filter(F.col("note_text").isNotNull()).select(*keys, "note_text")
    schema = T.StructType([*[texts.schema[name] for name in keys], *T.StructType.fromDDL(_FOUND)])
    return texts.mapInArrow(find, schema)


def _batch(batch: pa.RecordBatch, keys: list[str], at: list[int], found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string()]
    names = [name.split()[0] for name in _FOUND.split(", ")]
    columns = [batch.column(name).take(pa.array(at)) for name in keys] + [pa.array(values, kind) for values, kind in zip(zip(*found), kinds)]
    return pa.RecordBatch.from_arrays(columns, [*keys, *names])


def extract_mentions(notes: DataFrame, lexicon: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mentions of lexicon terms with offsets, code and assertion attributes, and the note columns in `carry` (such as patient_sk).

    Longest term first, left to right, within sentences; one way for lexicons of every length up to MOST_TERMS (more is an error). All work is per note: nothing
    is shuffled unless the lexicon has too many concepts to be broadcast. Terms that differ in case or white space only are one term with several concepts;
    null and blank terms and those without any letter or digit are left out.
    """
    spark = notes.sparkSession
    ship_package(spark)
    if lexicon is None:
        lexicon = spark.createDataFrame(ctx.LEXICON, ctx.LEXICON_SCHEMA).coalesce(1)
    term = F.lower(F.regexp_replace(F.trim("term"), r"\s+", " "))
    concepts = lexicon.select(term.alias("_term"), "entity_type", "concept_code", "concept_system", "concept_display").filter("_term <> ''")
    terms = concepts.select("_term").distinct().limit(MOST_TERMS + 1).toArrow().column(0).to_pylist()
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a lexicon holds at most {MOST_TERMS} terms")
    if len(terms) <= BROADCAST_TERMS:
        concepts = F.broadcast(concepts)
    return find_mentions(notes, terms, carry).join(concepts, "_term").select(
        "note_sk", *carry, "entity_type", "covered_text", "span_start", "span_end", "concept_code", "concept_system", "concept_display", "negation", "certainty",
        "temporality", "subject", F.lit(DEFAULT_CONFIDENCE).alias("confidence"),
    )


# --- summaries ---------------------------------------------------------------------------------------


def run_summary(entities: DataFrame, nlp_run_sk: int | None = None) -> DataFrame:
    """Per entity type: mentions, mean confidence, negated, family history, uncertain."""
    rows = entities if nlp_run_sk is None else entities.filter(F.col("nlp_run_sk") == nlp_run_sk)
    return (
        rows.groupBy("entity_type").agg(
            F.count("*").alias("n_entities"),
            F.round(F.avg("confidence"), 3).alias("avg_confidence"),
            F.count_if(F.col("negation")).alias("n_negated"),
            F.count_if(F.col("temporality") == "family").alias("n_family_history"),
            F.count_if(F.col("certainty") == "uncertain").alias("n_uncertain"),
        ).orderBy(F.col("n_entities").desc(), "entity_type")
    )


def trusted_listing(entities: DataFrame, patients: DataFrame, nlp_run_sk: int, rows: int = PAGE_SIZE) -> DataFrame:
    """Surest asserted, current mentions about the patient, with MRN.

    The rows are chosen before patients are joined: every mention has one patient, so the result is
    the same and the join is tiny.
    """
    chosen = (
        entities.filter((F.col("nlp_run_sk") == nlp_run_sk) & trusted_mention(patient_only=True))
        .join(patients.select("patient_sk"), "patient_sk", "left_semi")
        .orderBy(F.col("confidence").desc(), "entity_sk").limit(rows)
    )
    return chosen.join(patients.select("patient_sk", "mrn"), "patient_sk").select(
        "mrn", "entity_sk", "entity_type", "covered_text", "concept_code", "concept_display", "negation", "certainty",
        "temporality", "subject", "confidence",
    ).orderBy(F.col("confidence").desc(), "entity_sk")


def run_ledger(log: DataFrame) -> DataFrame:
    """State of each run from its append-only log of openings and closings."""
    return log.groupBy("nlp_run_sk").agg(
        F.min("run_started_at").alias("run_started_at"), F.max("run_finished_at").alias("run_finished_at"),
        F.max("note_count").alias("note_count"),
    )
