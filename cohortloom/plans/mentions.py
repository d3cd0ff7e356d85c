"""Queries on extraction runs over clinical notes."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F

from cohortloom.functions import assertion as ctx
from cohortloom.operators import cohort, criteria, notes
from cohortloom.operators.criteria import AllOf, CohortSpec, Criterion, Has
from cohortloom.plans.registry import query, sql_text, values_view
from cohortloom.sources.fixtures import clinical_view, load, with_views

# --- which notes, requests, answers ------------------------------------------------------------------


@query("unprocessed_notes", with_views("clinical_note", "response", "note_version", then="""
SELECT note_sk, note_category, md5(note_text) AS text_md5 FROM clinical_note
WHERE note_text IS NOT NULL
  AND note_sk NOT IN (SELECT CAST(split_part(custom_id, '-', 2) AS BIGINT) FROM response WHERE result_type = 'succeeded')
  AND note_sk NOT IN (SELECT version_id FROM note_version WHERE status = 'addended')"""))
def unprocessed_notes(spark, sf_dir):
    """Notes that neither the answers nor the ledger of processed notes know."""
    tables = load(spark, sf_dir, "clinical_note", "response", "note_version")
    answered = tables["response"].filter("result_type = 'succeeded'").select(notes.note_key(F.col("custom_id")).alias("note_sk"))
    ledger = tables["note_version"].filter("status = 'addended'").select(F.col("version_id").alias("note_sk"))
    todo = notes.unprocessed_notes(tables["clinical_note"], answered, ledger)
    return todo.select("note_sk", "note_category", F.md5("note_text").alias("text_md5"))


@query("unprocessed_notes_capped", with_views("clinical_note", "response", then="""
SELECT note_sk FROM clinical_note
WHERE note_text IS NOT NULL AND note_sk NOT IN (SELECT CAST(split_part(custom_id, '-', 2) AS BIGINT) FROM response WHERE result_type = 'succeeded')
ORDER BY note_sk LIMIT 25"""))
def unprocessed_notes_capped(spark, sf_dir):
    """A run may be limited to the first notes by key."""
    tables = load(spark, sf_dir, "clinical_note", "response")
    answered = tables["response"].filter("result_type = 'succeeded'").select(notes.note_key(F.col("custom_id")).alias("note_sk"))
    return notes.unprocessed_notes(tables["clinical_note"], answered, limit=25).select("note_sk")


@query("request_texts", with_views("clinical_note", then=r"""
SELECT concat('note-', CAST(note_sk AS VARCHAR)) AS custom_id,
       md5(concat('NOTE CATEGORY: ', coalesce(nullif(category, ''), 'unknown'), chr(10), chr(10), 'NOTE TEXT:', chr(10), note_text)) AS request_md5
FROM (SELECT *, CASE WHEN note_category = 'consult' THEN NULL ELSE note_category END AS category FROM clinical_note) AS n"""))
def request_texts(spark, sf_dir):
    """What an extraction model is asked; notes without a category are asked as unknown."""
    rows = clinical_view(spark, sf_dir, "clinical_note").withColumn(
        "note_category", F.when(F.col("note_category") != "consult", F.col("note_category"))
    )
    return notes.requests(rows).select("custom_id", F.md5("request").alias("request_md5"))


@query("response_note_keys", with_views("response", "clinical_note", then="""
SELECT n.note_sk, n.patient_sk, r.result_type
FROM response AS r JOIN clinical_note AS n ON CAST(split_part(r.custom_id, '-', 2) AS BIGINT) = n.note_sk"""))
def response_note_keys(spark, sf_dir):
    tables = load(spark, sf_dir, "response", "clinical_note")
    keyed = tables["response"].select(notes.note_key(F.col("custom_id")).alias("note_sk"), "result_type")
    return notes.with_note_keys(keyed, tables["clinical_note"])


_ANSWER_SQL = """, answer AS (
  SELECT CAST(split_part(custom_id, '-', 2) AS BIGINT) AS note_sk, body,
         CASE WHEN result_type <> 'succeeded' THEN 'not_succeeded' WHEN stop_reason = 'max_tokens' THEN 'truncated'
              WHEN stop_reason = 'refusal' THEN 'refused' WHEN NOT json_valid(body) THEN 'parse_error' ELSE 'ok' END AS outcome
  FROM response)"""


@query("answer_outcomes", with_views("response", then=_ANSWER_SQL + "\nSELECT note_sk, outcome FROM answer"))
def answer_outcomes(spark, sf_dir):
    return notes.classified(clinical_view(spark, sf_dir, "response")).select("note_sk", "outcome")


@query("outcome_counts", with_views("response", then=_ANSWER_SQL + """
SELECT outcome, count(*) AS n_notes,
       CAST(coalesce(sum(CASE WHEN outcome = 'ok' THEN json_array_length(body, '$.entities') END), 0) AS BIGINT) AS n_entities
FROM answer GROUP BY outcome"""))
def outcome_counts(spark, sf_dir):
    return notes.outcome_counts(notes.classified(clinical_view(spark, sf_dir, "response")))


_ENTITY_SQL = _ANSWER_SQL + """, entity AS (
  SELECT note_sk, unnest(CAST(json_extract(body, '$.entities[*]') AS JSON[])) AS e,
         unnest(range(CAST(json_array_length(body, '$.entities') AS BIGINT))) AS mention_no
  FROM answer WHERE outcome = 'ok'),
normal AS (
  SELECT note_sk, mention_no, e->>'entity_type' AS entity_type, e->>'covered_text' AS covered_text,
         CAST(e->>'span_start' AS INT) AS span_start, CAST(e->>'span_end' AS INT) AS span_end,
         e->>'concept_code' AS concept_code, e->>'concept_system' AS concept_system, e->>'concept_display' AS concept_display,
         coalesce(CAST(e->>'negation' AS BOOLEAN), false) AS negation,
         CASE WHEN coalesce(CAST(e->>'negation' AS BOOLEAN), false) AND coalesce(e->>'certainty', 'positive') = 'positive' THEN 'negated'
              ELSE coalesce(e->>'certainty', 'positive') END AS certainty,
         coalesce(e->>'temporality', 'current') AS temporality, coalesce(e->>'subject', 'patient') AS subject,
         coalesce(CAST(e->>'confidence' AS DOUBLE), 0.8) AS confidence
  FROM entity)"""


@query("parsed_entities", with_views("response", then=_ENTITY_SQL + "\nSELECT * FROM normal"))
def parsed_entities(spark, sf_dir):
    """Mentions of the good answers, with defaults; a negated mention is never positive."""
    return notes.entities_of(notes.classified(clinical_view(spark, sf_dir, "response")))


@query("run_ledger", with_views("run_log", then="""
SELECT nlp_run_sk, min(run_started_at) AS run_started_at, max(run_finished_at) AS run_finished_at, max(note_count) AS note_count
FROM run_log GROUP BY nlp_run_sk"""))
def run_ledger(spark, sf_dir):
    return notes.run_ledger(clinical_view(spark, sf_dir, "run_log"))


# --- summaries -------------------------------------------------------------------------------------------


@query("run_summary", with_views("note_nlp_entity", then="""
SELECT entity_type, count(*) AS n_entities, round(avg(confidence), 3) AS avg_confidence,
       CAST(sum(CAST(negation AS INT)) AS BIGINT) AS n_negated,
       count(DISTINCT CASE WHEN temporality = 'family' THEN entity_sk END) AS n_family_history,
       count(DISTINCT CASE WHEN certainty = 'uncertain' THEN entity_sk END) AS n_uncertain
FROM note_nlp_entity WHERE nlp_run_sk = 1 GROUP BY entity_type"""))
def run_summary(spark, sf_dir):
    return notes.run_summary(clinical_view(spark, sf_dir, "note_nlp_entity"), 1)


@query("trusted_listing", with_views("note_nlp_entity", "patient", then="""
SELECT p.mrn, e.entity_sk, e.entity_type, e.covered_text, e.concept_code, e.concept_display, e.negation, e.certainty,
       e.temporality, e.subject, e.confidence
FROM note_nlp_entity AS e JOIN patient AS p ON e.patient_sk = p.patient_sk
WHERE nlp_run_sk = 1 AND NOT negation AND certainty = 'positive' AND temporality = 'current' AND subject = 'patient'
ORDER BY confidence DESC, entity_sk LIMIT 50"""))
def trusted_listing(spark, sf_dir):
    tables = load(spark, sf_dir, "note_nlp_entity", "patient")
    return notes.trusted_listing(tables["note_nlp_entity"], tables["patient"], 1)


# --- the rule-based extractor ----------------------------------------------------------------------------

# The oracle's own words and patterns, stated apart from those of the extractor, so that the two can disagree. Here cues are looked for in the text before
# and behind each mention; the extractor lists those of a sentence once. Patterns of this engine know no look-around.
_W = "[[:space:]]+"
_TERMS = "(?i)(?:" + "|".join(rf"\b{term.replace(' ', _W)}\b" for term in sorted((row[0] for row in ctx.LEXICON), key=len, reverse=True)) + ")"
_SECTION = r"(?m)(^[A-Z][A-Z /&()]{3,}(?::?[ \t\r]*\n\s*)?|^[ \t\r]*\n)"
_MARKED_END = r"([.!?;][ \t\r\n])"
_LISTED = r"\n([ \t]*(?:[-*•–]|[0-9]+[.)]|[A-Z][A-Za-z /&()]{0,40}:))"


def _cues(words: str, behind: str = "") -> str:
    """Any of the words (divided by bars, blanks are any white space), as SQL text."""
    return sql_text(rf"(?i){behind}\b(?:{words.replace(' ', _W)})\b")


_CLAUSE = _cues("but|however|although|though|except|apart from|aside from")
_ASSERTING = _cues("has|have|had|reports|presents|complains|takes|continues")
_NO_NEGATION = _cues("no change|no increase|no further|no dose adjustment|not only|not certain|no doubt")
_NEGATED = _cues("no|not|denies|denied|denying|without|negative for|ruled out|absence of|free of|never|neither|nor|contraindicated")
_NEGATED_BEHIND = _cues("ruled out|not (?:initiated|restarted|started|present|seen)|is absent|(?:was|were) negative|is contraindicated|contraindicated", "^[^.,]*")
_UNCERTAIN = _cues("rule out|r/o|possible|possibly|probable|suspected|suspicion of|suspicious for|cannot exclude|may (?:represent|be|have)|concern for|differential includes|questionable")
_UNCERTAIN_BEHIND = _cues("suspected|cannot be excluded|is possible|not excluded|rule-out", "^[^.,]*")
_HYPOTHETICAL = _cues("if|should|will consider|would consider|consider|in case of|risk (?:of|for)|progression to|(?:warning )?signs of|to screen for|to prevent|defined as")
_HYPOTHETICAL_BEHIND = _cues("develops|develop|defined as", "^[^.,]*")
_RUNNING = _cues("[0-9]+-year history of|[0-9]+ year history of|known history of|long history of|history of present illness")
_PAST = _cues("history of|remote history|past|prior|previous|previously|former|formerly|years ago|status post")
_PAST_BEHIND = _cues("in the past|years (?:ago|prior)|resolved|fully healed", "^[^.,]*")
_FAMILY = _cues("family history|family|mother|father|brother|sister|sibling|aunt|uncle|maternal|paternal|grandmother|grandfather|cousin|parents")
_FAMILY_BEHIND = _cues("in (?:his|her|their) (?:mother|father|brother|sister|aunt|uncle|family)", "^[^.]*")
_OTHER = _cues("spouse|husband|wife|partner|roommate|friend|donor")

# Whole notes: sections, sentences, then every match of the term pattern with its place.
_FOUND_SQL = ", " + values_view("lexicon", "term, entity_type, concept_code, concept_system, concept_display", ctx.LEXICON) + f""", section AS (
  SELECT note_sk, pieces, unnest(range(len(pieces))) AS i
  FROM (SELECT note_sk, string_split(regexp_replace(note_text, {sql_text(_SECTION)}, chr(2) || '\\1', 'g'), chr(2)) AS pieces
        FROM clinical_note) AS s),
sentence AS (
  SELECT note_sk, section_start, section, parts, unnest(range(len(parts))) AS j
  FROM (SELECT note_sk, coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0) AS section_start,
               trim(regexp_extract(pieces[i + 1], '^([A-Z][A-Z /&()]{{3,}})', 1)) AS section,
               string_split(regexp_replace(regexp_replace(pieces[i + 1], {sql_text(_MARKED_END)}, '\\1' || chr(1), 'g'), {sql_text(_LISTED)}, chr(10) || chr(1) || '\\1', 'g'), chr(1)) AS parts
        FROM section) AS t),
hit AS (
  SELECT note_sk, section, parts[j + 1] AS sentence,
         section_start + coalesce(list_sum(list_transform(parts[1:j], lambda x: length(x))), 0) AS sentence_start
  FROM sentence WHERE regexp_matches(parts[j + 1], {sql_text(_TERMS)})),
place AS (
  SELECT *, unnest(range(len(found))) AS k
  FROM (SELECT *, regexp_extract_all(sentence, {sql_text(_TERMS)}) AS found, string_split_regex(sentence, {sql_text(_TERMS)}) AS gaps FROM hit) AS h),
mention AS (
  SELECT note_sk, section, sentence, sentence_start, found[k + 1] AS covered_text,
         list_sum(list_transform(gaps[1:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k], lambda x: length(x))), 0) AS place
  FROM place),
scoped AS (
  SELECT *, string_split_regex(substr(sentence, 1, CAST(place AS BIGINT)), {_CLAUSE})[-1] AS lft,
         string_split_regex(substr(sentence, CAST(place AS BIGINT) + length(covered_text) + 1), {_CLAUSE})[1] AS rgt
  FROM mention),
flagged AS (
  SELECT *, regexp_matches(regexp_replace(string_split_regex(lft, {_ASSERTING})[-1], {_NO_NEGATION}, ' ', 'g'), {_NEGATED})
           OR regexp_matches(rgt, {_NEGATED_BEHIND}) OR starts_with(section, 'NEGATIVE') AS negation,
         regexp_matches(lft, {_HYPOTHETICAL}) OR regexp_matches(rgt, {_HYPOTHETICAL_BEHIND}) AS hypothetical,
         regexp_matches(lft, {_UNCERTAIN}) OR regexp_matches(rgt, {_UNCERTAIN_BEHIND}) AS uncertain,
         regexp_matches(lft, {_FAMILY}) OR regexp_matches(rgt, {_FAMILY_BEHIND}) OR contains(section, 'FAMILY') AS family,
         regexp_matches(regexp_replace(lft, {_RUNNING}, ' ', 'g'), {_PAST})
           OR regexp_matches(rgt, {_PAST_BEHIND}) AS historical,
         regexp_matches(lft, {_OTHER}) AS other_person
  FROM scoped),
extracted AS (
  SELECT note_sk, entity_type, covered_text, CAST(sentence_start + place AS INT) AS span_start,
         CAST(sentence_start + place + length(covered_text) AS INT) AS span_end, concept_code, concept_system, concept_display,
         negation, CASE WHEN negation THEN 'negated' WHEN hypothetical THEN 'hypothetical' WHEN uncertain THEN 'uncertain' ELSE 'positive' END AS certainty,
         CASE WHEN family THEN 'family' WHEN historical THEN 'historical' ELSE 'current' END AS temporality,
         CASE WHEN family THEN 'family' WHEN other_person THEN 'other' ELSE 'patient' END AS subject, CAST(0.8 AS DOUBLE) AS confidence
  FROM flagged JOIN lexicon ON lower(regexp_replace(covered_text, '\\s+', ' ', 'g')) = term)"""


@query("extracted_mentions", with_views("clinical_note", then=_FOUND_SQL + "\nSELECT * FROM extracted"))
def extracted_mentions(spark, sf_dir):
    """Mentions in the whole text of every note, with code, place and assertion attributes."""
    return notes.extract_mentions(clinical_view(spark, sf_dir, "clinical_note"))


@query("mentions_of_long_lexicon", with_views("clinical_note", then=_FOUND_SQL + "\nSELECT * FROM extracted"))
def mentions_of_long_lexicon(spark, sf_dir):
    """The same mentions with a lexicon of 600,000 terms more that no note holds, though they begin like some that are found."""
    lexicon = spark.createDataFrame(ctx.LEXICON, ctx.LEXICON_SCHEMA)
    more = spark.range(600_000).selectExpr(
        "concat('diabetes grade', id % 1000, ' stage', id) AS term", "'problem' AS entity_type", "concat('X', id) AS concept_code", "'own' AS concept_system", "'none' AS concept_display")
    return notes.extract_mentions(clinical_view(spark, sf_dir, "clinical_note"), lexicon.unionByName(more))


@query("cohort_from_notes", with_views("clinical_note", "patient", then=_FOUND_SQL + """
SELECT DISTINCT patient_sk FROM extracted AS e JOIN clinical_note AS n ON e.note_sk = n.note_sk
WHERE (covered_text ILIKE '%diabetes%' OR concept_display ILIKE '%diabetes%') AND NOT negation
  AND certainty = 'positive' AND temporality = 'current' AND subject = 'patient'
  AND patient_sk IN (SELECT patient_sk FROM patient)"""))
def cohort_from_notes(spark, sf_dir):
    """Notes to mentions to cohort: patients whose notes assert diabetes of their own."""
    tables = load(spark, sf_dir, "clinical_note", "patient")
    tables["note_nlp_entity"] = notes.extract_mentions(tables["clinical_note"], carry=("patient_sk",))
    wanted = Criterion("dm", "note_nlp_entity", criteria.mention_matches(["diabetes"], "", patient_only=True), "nlp")
    tables["note_nlp_entity"] = tables["note_nlp_entity"].withColumn("entity_sk", F.xxhash64("note_sk", "span_start"))
    return cohort.evaluate(tables, CohortSpec([wanted], AllOf(Has("dm")), F.lit(True))).select("patient_sk")


def word_finder(word: str, code: str):
    """A user function over batches of notes, in place of a model.

    It is made inside a function, so it travels to the workers by value and they need not have this package.
    """

    def find(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        pattern = re.compile(re.escape(word))
        for batch in batches:
            entities = [
                [
                    {"entity_type": "medication", "covered_text": m.group(), "span_start": m.start(), "span_end": m.end(),
                     "concept_code": code, "concept_system": "RxNorm", "concept_display": None, "negation": False,
                     "certainty": None, "temporality": None, "subject": None, "confidence": None}
                    for m in pattern.finditer(note)
                ]
                for note in batch["note_text"]
            ]
            yield pd.DataFrame({"note_sk": batch["note_sk"], "outcome": "ok", "entities": entities})

    return find


@query("user_function_mentions", with_views("clinical_note", then="""
SELECT note_sk, len(regexp_extract_all(note_text, 'metformin')) AS n_mentions,
       CAST(min(strpos(note_text, 'metformin')) - 1 AS INT) AS first_start
FROM clinical_note WHERE contains(note_text, 'metformin') GROUP BY ALL"""))
def user_function_mentions(spark, sf_dir):
    answers = notes.run_user_function(clinical_view(spark, sf_dir, "clinical_note"), word_finder("metformin", "860975"))
    mentions = notes.entities_of(answers)
    return mentions.groupBy("note_sk").agg(F.count("*").alias("n_mentions"), F.min("span_start").alias("first_start"))
