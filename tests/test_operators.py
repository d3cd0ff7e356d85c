"""Operators on small hand-made rows: nulls, ties, empty lists, brute force, golden sentences."""

import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import assertion, clinical, codes, text
from cohortloom.operators import analysis, cohort, criteria, enrich, evidence, ingest, notes, profile, quality, ranking, review, timeline
from cohortloom.operators.criteria import AllOf, AnyOf, CohortSpec, Criterion, CriteriaRecord, Has
from cohortloom.sources.fixtures import load

D = dt.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- scalars ----------------------------------------------------------------------------------------


def test_code_lists():
    assert criteria.split_codes(" e11.9 ,, i10 ", upper=True) == ["E11.9", "I10"]
    assert criteria.split_codes(" abc ") == ["abc"]
    assert criteria.split_codes("  ") == []


def test_code_list_column(spark):
    assert one(spark, clinical.parse_code_list(F.lit(" a , b,, "))) == ["a", "b"]
    assert one(spark, clinical.parse_code_list(F.lit(""))) == []


def test_age_is_fractional(spark):
    rule = criteria.patient_matches(18, 89, [], F.lit(D(2000, 1, 1)))
    people = spark.createDataFrame([(1, D(1910, 7, 1)), (2, D(1911, 2, 1)), (3, None), (4, D(1982, 6, 1))], "id int, birth_date date").withColumn("sex", F.lit("male"))
    assert rows(people.filter(rule).select("id")) == [(2,)]  # 89.5, 88.9, unknown, 17.6
    assert people.filter(criteria.patient_matches(0, 120, ["female"], F.lit(D(2000, 1, 1)))).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_last_day_of_a_window(spark, kind):
    df = spark.createDataFrame([(1, "2000-01-31 00:00:00"), (2, "2000-01-31 06:00:00"), (3, "2000-02-01 00:00:00"), (4, None), (5, "2000-01-01 00:00:00")], "id int, t string")
    df = df.withColumn("t", F.col("t").cast(kind))
    first, last = F.lit(D(2000, 1, 1)), F.lit(D(2000, 1, 31))
    assert rows(df.filter(clinical.within_days(F.col("t"), first, last)).select("id")) == [(1,), (2,), (5,)]
    assert rows(df.filter(clinical.within_days(F.col("t"), first, last, strict_upper=True)).select("id")) == [(1,), (5,)]


@pytest.mark.parametrize("code, value, want", [
    ("8480-6", 130.0, "normal"), ("8480-6", 130.1, "high"), ("8480-6", 160.0, "high"), ("8480-6", 161.0, "critical"),
    ("8462-4", 85.0, "normal"), ("8462-4", 85.5, "high"), ("4548-4", 4.4, "low"), ("4548-4", 6.5, "normal"),
    ("4548-4", 6.6, "high"), ("4548-4", None, None), ("85354-9", 1.0, None), ("unknown", 1.0, None), ("8480-6", None, None),
])
def test_interpretation(spark, code, value, want):
    df = spark.createDataFrame([(code, value)], "observation_code string, value_numeric double")
    assert enrich.interpreted(df).first().interpretation == want


def test_source_conversions(spark):
    assert one(spark, clinical.internal_day(F.lit(0))) == D(1840, 12, 31)
    assert one(spark, clinical.internal_day(F.lit(58073))) == D(1999, 12, 31)
    assert one(spark, clinical.clean_lab_number(F.lit(9999999.0))) is None
    assert one(spark, clinical.numeric_text(F.lit(" 7.5 "))) == 7.5
    assert one(spark, clinical.numeric_text(F.lit("Positive"))) is None
    assert one(spark, clinical.clamp(F.lit(None).cast("double"), 1, 2)) is None
    assert one(spark, clinical.clamp(F.lit(99.0), 17, 55, 1)) == 55.0
    assert one(spark, clinical.mrn(F.lit(42))) == "MRN-000042"
    assert one(spark, clinical.mrn(F.lit(12345678))) == "MRN-12345678"
    assert one(spark, codes.note_type_code(F.lit("consult"))) == "11488-4"
    assert one(spark, codes.note_type_display(F.lit("nothing"))) == "Progress note"
    assert one(spark, clinical.note_category(F.lit("outpatient"), F.lit(True))) == "hp"


def test_bp_text(spark):
    df = spark.createDataFrame([(1, 7, "120/80"), (2, 7, "bad"), (3, 7, None), (4, 7, " 95 / 60 "), (5, 7, "1200/80")], "observation_sk long, patient_sk long, value_string string")
    assert rows(enrich.bp_components(df)) == [(1, 7, "8462-4", 80.0), (1, 7, "8480-6", 120.0), (4, 7, "8462-4", 60.0), (4, 7, "8480-6", 95.0)]


def test_unknown_code_gets_a_default_display(spark):
    df = spark.createDataFrame([("I10",), ("X99",), (None,)], "condition_code string")
    named = codes.with_code_details(df, "condition_code", "icd10", {"display": "condition_display"}, "Diagnosis")
    assert rows(named) == sorted([("I10", "Essential hypertension"), ("X99", "Diagnosis X99"), (None, None)], key=str)


# --- text -------------------------------------------------------------------------------------------


def test_template_keeps_unknown_keys(spark):
    out = one(spark, text.render_template(F.lit("{name} {he_she} {he_she.capitalize()} {other} {mrn}"), {"name": F.lit("Ann"), "mrn": F.lit(None)}, {"he_she": "they", "mrn": "none"}))
    assert out == "Ann they {he_she.capitalize()} {other} none"


def test_template_choice(spark):
    library = [("progress", "general", "pg0"), ("progress", "general", "pg1"), ("progress", "t2dm", "pt {name}"), ("hp", "t2dm", "ht")]
    df = spark.createDataFrame([
        (0, "hp", "t2dm"), (1, "hp", "general"), (2, "hp", "other"), (3, "consult", "t2dm"), (4, "consult", "other"), (5, None, "t2dm"),
    ], "encounter_sk long, note_category string, phenotype string")
    out = {r.encounter_sk: r.note_text for r in enrich.notes_from_templates(df, library, {"name": F.lit("Ann")}).collect()}
    assert out == {0: "ht", 1: "pg1", 2: "pg0", 3: "pt Ann", 4: "pg0", 5: "pt Ann"}


def test_html(spark):
    html = '<html><style>p{x}</style><script>var a="</p>";</script><!-- c --><h1>A &amp; B</h1><p>x&nbsp;<b>y</b><br>z</p></html>'
    assert one(spark, text.html_to_text(F.lit(html))) == "A & B\nx y\nz"


def test_entities_are_decoded_once(spark):
    cases = {
        "a &amp;lt; b": "a &lt; b", "&lt;p&gt; &quot;x&quot; &apos;y&apos;": "<p> \"x\" 'y'", "&eacute;&Eacute;&hellip;&#8364;&#x20AC;&#X1F600;": "éÉ…€€😀",
        "&#150;&#x92;": "–’", "&unknown; &amp &;": "&unknown; &amp &;", "&#0;&#xD800;&#1114112;&#9999999;": "\ufffd" * 4, "&NotEqualTilde;": "≂̸",
        "&CounterClockwiseContourIntegral;": "∳", "no entity": "no entity", "": "", "&amp;": "&", "x&nbsp;y": "x\u00a0y", "$1&copy;\\": "$1©\\", None: None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text.decode_entities(F.col("t")).alias("out")).collect()
    assert [r.out for r in sorted(rows, key=lambda r: r.i)] == list(cases.values())


def test_html_by_hand(spark):
    html = "<div>caf&eacute;&nbsp; &mdash;  x</div>\r\n\t<p>1 &lt; 2 &amp;amp; 3</p><ul><li>a</li><li>b</li></ul>"
    assert one(spark, text.html_to_text(F.lit(html))) == "café — x\n1 < 2 &amp; 3\na\nb"


def test_deidentification(spark):
    raw = "Mail a.b@c.example.com or éx@y.org, call +1 (499) 555-6503, MRN-000042, see https://x.y/z?a=1 now. BP 120/80."
    clean, counts = text.deidentify(F.lit(raw))
    out = spark.range(1).select(clean.alias("t"), *[n.alias(k) for k, n in counts.items()]).first()
    assert out.t == "Mail [EMAIL] or é[EMAIL], call [PHONE], [ID], see [URL] now. BP 120/80."
    assert (out.url, out.email, out.phone, out.id) == (1, 2, 1, 1)
    clean, counts = text.deidentify(F.lit(None).cast("string"))
    assert spark.range(1).select(clean.alias("t"), counts["id"].alias("n")).first() == (None, None)


def test_lines_are_joined_in_line_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 10, "c"), (1, 1, "a"), (2, 7, "only")], "note_id int, line int, text string")
    assert rows(text.reassemble_lines(df, ["note_id"], "line", "text")) == [(1, "a\nb\nc"), (2, "only")]


# --- assertion ---------------------------------------------------------------------------------------

P, N, U, H = "positive", "negated", "uncertain", "hypothetical"
GOLDEN = [
    ("Patient with type 2 diabetes mellitus on treatment.", "type 2 diabetes mellitus", P, "current", "patient"),
    ("Continue metformin 1000 mg twice daily.", "metformin", P, "current", "patient"),
    ("Coronary artery disease, stable.", "Coronary artery disease", P, "current", "patient"),
    ("Chronic heart failure with reduced ejection fraction.", "heart failure", P, "current", "patient"),
    ("CT angiography ruled out pulmonary embolism.", "pulmonary embolism", N, "current", "patient"),
    ("No evidence of acute myocardial infarction.", "myocardial infarction", N, "current", "patient"),
    ("Patient denies chest pain at rest.", "chest pain", N, "current", "patient"),
    ("Father had coronary artery disease at age 58.", "coronary artery disease", P, "family", "family"),
    ("Her mother and aunt both have type 2 diabetes.", "type 2 diabetes", P, "family", "family"),
    ("Remote history of a foot ulcer that healed.", "foot ulcer", P, "historical", "patient"),
    ("No signs of pneumonia.", "pneumonia", N, "current", "patient"),
    ("Denies diabetes mellitus.", "diabetes mellitus", N, "current", "patient"),
    ("History of acute pancreatitis in 2019.", "pancreatitis", P, "historical", "patient"),
    ("If control stays poor, will consider basal insulin.", "insulin", H, "current", "patient"),
    ("Rule out peptic ulcer disease.", "peptic ulcer", U, "current", "patient"),
    ("Rule out early pneumonia.", "pneumonia", U, "current", "patient"),
    ("Reports polydipsia, nocturia and polyphagia.", "nocturia", P, "current", "patient"),
    ("New hyperglycemia; rule out type 1 diabetes versus type 2 diabetes.", "type 1 diabetes", U, "current", "patient"),
    ("New hyperglycemia; rule out type 1 diabetes versus type 2 diabetes.", "type 2 diabetes", U, "current", "patient"),
    ("Eye exam shows no signs of diabetic retinopathy.", "diabetic retinopathy", N, "current", "patient"),
    ("Tingling in both feet from peripheral neuropathy.", "peripheral neuropathy", P, "current", "patient"),
    ("Adherent to therapy, with no episodes of severe hypoglycemia.", "severe hypoglycemia", N, "current", "patient"),
    ("Patient denies fatigue, polyuria, or polydipsia.", "fatigue", N, "current", "patient"),
    ("Patient denies fatigue, polyuria, or polydipsia.", "polydipsia", N, "current", "patient"),
    ("Family history is positive for type 2 diabetes mellitus in her mother.", "type 2 diabetes mellitus", P, "family", "family"),
    ("Prediabetes found on routine screening.", "Prediabetes", P, "current", "patient"),
    # traps
    ("She has a 12-year history of type 2 diabetes.", "type 2 diabetes", P, "current", "patient"),
    ("Man with a known history of heart failure.", "heart failure", P, "current", "patient"),
    ("HISTORY OF PRESENT ILLNESS: woman with hypertension.", "hypertension", P, "current", "patient"),
    ("No family history of stroke.", "stroke", N, "family", "family"),
    ("No prior diagnosis of diabetes mellitus.", "diabetes mellitus", N, "historical", "patient"),
    ("Metformin not initiated at this time.", "Metformin", N, "current", "patient"),
    ("He is not currently on metformin.", "metformin", N, "current", "patient"),
    ("Return if dyspnea develops.", "dyspnea", H, "current", "patient"),
    ("Risk of progression to type 2 diabetes was discussed.", "type 2 diabetes", H, "current", "patient"),
    ("Educated on warning signs of diabetes: polyuria.", "diabetes", H, "current", "patient"),
    ("No fever but cough persists.", "fever", N, "current", "patient"),
    ("No fever but cough persists.", "cough", P, "current", "patient"),
    ("FAMILY HISTORY\n- Father: type 2 diabetes\nMEDICATIONS\n1. Metformin daily", "type 2 diabetes", P, "family", "family"),
    ("FAMILY HISTORY\n- Father: type 2 diabetes\nMEDICATIONS\n1. Metformin daily", "Metformin", P, "current", "patient"),
    ("REVIEW OF SYSTEMS\nPOSITIVE: Fatigue.\nNEGATIVE: Chest pain. Dyspnea.", "Dyspnea", N, "current", "patient"),
    ("REVIEW OF SYSTEMS\nPOSITIVE: Fatigue.\nNEGATIVE: Chest pain. Dyspnea.", "Fatigue", P, "current", "patient"),
    ("NEGATIVE: Chest pain. Dyspnea.\n\nPatient has diabetes.", "diabetes", P, "current", "patient"),
    ("NEGATIVE: Chest pain. Dyspnea.\n\nPatient has diabetes.", "Dyspnea", N, "current", "patient"),
    ("FAMILY HISTORY:\n\n  - Father: stroke\n  - Mother: well\n \nHas polyuria.", "stroke", P, "family", "family"),
    ("FAMILY HISTORY:\n\n  - Father: stroke\n  - Mother: well\n \nHas polyuria.", "polyuria", P, "current", "patient"),
    ("PLAN\n1. Hypertension, at goal.\n2. If creatinine rises, hold metformin.", "Hypertension", P, "current", "patient"),
    ("PLAN\n1. Hypertension, at goal.\n2. If creatinine rises, hold metformin.", "metformin", H, "current", "patient"),
    ("Her husband has diabetes.", "diabetes", P, "current", "other"),
    ("Possible pneumonia on the film.", "pneumonia", U, "current", "patient"),
    ("No change in heart failure.", "heart failure", P, "current", "patient"),
]


def test_golden_sentences(spark):
    texts = list(dict.fromkeys(row[0] for row in GOLDEN))
    df = spark.createDataFrame(list(enumerate(texts)), "note_sk long, note_text string")
    found = {(texts[r.note_sk], r.covered_text): (r.certainty, r.temporality, r.subject) for r in notes.extract_mentions(df).collect()}
    wrong = [(s, m, found.get((s, m)), want) for s, m, *want in GOLDEN if found.get((s, m)) != tuple(want)]
    assert wrong == []


def test_mentions_by_brute_force(spark):
    """Terms found against a plain scan, on texts with overlapping terms and odd separators."""
    rng = random.Random(7)
    words = ["diabetes", "type 2", "mellitus", "Type 2 Diabetes", "prediabetes", "cough", "dry cough", "coughs", "x", ".", ";", "é", "insulin", "glargine", "-", "DRY"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "", ". ", "\n"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    terms = sorted((row[0] for row in assertion.LEXICON), key=len, reverse=True)

    def scan(note):
        found, at = [], 0
        letter = lambda i: 0 <= i < len(note) and (note[i].isalnum() or note[i] == "_")
        while at < len(note):
            for term in terms:
                here = re.compile(term.replace(" ", r"\s+"), re.I).match(note, at)
                if here and not letter(at - 1) and not letter(here.end()):
                    found.append((here.group(), at))
                    at = here.end()
                    break
            else:
                at += 1
        return found

    df = spark.createDataFrame(list(enumerate(texts)), "note_sk long, note_text string")
    want = sorted((i, t, a) for i, note in enumerate(texts) for t, a in scan(note))
    got = sorted((r.note_sk, r.covered_text, r.span_start) for r in notes.extract_mentions(df).collect())
    assert set(got) ^ set(want) == set() and got == want and len(want) > 100


# --- answers ------------------------------------------------------------------------------------------

BODY = '{"entities": [{"entity_type": "problem", "covered_text": "x", "span_start": null, "span_end": 3, "concept_code": null, "negation": true, "certainty": "positive"}]}'


def test_answers(spark):
    df = spark.createDataFrame([
        ("note-1", "succeeded", "end_turn", BODY), ("note-2", "succeeded", "end_turn", '{"entities": []}'),
        ("note-3", "succeeded", "max_tokens", BODY), ("note-4", "succeeded", "refusal", ""),
        ("note-5", "succeeded", "end_turn", '{"entities": [{"entity'), ("note-6", "errored", None, None),
        ("note-7", "succeeded", "end_turn", "{}"),
    ], "custom_id string, result_type string, stop_reason string, body string")
    answers = notes.classified(df)
    outcome = {r.note_sk: r.outcome for r in answers.collect()}
    assert outcome == {1: "ok", 2: "ok", 3: "truncated", 4: "refused", 5: "parse_error", 6: "not_succeeded", 7: "parse_error"}
    (mention,) = notes.entities_of(answers).collect()
    assert (mention.note_sk, mention.certainty, mention.temporality, mention.subject, mention.confidence) == (1, "negated", "current", "patient", 0.8)
    assert mention.span_start is None and mention.span_end == 3
    assert notes.check_outcomes(notes.outcome_counts(answers))["ok"] == 2
    with pytest.raises(notes.ExtractionFailed):
        notes.check_outcomes(notes.outcome_counts(answers.filter("outcome <> 'ok'")))
    assert notes.check_outcomes(notes.outcome_counts(answers.limit(0))) == {}


def test_unprocessed_notes(spark):
    texts = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "note_sk long, note_text string")
    entities = spark.createDataFrame([(1,), (1,)], "note_sk long")
    ledger = spark.createDataFrame([(3,)], "note_sk long")
    assert rows(notes.unprocessed_notes(texts, entities, ledger)) == [(4, "d")]
    assert rows(notes.unprocessed_notes(texts, limit=2)) == [(1, "a"), (3, "c")]


def test_request_of_a_note_without_category(spark):
    assert one(spark, notes.request_text(F.lit(None).cast("string"), F.lit("T"))) == "NOTE CATEGORY: unknown\n\nNOTE TEXT:\nT"


# --- cohorts -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clinic(spark):
    return {
        "patient": spark.createDataFrame([(i, f"M{i}", D(1950, 1, 1), "male" if i % 2 else "female", "r") for i in range(1, 9)], "patient_sk long, mrn string, birth_date date, sex string, race string"),
        "condition": spark.createDataFrame([
            (1, 1, "E11.9", "active", D(2000, 1, 1)), (2, 1, "E11.9", "active", D(1999, 1, 1)), (3, 2, "E11.9", "resolved", D(2000, 1, 1)),
            (4, 3, "I10", "active", D(2000, 5, 1)), (5, 4, None, "active", D(2000, 1, 1)), (6, 5, "I50.9", None, None), (7, 5, "E11.9", "active", D(2000, 2, 1)),
        ], "condition_sk long, patient_sk long, condition_code string, clinical_status string, recorded_date date"),
        "medication_order": spark.createDataFrame([(1, 1, "860975", "active", dt.datetime(2001, 1, 1)), (2, 6, "860975", "active", dt.datetime(2001, 1, 1))], "med_order_sk long, patient_sk long, med_code string, order_status string, start_datetime timestamp"),
        "note_nlp_entity": spark.createDataFrame([
            (1, 1, "problem", "50% type_2 diabetes", None, None, False, "positive", "current", "patient"),
            (2, 7, "problem", "it's diabetes", "E11.9", "Diabetes", False, "positive", "current", "patient"),
            (3, 8, "problem", "diabetes", "E11.9", None, True, "negated", "current", "patient"),
            (4, 8, "problem", "diabetes", None, "x", False, "positive", "family", "family"),
        ], "entity_sk long, patient_sk long, entity_type string, covered_text string, concept_code string, concept_display string, negation boolean, certainty string, temporality string, subject string"),
    }


def members(clinic, **fields):
    spec = criteria.cohort_spec(CriteriaRecord(**fields), "2002-01-01")
    return sorted(r.patient_sk for r in cohort.build_cohort(clinic, spec).collect())


def test_criteria(clinic):
    assert members(clinic) == list(range(1, 9))
    assert members(clinic, icd_codes="e11.9") == [1, 5]
    assert members(clinic, icd_codes="e11.9", icd_status=["active", "resolved"]) == [1, 2, 5]
    assert members(clinic, icd_codes="e11.9", exc_icd="i50.9") == [1]
    assert members(clinic, exc_icd="E11.9, I50.9") == [3, 4, 6, 7, 8]
    assert members(clinic, exc_meds="860975", sex_filter=["female"]) == [2, 4, 8]
    assert members(clinic, icd_codes="E11.9", med_codes="860975") == [1]
    assert members(clinic, nlp_terms="_2") == [1]
    assert members(clinic, nlp_terms="%") == [1]
    assert members(clinic, nlp_terms="it's") == [7]
    assert members(clinic, nlp_terms="DIABETES") == [1, 7]
    assert members(clinic, nlp_concept="E11.9") == [7]
    assert members(clinic, nlp_terms="diabetes", nlp_temporality=["current", "family"]) == [1, 7, 8]
    assert members(clinic, nlp_terms="diabetes", nlp_temporality=["current", "family"], nlp_patient_only=True) == [1, 7]
    assert members(clinic, nlp_terms="diabetes", nlp_entity_types=["medication"]) == []
    assert members(clinic, icd_codes="E11.9", min_age=60) == []


def test_not_in_equals_anti_join(clinic, spark):
    clinic["patient"].createOrReplaceTempView("p_")
    clinic["condition"].createOrReplaceTempView("c_")
    sql = "SELECT patient_sk FROM p_ WHERE patient_sk NOT IN (SELECT patient_sk FROM c_ WHERE condition_code IN ('E11.9'))"
    assert sorted(r[0] for r in spark.sql(sql).collect()) == members(clinic, exc_icd="E11.9")


def test_record_round_trip():
    record = CriteriaRecord(icd_codes="E11.9, 'x' \"y\"", lab_min=6.5, sex_filter=["male"], nlp_terms="50%_'a'")
    assert CriteriaRecord.from_json(record.to_json()) == record
    assert len(record.__dict__) == 20


def test_expression_dates(clinic, spark):
    crit = [
        Criterion("dm", "condition", F.col("condition_code") == "E11.9"), Criterion("met", "medication_order", F.col("med_code") == "860975"),
        Criterion("htn", "condition", F.col("condition_code") == "I10"), Criterion("hf", "condition", F.col("condition_code") == "I50.9"),
    ]
    spec = CohortSpec(crit, AnyOf(AllOf(Has("dm"), Has("met")), Has("htn")) & ~Has("hf"), F.lit(True))
    got = {r.patient_sk: r.index_date for r in cohort.qualified_members(clinic, spec).collect()}
    assert got == {1: D(2001, 1, 1), 3: D(2000, 5, 1)}
    either = CohortSpec(crit, Has("dm") | Has("met"), F.lit(True))
    got = {r.patient_sk: r.index_date for r in cohort.qualified_members(clinic, either).collect()}
    assert got == {1: D(1999, 1, 1), 2: D(2000, 1, 1), 5: D(2000, 2, 1), 6: D(2001, 1, 1)}


def test_undated_evidence_and_triggers(clinic):
    crit = [Criterion("dm", "condition", F.col("condition_code") == "E11.9"), Criterion("note", "note_nlp_entity", criteria.mention_matches(["diabetes"], ""), "nlp")]
    spec = CohortSpec(crit, Has("dm") | Has("note"), F.lit(True))
    got = {r.patient_sk: r for r in cohort.members_with_evidence(clinic, spec).collect()}
    assert {k: v.qualifying_source for k, v in got.items()} == {1: "both", 2: "coded", 5: "coded", 7: "nlp"}
    assert got[7].index_date is None and got[1].index_date == D(1999, 1, 1)
    assert [(e.criterion, e.ref_sk, e.n_rows) for e in got[1].qualifying_evidence] == [("dm", 2, 2), ("note", 1, 1)]
    # the state is the same from stored rows
    state = evidence.state_of_rows(evidence.evidence_rows(clinic, crit), crit)
    assert rows(state) == rows(evidence.criterion_state(clinic, crit).select(*state.columns))


def test_control_cohort_is_disjoint_from_cases(clinic):
    record = CriteriaRecord(icd_codes="E11.9", med_codes="860975")
    controls = {r.patient_sk for r in cohort.control_cohort(clinic, record, "2002-01-01").collect()}
    assert controls == {2, 3, 4, 7, 8}


@pytest.mark.parametrize("texts, want", [
    (("E11.9, I10", "1", "", "", ""), ("E11.9", "ICD-10-CM")), (("", " 860975,1", "", "", ""), ("860975", "RxNorm")),
    (("", "", " 4548-4 ", "1", ""), ("4548-4", "LOINC")), (("", "", "", "44054006", "t"), ("44054006", "SNOMED")),
    (("", "", "", "", "chest pain, cough"), ("chest pain", "NLP-term")), (("", "", "", "", ""), ("", "NLP-term")),
])
def test_primary_concept(spark, texts, want):
    assert tuple(spark.range(1).select(*criteria.primary_concept(*[F.lit(t) for t in texts])).first()) == want


# --- positions --------------------------------------------------------------------------------------------


def test_numbered_equals_row_number_on_a_hot_key(spark):
    from pyspark.sql import Window

    df = spark.range(5000).select(
        F.col("id").alias("encounter_sk"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("patient_sk"),
        F.when(F.col("id") % 41 != 0, F.date_add(F.lit(D(2000, 1, 1)), (F.col("id") * 7919 % 900).cast("int"))).alias("period_start"),
    )
    w = Window.partitionBy("patient_sk").orderBy(F.col("period_start").asc_nulls_first(), "encounter_sk")
    want = df.select("encounter_sk", (F.row_number().over(w) - 1).cast("long"))
    got = ranking.encounter_index(df).select("encounter_sk", "encounter_index")
    assert rows(got) == rows(want)


def test_diagnosis_rank(spark):
    df = spark.createDataFrame([
        (1, 10, "E11.9", D(2000, 1, 1)), (2, 10, "I10", D(2000, 1, 1)), (3, 10, "J06.9", D(2000, 1, 1)), (4, 10, "M54.5", D(1999, 1, 1)),
        (5, 20, "J06.9", D(2000, 1, 1)), (6, None, "I10", D(2000, 1, 1)), (7, 30, "I10", None),
    ], "condition_sk long, encounter_sk long, condition_code string, recorded_date date")
    got = {r.condition_sk: r.diagnosis_rank for r in ranking.diagnosis_rank(df, codes.BACKGROUND_ICD10).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 1, 6: None, 7: 1}


def test_top_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    top = ranking.top_per_group(df, ["k"], [F.col("id").desc()], 2)
    assert top.count() == 14
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_latest_with_ties(spark):
    t = dt.datetime(2000, 1, 1)
    df = spark.createDataFrame([(1, 5, "4548-4", t, 6.0), (1, 9, "4548-4", t, 7.0), (1, 10, "4548-4", t, None), (2, 1, "8480-6", t, 120.0)], "patient_sk long, observation_sk long, observation_code string, effective_datetime timestamp, value_numeric double")
    assert rows(ranking.latest_values(df, {"a": "4548-4", "b": "8480-6"})) == [(1, 7.0, None), (2, None, 120.0)]
    log = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 1, "z")], "k int, at int, v string")
    assert rows(ranking.latest_per_key(log, ["k"], ["at"])) == [(1, 2, None), (2, 1, "z")]


def test_lab_trend_of_a_chosen_code(spark):
    t = dt.datetime
    df = spark.createDataFrame([(1, "laboratory", "a", t(2000, 1, 2), 2.0, None), (2, "laboratory", "a", t(2000, 1, 1), 1.0, None), (3, "laboratory", "b", t(2000, 1, 3), None, None), (4, "laboratory", "a", t(2000, 1, 1), 9.0, 1)], "observation_sk long, category string, observation_code string, effective_datetime timestamp, value_numeric double, parent_observation_sk long")
    assert [r.observation_sk for r in timeline.lab_trend(df, "a").collect()] == [2, 1]
    assert timeline.lab_trend(df).count() == 0  # the newest result has no number


# --- ingest, quality ----------------------------------------------------------------------------------------


def test_crosswalk_fan_out(spark):
    entries = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c")], "encounter_sk int, dx_id string")
    crosswalk = spark.createDataFrame([("a", "I10"), ("a", "E11.9"), ("b", "I10"), ("b", "I10")], "dx_id string, icd10 string")
    assert rows(ingest.diagnoses_by_crosswalk(entries, crosswalk)) == [(1, "E11.9"), (1, "I10")]


def test_identity_linkage(spark):
    ids = spark.createDataFrame([(5, "MRN", "A", "1"), (3, "MRN", "A", "1"), (3, "MRN", "B", "2"), (9, "MRN", "B", "9"), (9, "SSN", "x", None), (4, "SSN", "x", None)], "source_key int, identifier_type string, assigning_authority string, identifier_value string")
    assert rows(ingest.link_identities(ids)) == [(3, 3), (4, 4), (5, 3), (9, 9)]


def test_billed_flag(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "p int, c string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "p int, c string")
    assert rows(ingest.clinical_and_billed(a, b, ["p", "c"])) == [(1, "x", True), (2, "y", False), (3, "z", True)]


def test_html_attachment(spark):
    import base64
    import json

    data = base64.b64encode("<p>A<br>é</p>".encode()).decode()
    line = json.dumps({"resourceType": "DocumentReference", "id": "7", "subject": {"reference": "Patient/3"}, "content": [{"attachment": {"contentType": "text/html", "data": data}}]})
    raw = ingest.land_resources(spark.createDataFrame([(line,), ("not json",)], "value string"), "s", "b", F.current_timestamp())
    note = ingest.conform_notes(raw).first()
    assert (note.note_sk, note.patient_sk, note.note_text, note.text_extraction_method, note.text_char_length) == (7, 3, "A\né", "html_stripped", 3)
    assert raw.count() == 2  # lines that are no resource stay in the landing table


def test_orphans_keys_and_value_sets(spark):
    patients = spark.createDataFrame([(1, "a", "male"), (2, None, "man"), (2, "c", None)], "patient_sk long, mrn string, sex string")
    encounters = spark.createDataFrame([(1, 1), (2, 9), (3, 9), (4, None)], "encounter_sk long, patient_sk long")
    assert rows(quality.referential_integrity({"patient": patients, "encounter": encounters})) == [("encounter.patient_sk", "patient", 2, 1)]
    assert rows(quality.key_checks({"patient": patients})) == [("patient", 3, 0, 1, 1)]
    assert rows(quality.value_set_checks({"patient": patients})) == [("patient.sex", "man", 1)]


# --- studies ------------------------------------------------------------------------------------------------


def test_followed_within_by_brute_force(spark):
    rng = random.Random(3)
    day = lambda: D(2000, 1, 1) + dt.timedelta(days=rng.randrange(400))
    first = [(p, day()) for p in range(40) for _ in range(rng.randrange(6))] + [(0, None)]
    then = [(p, day()) for p in range(40) for _ in range(rng.randrange(6))]
    want = []
    for p in range(40):
        pairs = [(b, a) for (q, a), (r, b) in itertools.product(first, then) if q == r == p and a and 0 <= (b - a).days <= 30]
        if pairs:
            b = min(b for b, _ in pairs)
            want.append((p, max(a for x, a in pairs if x == b), b))
    schema = "patient_sk int, event_date date"
    got = analysis.followed_within(spark.createDataFrame(first, schema), spark.createDataFrame(then, schema), 30)
    assert rows(got) == sorted(want, key=str) and len(want) > 5


def km(times):
    """Survival by the definition, one subject at a time."""
    survival, out = 1.0, []
    for t in sorted({d for d, e in times if e}):
        at_risk, events = sum(d >= t for d, _ in times), sum(d == t and e for d, e in times)
        survival *= 1 - events / at_risk
        out.append((t, at_risk, events, round(survival, 9)))
    return out


@pytest.mark.parametrize("times", [
    [(5, True), (5, True), (5, False), (7, True), (9, False)], [(1, True), (2, True), (3, True)], [(4, False), (6, False)],
    [(0, True), (0, False), (10, True), (10, True)],
])
def test_kaplan_meier(spark, times):
    df = spark.createDataFrame([(i, d, e) for i, (d, e) in enumerate(times)], "patient_sk int, days int, event boolean")
    got = [(r.days, r.at_risk, r.events, round(r.survival, 9)) for r in analysis.kaplan_meier(df).orderBy("days").collect()]
    assert got == km(times)


def test_matching_uses_every_control_once(spark):
    people = spark.createDataFrame([(i, "male" if i % 3 else "female", D(1950 + i % 20, 1, 1)) for i in range(300)], "patient_sk long, sex string, birth_date date")
    cases = people.filter("patient_sk % 10 = 0")
    pairs = analysis.matched_controls(cases, people, people, "2000-01-01", 3).collect()
    assert len({p.control_sk for p in pairs}) == len(pairs)
    per_case = {}
    for p in pairs:
        per_case.setdefault(p.case_sk, []).append(p.control_sk)
        assert p.case_sk % 10 == 0 and p.control_sk % 10 != 0
    assert len(per_case) == 30 and all(len(c) == 3 for c in per_case.values())


def test_difference_with_itself_is_empty(spark):
    a = spark.createDataFrame([(1,), (2,)], "patient_sk long")
    assert {r.change for r in analysis.membership_difference(a, a).collect()} == {"kept"}
    b = spark.createDataFrame([(2,), (3,)], "patient_sk long")
    assert rows(analysis.membership_difference(a, b)) == [(1, "dropped"), (2, "kept"), (3, "added")]


def test_open_windows_around_the_index_date(spark):
    who = spark.createDataFrame([(1, D(2000, 1, 10), None), (2, D(2000, 1, 10), 5)], "patient_sk long, index_date date, lookback int")
    events = spark.createDataFrame([(p, D(2000, 1, d)) for p in (1, 2) for d in (1, 6, 20)], "patient_sk long, day date")
    both_open = cohort.events_around_index(who, events, F.col("day"), None, None)
    assert both_open.count() == 6
    by_column = cohort.events_around_index(who.select("patient_sk", "index_date"), events.join(who.select("patient_sk", "lookback"), "patient_sk"), F.col("day"), F.col("lookback"), 0)
    assert rows(by_column.select("patient_sk", "day")) == [(1, D(2000, 1, 1)), (1, D(2000, 1, 6)), (2, D(2000, 1, 6))]


def test_lab_distribution_sketch_is_close(spark):
    df = spark.range(10000).select(F.lit("4548-4").alias("observation_code"), (F.col("id") / 100.0).alias("value_numeric"))
    exact, sketch = profile.lab_distribution(df, "4548-4").first(), profile.lab_distribution(df, "4548-4", exact=False).first()
    assert (exact.p25, exact.p75, exact.n) == (25.0, 74.99, 10000)
    assert abs(exact.p25 - sketch.p25) < 0.1 and abs(exact.p75 - sketch.p75) < 0.1
    assert profile.lab_distribution(df, "none").first().n == 0


@pytest.mark.parametrize("values", [
    [0.1 * i for i in range(1001)], [5.0] * 50, [1.0, 2.0], [-1e308, 0.0, 1e-300, 1e308, 1.5e308], [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0] * 7,
    [1e300] + [i / 7 for i in range(3000)], [3.5],
])
def test_exact_quartiles_of_any_values(spark, values):
    df = spark.createDataFrame([("x", v) for v in values] + [("x", None), ("x", float("nan")), ("y", 1.0)], "observation_code string, value_numeric double")
    counted = df.filter("observation_code = 'x' AND value_numeric < double('inf')").groupBy("value_numeric").count()
    ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
    assert profile.values_at(counted, "value_numeric", "count", ranks) == {r: sorted(values)[r] for r in ranks}
    assert profile.lab_distribution(df, "x").first().n == len(values)


def test_people_are_linked_through_others_but_not_by_placeholders(spark):
    from cohortloom.operators import linkage

    chain = [(k, "ssn" if k % 2 else "mpi", "a", str((k + 1) // 2)) for k in range(100, 160)] + [(k, "mpi" if k % 2 else "ssn", "a", str(k // 2)) for k in range(100, 160)]
    others = [(k, "ssn", "a", "000-00-0000") for k in range(120)] + [(1, "x", None, "7"), (2, "x", None, "7"), (3, "x", "b", "7"), (90, "x", "b", "7"), (None, "x", "b", "7"), (300, None, None, None)]
    rows = chain + others
    df = spark.createDataFrame(rows, "source_key long, identifier_type string, assigning_authority string, identifier_value string")
    holders, parent = {}, {}
    for k, *i in rows:
        if k is not None:
            parent.setdefault(k, k)
            if None not in i:
                holders.setdefault(tuple(i), set()).add(k)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for own in holders.values():
        if len(own) <= 100:
            for k in own:
                a, b = sorted((root(k), root(min(own))))
                parent[b] = a
    assert {r.source_key: r.patient_sk for r in linkage.linked_people(df).collect()} == {k: root(k) for k in parent}
    assert linkage.linked_people(df.limit(0)).collect() == []


def test_cohort_without_members_counts_zero(spark):
    definitions = spark.createDataFrame([(1, "a", "active"), (2, "b", "active"), (3, "c", "draft")], "cohort_sk long, name string, status string")
    for column in ("cohort_type", "cohort_category", "primary_concept_display", "version", "created_by", "created_at"):
        definitions = definitions.withColumn(column, F.lit(1))
    listed = review.cohort_list(definitions, spark.createDataFrame([(1, 7), (1, 8)], "cohort_sk long, patient_sk long"))
    assert {r.cohort_sk: r.member_count for r in listed.collect()} == {1: 2, 2: 0}


def test_own_lexicons(spark):
    schema = assertion.LEXICON_SCHEMA
    df = spark.createDataFrame([(1, "No ÉPILEPSIE today. Bêta-bloquant, (HTA)."), (2, None), (3, "")], "note_sk long, note_text string")
    lexicon = spark.createDataFrame([
        ("épilepsie", "problem", "G40", "x", "a"), ("bêta-bloquant", "medication", "B", "x", "b"), ("HTA", "problem", "I10", "x", "c"),
        ("hta", "problem", "I10.0", "x", "d"), (None, "problem", "?", "x", "e"), ("  ", "problem", "?", "x", "f"),
    ], schema)
    got = rows(notes.extract_mentions(df, lexicon).select("covered_text", "span_start", "concept_code", "certainty"))
    assert got == [("Bêta-bloquant", 20, "B", "positive"), ("HTA", 36, "I10", "positive"), ("HTA", 36, "I10.0", "positive"), ("ÉPILEPSIE", 3, "G40", "negated")]
    assert notes.extract_mentions(df, lexicon.limit(0)).count() == 0


def test_long_notes_take_time_in_proportion(spark):
    """A note of half a megabyte, also without any sentence end, with thousands of mentions."""
    import time

    line = "Patient has type 2 diabetes, takes metformin. Nothing else was noted that day. No fever but cough persists.\n"
    note = line * 5000
    df = spark.createDataFrame([(1, note), (2, note.replace(".", "").replace("\n", " "))], "note_sk long, note_text string")
    start = time.time()
    found = notes.extract_mentions(df).groupBy("note_sk", "covered_text").count().collect()
    assert time.time() - start < 60
    assert {(r.note_sk, r.covered_text): r["count"] for r in found} == {
        (n, term): 5000 for n in (1, 2) for term in ("type 2 diabetes", "metformin", "fever", "cough")
    }
    spans = notes.extract_mentions(df.filter("note_sk = 1")).filter("covered_text = 'fever'").select(F.max("span_start")).first()[0]
    assert spans == note.rindex("fever")


# --- the whole sentence counts, for every lexicon and every way an expression is written ----------------------------


def found_in(spark, text, lexicon=None):
    frame = None if lexicon is None else spark.createDataFrame([(t, "x", t, "own", t) for t in lexicon], assertion.LEXICON_SCHEMA)
    rows = spark.createDataFrame([(1, text)], "note_sk long, note_text string")
    return sorted(map(tuple, notes.extract_mentions(rows, frame).collect()), key=str)


def test_a_cue_acts_over_a_whole_sentence_however_long(spark):
    for items in (1, 80):
        text = "Patient denies " + ", ".join(f"complaint number {i}" for i in range(items)) + ", chest pain and fever."
        found = found_in(spark, text)
        assert len(found) == 2 and all(row[8] for row in found)
    after = "Pneumonia " + "as it was thought of at the time of the first visit to the ward by the doctor " * 2 + "was negative"
    assert found_in(spark, after)[0][8]


def test_terms_with_edges_that_are_no_letters(spark):
    text = "On vitamin b12 (cyanocobalamin), hba1c % high, (hiv) and coughs, cough."
    found = found_in(spark, text, ["vitamin b12 (cyanocobalamin)", "hba1c %", "(hiv)", "cough", "%%"])
    assert [(row[2], text[row[3]:row[4]]) for row in found] == [(row[2], row[2]) for row in found]
    assert sorted(row[2] for row in found) == ["(hiv)", "cough", "hba1c %", "vitamin b12 (cyanocobalamin)"]


def test_line_ends_within_sentences(spark):
    text = "Patient denies fatigue, dyspnea, polyuria,\nfever, cough or chest\n  pain and heart\r\nfailure\n- Cough since May\nPlan: insulin"
    found = {row[2]: (row[8], text[row[3]:row[4]] == row[2]) for row in found_in(spark, text)}
    assert {k for k, v in found.items() if v == (True, True)} == {"fatigue", "dyspnea", "polyuria", "fever", "cough", "chest\n  pain", "heart\r\nfailure"}
    assert found["Cough"] == found["insulin"] == (False, True)


def test_marks_in_texts_shift_nothing(spark):
    text = "\u0001a\u0002\u0001 fever.\u0001 \u0002no cough 😀 and \u0002stroke"
    assert sorted((row[2], text[row[3]:row[4]]) for row in found_in(spark, text)) == [(t, t) for t in ("cough", "fever", "stroke")]


def test_one_folding_and_one_word_edge(spark):
    text = "Known \u212aidney pain, FEVER, fever\u0301, \u0130 fever2 fever_ _fever fever"
    assert sorted((row[2], row[3]) for row in found_in(spark, text, ["kidney pain", "fever"])) == [
        ("FEVER", text.index("FEVER")), ("fever", len(text) - 5), ("\u212aidney pain", 6)]


@pytest.mark.parametrize("more", [0, 5_000, 600_000])
def test_lexicons_of_every_length_find_the_same(spark, more):
    text = "No acute kidney pain today but acute grade 7 fever, acute grade 7 grade."
    terms = ["kidney pain", "acute", "fever", "acute grade 7 fever"]
    frame = spark.createDataFrame([(t, "x", t, "own", t) for t in terms], assertion.LEXICON_SCHEMA).unionByName(
        spark.range(more).selectExpr("concat('acute grade ', id + 1000) AS term", "'x' AS entity_type", "'y' AS concept_code", "'own' AS concept_system", "'z' AS concept_display"))
    rows = spark.createDataFrame([(1, text)], "note_sk long, note_text string")
    got = sorted((r.span_start, r.covered_text, r.negation) for r in notes.extract_mentions(rows, frame).collect())
    assert got == [(3, "acute", True), (9, "kidney pain", True), (31, "acute grade 7 fever", False), (52, "acute", False)]


def test_many_mentions_in_a_sentence_cost_in_proportion():
    import time

    from cohortloom.functions import mentions

    lexicon = mentions.Lexicon(["fever", "cough"])

    def seconds(n):
        start = time.process_time()
        assert len(list(mentions.mentions("Denies " + "fever, no cough but has " * n, lexicon))) == 2 * n
        return time.process_time() - start

    seconds(500)
    few, many = min(seconds(2_000) for _ in range(3)), min(seconds(20_000) for _ in range(2))
    assert many < 25 * few


def test_negations_written_twice_change_nothing(spark, sf_dir):
    from cohortloom.plans.cohorts import CLINICAL
    tables = load(spark, sf_dir, *CLINICAL)
    wanted = criteria.Criterion("dm", "condition", F.col("condition_code").startswith("E11"))
    other = criteria.Criterion("ht", "condition", F.col("condition_code") == "I10")
    dm, ht = criteria.Has("dm"), criteria.Has("ht")

    def members(expression):
        spec = criteria.CohortSpec([wanted, other], expression, F.lit(True))
        return sorted(map(tuple, cohort.qualified_members(tables, spec).collect()))

    plain = members(dm)
    assert plain and plain == members(~~dm) and any(row[1] for row in plain)
    assert members(~(~dm & ~ht)) == members(dm | ht) and members(~(~dm | ~ht)) == members(dm & ht)


def test_a_patient_row_that_repeats_is_one_member(spark, sf_dir):
    from cohortloom.plans.cohorts import CLINICAL
    tables = load(spark, sf_dir, *CLINICAL)
    spec = criteria.CohortSpec([criteria.Criterion("dm", "condition", F.col("condition_code").startswith("E11"))], criteria.Has("dm"), F.lit(True))
    once = cohort.build_cohort(tables, spec).count()
    assert once == cohort.build_cohort({**tables, "patient": tables["patient"].unionByName(tables["patient"])}, spec).count() > 0
