"""Term and cue lists for mentions in clinical text, and the context rules that read the cues.

The rules follow the published NegEx and ConText method: cue words in the scope of a mention decide
whether it is negated, uncertain or hypothetical, past, or about somebody else.
"""

from __future__ import annotations

import re

# Term, entity type, code, code system, concept name.
LEXICON = [
    ("type 2 diabetes mellitus", "problem", "E11.9", "ICD-10-CM", "Type 2 diabetes mellitus"),
    ("type 2 diabetes", "problem", "E11.9", "ICD-10-CM", "Type 2 diabetes mellitus"),
    ("type 1 diabetes", "problem", "E10.9", "ICD-10-CM", "Type 1 diabetes mellitus"),
    ("diabetes mellitus", "problem", "E11.9", "ICD-10-CM", "Diabetes mellitus"),
    ("diabetes", "problem", "E11.9", "ICD-10-CM", "Diabetes mellitus"),
    ("prediabetes", "problem", "R73.09", "ICD-10-CM", "Prediabetes"),
    ("essential hypertension", "problem", "I10", "ICD-10-CM", "Essential hypertension"),
    ("hypertension", "problem", "I10", "ICD-10-CM", "Essential hypertension"),
    ("coronary artery disease", "problem", "I25.10", "ICD-10-CM", "Coronary artery disease"),
    ("heart failure", "problem", "I50.9", "ICD-10-CM", "Heart failure"),
    ("myocardial infarction", "problem", "I21.9", "ICD-10-CM", "Myocardial infarction"),
    ("heart attack", "problem", "I21.9", "ICD-10-CM", "Myocardial infarction"),
    ("pulmonary embolism", "problem", "I26.99", "ICD-10-CM", "Pulmonary embolism"),
    ("stroke", "problem", "I63.9", "ICD-10-CM", "Cerebral infarction"),
    ("hyperlipidemia", "problem", "E78.5", "ICD-10-CM", "Hyperlipidemia"),
    ("pneumonia", "problem", "J18.9", "ICD-10-CM", "Pneumonia"),
    ("pancreatitis", "problem", "K85.9", "ICD-10-CM", "Acute pancreatitis"),
    ("peptic ulcer", "problem", "K27.9", "ICD-10-CM", "Peptic ulcer"),
    ("foot ulcer", "problem", "L97.509", "ICD-10-CM", "Foot ulcer"),
    ("diabetic retinopathy", "problem", "E11.319", "ICD-10-CM", "Diabetic retinopathy"),
    ("peripheral neuropathy", "problem", "G62.9", "ICD-10-CM", "Peripheral neuropathy"),
    ("severe hypoglycemia", "problem", "E16.2", "ICD-10-CM", "Hypoglycemia"),
    ("hypoglycemia", "problem", "E16.2", "ICD-10-CM", "Hypoglycemia"),
    ("metformin", "medication", "860975", "RxNorm", "Metformin"),
    ("sitagliptin", "medication", "665035", "RxNorm", "Sitagliptin"),
    ("insulin glargine", "medication", "285129", "RxNorm", "Insulin glargine"),
    ("insulin", "medication", "5856", "RxNorm", "Insulin"),
    ("lisinopril", "medication", "314076", "RxNorm", "Lisinopril"),
    ("atorvastatin", "medication", "617312", "RxNorm", "Atorvastatin"),
    ("aspirin", "medication", "212033", "RxNorm", "Aspirin"),
    ("hba1c", "lab", "4548-4", "LOINC", "Hemoglobin A1c"),
    ("glucose", "lab", "2345-7", "LOINC", "Glucose"),
    ("creatinine", "lab", "2160-0", "LOINC", "Creatinine"),
    ("chest pain", "finding", "29857009", "SNOMED-CT", "Chest pain"),
    ("dyspnea", "finding", "267036007", "SNOMED-CT", "Dyspnea"),
    ("dry cough", "finding", "11833005", "SNOMED-CT", "Dry cough"),
    ("cough", "finding", "49727002", "SNOMED-CT", "Cough"),
    ("fever", "finding", "386661006", "SNOMED-CT", "Fever"),
    ("fatigue", "finding", "84229001", "SNOMED-CT", "Fatigue"),
    ("polyuria", "finding", "28442001", "SNOMED-CT", "Polyuria"),
    ("polydipsia", "finding", "17173007", "SNOMED-CT", "Polydipsia"),
    ("polyphagia", "finding", "72405004", "SNOMED-CT", "Polyphagia"),
    ("nocturia", "finding", "139394000", "SNOMED-CT", "Nocturia"),
    ("echocardiogram", "procedure", "93306", "CPT", "Echocardiography"),
    ("electrocardiogram", "procedure", "93000", "CPT", "Electrocardiogram"),
    ("left ventricle", "anatomy", "87878005", "SNOMED-CT", "Left ventricle"),
]
LEXICON_SCHEMA = "term string, entity_type string, concept_code string, concept_system string, concept_display string"

# A line that opens with a heading in capitals starts a section, and so does a blank line, but for blank
# lines right below a heading.
SECTION_START = re.compile(r"^[A-Z][A-Z /&()]{3,}(?::?[ \t\r]*\n\s*)?|^[ \t\r]*\n", re.M)
HEADING = re.compile(r"[A-Z][A-Z /&()]{3,}")
# A sentence ends with its mark and the blank after it, or with a line if the next one is an item of a list or opens with a label. Other line ends are blanks.
SENTENCE_END = re.compile(r"[.!?;][ \t\r\n]|\n(?=[ \t]*(?:[-*\u2022\u2013]|\d+[.)]|[A-Z][A-Za-z /&()]{0,40}:))")


def _any(*phrases: str) -> tuple[re.Pattern, frozenset[str]]:
    """Any of the phrases as whole words, longer ones first (a blank stands for any white space); and the words they begin with."""
    ordered = sorted(phrases, key=len, reverse=True)
    pattern = re.compile(r"(?i)\b(?:" + "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in ordered) + r")\b")
    return pattern, frozenset(re.match(r"\w+", p).group() for p in phrases)


# Cue words. A cue acts within its clause, however long that is. A clause word ends the scope of any cue before it. Cues behind a mention must
# come before the next comma or full stop.
_CUES = {
    "clause": _any("but", "however", "although", "though", "except", "apart from", "aside from"),
    # Verbs that assert something end the scope of an earlier negation only.
    "asserting": _any("has", "have", "had", "reports", "presents", "complains", "takes", "continues"),
    # Phrases that look like a negation and are none; "rule out" is a question, not a finding.
    "not_a_negation": _any("no change", "no increase", "no further", "no dose adjustment", "not only", "not certain", "no doubt"),
    "negated_before": _any(
        "no", "not", "denies", "denied", "denying", "without", "negative for", "ruled out", "absence of", "free of", "never", "neither", "nor", "contraindicated"),
    "negated_after": _any(
        "ruled out", "not initiated", "not restarted", "not started", "not present", "not seen", "is absent", "was negative", "were negative", "is contraindicated",
        "contraindicated"),
    "uncertain_before": _any(
        "rule out", "r/o", "possible", "possibly", "probable", "suspected", "suspicion of", "suspicious for", "cannot exclude", "may represent", "may be", "may have",
        "concern for", "differential includes", "questionable"),
    "uncertain_after": _any("suspected", "cannot be excluded", "is possible", "not excluded", "rule-out"),
    # "Signs of" is hypothetical in advice ("warning signs of") and a finding in "no signs of": negation wins anyway.
    "hypothetical_before": _any(
        "if", "should", "will consider", "would consider", "consider", "in case of", "risk of", "risk for", "progression to", "warning signs of", "signs of",
        "to screen for", "to prevent", "defined as"),
    "hypothetical_after": _any("develops", "develop", "defined as"),
    # A history that still runs isn't the past.
    "still_current": (re.compile(r"(?i)\b(?:\d+[-\s]year\s+history\s+of|(?:known|long)\s+history\s+of|history\s+of\s+present\s+illness)"), frozenset(["history"])),
    "historical_before": _any("history of", "remote history", "past", "prior", "previous", "previously", "former", "formerly", "years ago", "status post"),
    "historical_after": _any("in the past", "years ago", "years prior", "resolved", "fully healed"),
    "family": _any(
        "family history", "family", "mother", "father", "brother", "sister", "sibling", "aunt", "uncle", "maternal", "paternal", "grandmother", "grandfather", "cousin",
        "parents"),
    "family_after": (re.compile(r"(?i)\bin\s+(?:his|her|their)\s+(?:mother|father|brother|sister|aunt|uncle|family)\b"), frozenset(["in"])),
    "other_person": _any("spouse", "husband", "wife", "partner", "roommate", "friend", "donor"),
    "stop": (re.compile(r"[.,]"), None),
    "dot": (re.compile(r"\."), None),
}
CUES = {name: pattern for name, (pattern, _) in _CUES.items()}
# Words of which a sentence must hold one for a kind of cue to be looked for.
CUE_WORDS = {name: words for name, (_, words) in _CUES.items() if words is not None}
# Cues that don't count inside a match of another kind.
VOID_INSIDE = {"negated_before": "not_a_negation", "historical_before": "still_current"}
FAMILY_SECTION = "FAMILY"
NEGATIVE_SECTION = "NEGATIVE"
