"""The stored criteria record, the predicates it stands for, and boolean expressions over them."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import clinical

# Longer code lists are joined as a table instead of being put into the predicate text, and lists of
# up to BROADCAST_CODES entries (a few MB) are broadcast for that.
INLINE_CODES = 1000
BROADCAST_CODES = 100_000


@dataclass
class CriteriaRecord:
    """The 20 fields a cohort definition stores as JSON; code and term lists are comma text as typed."""

    icd_codes: str = ""
    icd_status: list[str] = field(default_factory=list)
    med_codes: str = ""
    med_status: list[str] = field(default_factory=list)
    lab_code: str = ""
    lab_min: float | None = None
    lab_max: float | None = None
    nlp_terms: str = ""
    nlp_concept: str = ""
    nlp_certainty: list[str] = field(default_factory=list)
    nlp_temporality: list[str] = field(default_factory=list)
    nlp_entity_types: list[str] = field(default_factory=list)
    nlp_patient_only: bool = False
    exc_icd: str = ""
    exc_meds: str = ""
    date_from: str = "1900-01-01"
    date_to: str = "2100-12-31"
    min_age: int = 0
    max_age: int = 120
    sex_filter: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> CriteriaRecord:
        stored = json.loads(text)
        return cls(**{f.name: stored[f.name] for f in fields(cls) if f.name in stored})

    @property
    def uses_codes(self) -> bool:
        return bool(self.icd_codes.strip() or self.med_codes.strip() or self.lab_code.strip())

    @property
    def uses_notes(self) -> bool:
        return bool(self.nlp_terms.strip() or self.nlp_concept.strip())


_TEXT = ("icd_codes", "med_codes", "lab_code", "nlp_terms", "nlp_concept", "exc_icd", "exc_meds", "date_from", "date_to")
_LISTS = ("icd_status", "med_status", "nlp_certainty", "nlp_temporality", "nlp_entity_types", "sex_filter")


def _field_type(name: str) -> T.DataType:
    if name in _TEXT:
        return T.StringType()
    if name in _LISTS:
        return T.ArrayType(T.StringType())
    if name in ("lab_min", "lab_max"):
        return T.DoubleType()
    return T.BooleanType() if name == "nlp_patient_only" else T.IntegerType()


# The same record as a column type, for reading many stored definitions at once.
RECORD_TYPE = T.StructType([T.StructField(f.name, _field_type(f.name)) for f in fields(CriteriaRecord)])


def parse_definition_logic(definition_logic: Column) -> Column:
    return F.from_json(definition_logic, RECORD_TYPE)


def split_codes(text: str, upper: bool = False) -> list[str]:
    """Comma list: trimmed, blanks dropped; diagnosis codes are upper-cased, drug codes are not."""
    items = [item.strip() for item in text.split(",")]
    return [item.upper() if upper else item for item in items if item]


# --- predicates over one clinical table -------------------------------------------------------------


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


@dataclass(frozen=True)
class CodeList:
    """A list too long for a predicate: rows get the column `flag` by a join with it (see with_code_flags)."""

    column: str
    codes: tuple[str, ...]

    @property
    def flag(self) -> str:
        digest = hashlib.sha256("\n".join((self.column, *sorted(self.codes))).encode()).hexdigest()
        return f"_in_{digest[:16]}"


def long_list(column: str, codes: list[str]) -> CodeList | None:
    return CodeList(column, tuple(dict.fromkeys(codes))) if len(codes) > INLINE_CODES else None


def has_code(column: str, codes: list[str]) -> Column:
    """Whether a row has one of the codes: a predicate when the list is short, the flag of the list when it is long."""
    listed = long_list(column, codes)
    return F.col(column).isin(codes) if listed is None else F.coalesce(F.col(listed.flag), F.lit(False))


def with_code_flags(df: DataFrame, lists: list[CodeList | None]) -> DataFrame:
    """df with a column for each long list, true in rows that have one of its codes. Codes are distinct, so no row repeats."""
    for listed in {x.flag: x for x in lists if x is not None}.values():
        wanted = df.sparkSession.createDataFrame([(code, True) for code in listed.codes], f"_code string, {listed.flag} boolean")
        if len(listed.codes) <= BROADCAST_CODES:
            wanted = F.broadcast(wanted)
        df = df.join(wanted, F.col(listed.column) == F.col("_code"), "left").drop("_code")
    return df


def condition_matches(codes: list[str], status: list[str], date_from, date_to) -> Column:
    return all_of([
        has_code("condition_code", codes),
        F.col("clinical_status").isin(status or ["active"]),
        F.col("recorded_date").between(clinical.as_date(date_from), clinical.as_date(date_to)),
    ])


def medication_matches(codes: list[str], status: list[str], date_from, date_to, strict_upper: bool = False) -> Column:
    return all_of([
        has_code("med_code", codes),
        F.col("order_status").isin(status or ["active"]),
        clinical.within_days(
            F.col("start_datetime"), clinical.as_date(date_from), clinical.as_date(date_to), strict_upper
        ),
    ])


def lab_matches(code: str, low: float | None, high: float | None, date_from, date_to, strict_upper: bool = False) -> Column:
    """A threshold on either side is optional; a missing value never meets a threshold."""
    parts = [F.col("observation_code") == code.strip()]
    if low is not None:
        parts.append(F.col("value_numeric") >= float(low))
    if high is not None:
        parts.append(F.col("value_numeric") <= float(high))
    parts.append(
        clinical.within_days(
            F.col("effective_datetime"), clinical.as_date(date_from), clinical.as_date(date_to), strict_upper
        )
    )
    return all_of(parts)


def term_matches(term: str) -> Column:
    """Case-insensitive substring of the mention or of its concept name; % and _ are plain characters."""
    needle = F.lit(term.lower())
    return any_of([
        F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False)) for name in ("covered_text", "concept_display")
    ])


def trusted_mention(
    certainty: list[str] | None = None,
    temporality: list[str] | None = None,
    entity_types: list[str] | None = None,
    patient_only: bool = False,
) -> Column:
    """Not negated, with an accepted certainty and temporality; by default positive and current."""
    parts = [
        ~F.col("negation"),
        F.col("certainty").isin(certainty or ["positive"]),
        F.col("temporality").isin(temporality or ["current"]),
    ]
    if entity_types:
        parts.append(F.col("entity_type").isin(entity_types))
    if patient_only:
        parts.append(F.col("subject") == "patient")
    return all_of(parts)


def mention_matches(terms: list[str], concept_code: str, **trust) -> Column:
    wanted = [term_matches(term) for term in terms]
    if concept_code.strip():
        wanted.append(F.coalesce(F.col("concept_code") == concept_code.strip(), F.lit(False)))
    return any_of(wanted) & trusted_mention(**trust)


def patient_matches(min_age: float, max_age: float, sexes: list[str], as_of: Column) -> Column:
    """Fractional age within bounds and, when sexes are named, one of them. No birth date: no match."""
    age = clinical.age_years(F.col("birth_date"), as_of)
    parts = [age.between(min_age, max_age)]
    if sexes:
        parts.append(F.col("sex").isin(sexes))
    return all_of(parts)


def rows_with_codes(df: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """Code filter for lists of any length: a predicate when short, a semi-join when long."""
    if len(codes) <= INLINE_CODES:
        return df.filter(F.col(column).isin(codes))
    wanted = df.sparkSession.createDataFrame([(code,) for code in dict.fromkeys(codes)], f"{column} string")
    if len(codes) <= BROADCAST_CODES:
        wanted = F.broadcast(wanted)
    return df.join(wanted, column, "left_semi")


# --- criteria and boolean expressions over them --------------------------------------------------------


@dataclass(frozen=True)
class Criterion:
    """Rows of one clinical table that count as evidence for something."""

    id: str
    table: str
    matches: Column
    source: str = "coded"
    codes: CodeList | None = None


class Expression:
    """Boolean expression over criteria, evaluated on the per-patient criterion state."""

    def met(self) -> Column:
        raise NotImplementedError

    def first_met(self) -> Column | None:
        """Date on which the expression first held; null where it does not, None where it has no date."""
        raise NotImplementedError

    def met_without_evidence(self) -> bool:
        raise NotImplementedError

    def required(self) -> list[str]:
        """Criteria that speak for membership (those under a Not do not)."""
        raise NotImplementedError

    def normal(self, negated: bool = False) -> Expression:
        """The same expression, or its negation, with every Not moved down to a single criterion."""
        raise NotImplementedError

    def __and__(self, other: Expression) -> Expression:
        return AllOf(self, other)

    def __or__(self, other: Expression) -> Expression:
        return AnyOf(self, other)

    def __invert__(self) -> Expression:
        return Not(self)


class Has(Expression):
    def __init__(self, criterion_id: str):
        self.id = criterion_id

    def met(self):
        return F.coalesce(F.col(f"n_{self.id}") > 0, F.lit(False))

    def first_met(self):
        return F.col(f"first_{self.id}")

    def met_without_evidence(self):
        return False

    def required(self):
        return [self.id]

    def normal(self, negated=False):
        return Not(self) if negated else self


class Not(Expression):
    def __init__(self, inner: Expression):
        self.inner = inner

    def met(self):
        return ~self.inner.met()

    def first_met(self):
        return None

    def met_without_evidence(self):
        return not self.inner.met_without_evidence()

    def required(self):
        return []

    def normal(self, negated=False):
        return self.inner.normal(not negated)


class _Group(Expression):
    def __init__(self, *parts: Expression):
        self.parts = parts

    def required(self):
        return [criterion for part in self.parts for criterion in part.required()]

    def normal(self, negated=False):
        group = ({AllOf: AnyOf, AnyOf: AllOf} if negated else {AllOf: AllOf, AnyOf: AnyOf})[type(self)]
        return group(*[part.normal(negated) for part in self.parts])

    def _dates(self) -> list[Column]:
        return [date for date in (part.first_met() for part in self.parts) if date is not None]


class AllOf(_Group):
    def met(self):
        return all_of([part.met() for part in self.parts])

    def first_met(self):
        """All parts hold from the latest of their first dates on."""
        dates = self._dates()
        if not dates:
            return None
        return F.when(self.met(), F.greatest(*dates) if len(dates) > 1 else dates[0])

    def met_without_evidence(self):
        return all(part.met_without_evidence() for part in self.parts)


class AnyOf(_Group):
    def met(self):
        return any_of([part.met() for part in self.parts])

    def first_met(self):
        """Any part holds from the earliest of their first dates on; parts that do not hold have no date."""
        dates = self._dates()
        if not dates:
            return None
        return F.least(*dates) if len(dates) > 1 else dates[0]

    def met_without_evidence(self):
        return any(part.met_without_evidence() for part in self.parts)


@dataclass(frozen=True)
class CohortSpec:
    """A cohort: criteria, the expression over them, and a filter on the patient row.

    The expression is kept with its negations at the criteria, so that dates, sources and evidence don't depend on how it was written.
    """

    criteria: list[Criterion]
    expression: Expression
    patient_filter: Column

    def __post_init__(self):
        object.__setattr__(self, "expression", self.expression.normal())


def cohort_spec(
    record: CriteriaRecord, as_of: str | dt.date | Column | None = None, strict_upper: bool = False
) -> CohortSpec:
    """All criteria of a record AND-joined; exclusions look at the whole history whatever the status."""
    as_of = F.current_date() if as_of is None else clinical.as_date(as_of)
    window = (record.date_from, record.date_to)
    criteria: list[Criterion] = []
    parts: list[Expression] = []

    def include(criterion: Criterion) -> None:
        criteria.append(criterion)
        parts.append(Has(criterion.id))

    def exclude(criterion: Criterion) -> None:
        criteria.append(criterion)
        parts.append(Not(Has(criterion.id)))

    if codes := split_codes(record.icd_codes, upper=True):
        include(Criterion("icd", "condition", condition_matches(codes, record.icd_status, *window), codes=long_list("condition_code", codes)))
    if codes := split_codes(record.med_codes):
        matches = medication_matches(codes, record.med_status, *window, strict_upper)
        include(Criterion("med", "medication_order", matches, codes=long_list("med_code", codes)))
    if record.lab_code.strip():
        include(Criterion("lab", "observation", lab_matches(record.lab_code, record.lab_min, record.lab_max, *window, strict_upper)))
    if record.uses_notes:
        include(Criterion(
            "nlp", "note_nlp_entity",
            mention_matches(
                split_codes(record.nlp_terms), record.nlp_concept, certainty=record.nlp_certainty,
                temporality=record.nlp_temporality, entity_types=record.nlp_entity_types,
                patient_only=record.nlp_patient_only,
            ),
            "nlp",
        ))
    if codes := split_codes(record.exc_icd, upper=True):
        exclude(Criterion("exc_icd", "condition", has_code("condition_code", codes), codes=long_list("condition_code", codes)))
    if codes := split_codes(record.exc_meds):
        exclude(Criterion("exc_med", "medication_order", has_code("med_code", codes), codes=long_list("med_code", codes)))

    demographics = patient_matches(record.min_age, record.max_age, record.sex_filter, as_of)
    return CohortSpec(criteria, AllOf(*parts), demographics)


def primary_concept(
    icd_codes: Column, med_codes: Column, lab_code: Column, nlp_concept: Column, nlp_terms: Column
) -> tuple[Column, Column]:
    """Code and code system that name the cohort: the first diagnosis, else drug, lab, concept or term."""

    def first(text: Column) -> Column:
        return F.trim(F.split(text, ",")[0])

    def given(text: Column) -> Column:
        return F.trim(F.coalesce(text, F.lit(""))) != ""

    code = (
        F.when(given(icd_codes), first(icd_codes)).when(given(med_codes), first(med_codes))
        .when(given(lab_code), F.trim(lab_code)).when(given(nlp_concept), F.trim(nlp_concept))
        .otherwise(F.coalesce(first(nlp_terms), F.lit("")))
    )
    system = (
        F.when(given(icd_codes), "ICD-10-CM").when(given(med_codes), "RxNorm").when(given(lab_code), "LOINC")
        .when(given(nlp_concept), "SNOMED").otherwise("NLP-term")
    )
    return code, system
