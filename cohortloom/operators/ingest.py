"""Conforming source records: crosswalks, lookups, identity, exposure, billed unions, interchange resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.text import html_to_text


def diagnoses_by_crosswalk(diagnoses: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Internal diagnosis ids to ICD codes, one row per encounter and code.

    Ids and codes are many-to-many, so the crosswalk and the result are both de-duplicated.
    """
    pairs = diagnoses.select("encounter_sk", "dx_id").distinct()
    return pairs.join(crosswalk.select("dx_id", "icd10").distinct(), "dx_id").select("encounter_sk", "icd10").distinct()


def resolve_category(df: DataFrame, column: str, lookup: DataFrame, name: str) -> DataFrame:
    """Replace a numeric category code by its name from a lookup table (code, name)."""
    names = lookup.select(F.col("code").alias("_code"), F.col("name").alias(name))
    return df.join(names, df[column] == names["_code"], "left").drop("_code")


def link_identities(identifiers: DataFrame) -> DataFrame:
    """One patient key per source patient: the lowest source key it shares an identifier with.

    Linkage is single-hop; a patient without any usable identifier is linked to itself. The lowest key
    per identifier is found by an aggregation, so a placeholder identifier on very many rows is never
    paired with itself.
    """
    identifier = ["identifier_type", "assigning_authority", "identifier_value"]
    usable = identifiers.dropna(subset=identifier)
    lowest = usable.groupBy(*identifier).agg(F.min("source_key").alias("_lowest"))
    shared = usable.join(lowest, identifier).select("source_key", "_lowest")
    own = identifiers.select("source_key", F.col("source_key").alias("_lowest"))
    return shared.unionByName(own).groupBy("source_key").agg(F.min("_lowest").alias("patient_sk"))


def drugs_given(orders: DataFrame, administrations: DataFrame) -> DataFrame:
    """Orders with at least one administration that was given: first and last time, number of doses."""
    given = (
        administrations.filter(F.col("admin_action") == "given").groupBy("med_order_sk")
        .agg(F.count("*").alias("n_given"), F.min("admin_datetime").alias("first_given"), F.max("admin_datetime").alias("last_given"))
    )
    return orders.join(given, "med_order_sk")


def reports_with_narrative(reports: DataFrame, notes: DataFrame) -> DataFrame:
    """Diagnostic reports with the text of the note that holds their narrative, if any.

    Only texts that a report names are moved, and reports without a narrative aren't joined.
    """
    named = reports.filter(F.col("narrative_note_sk").isNotNull())
    texts = notes.select(F.col("note_sk").alias("narrative_note_sk"), F.col("note_text").alias("narrative"))
    texts = texts.join(named.select("narrative_note_sk").distinct(), "narrative_note_sk", "left_semi")
    others = reports.filter(F.col("narrative_note_sk").isNull()).withColumn("narrative", F.lit(None).cast("string"))
    return named.join(texts, "narrative_note_sk", "left").unionByName(others)


def lookup_concepts(rows: DataFrame, code_column: str, system: str, concepts: DataFrame) -> DataFrame:
    """Terminology lookup: display and crosswalk code of a coded row; unknown codes keep their row."""
    known = concepts.filter(F.col("code_system") == system).select(
        F.col("code").alias("_code"), F.col("display").alias("concept_display"), "maps_to"
    )
    return rows.join(known, rows[code_column] == known["_code"], "left").drop("_code")


def newest_concepts(rows: DataFrame) -> DataFrame:
    """Concepts as rows of the terminology table, one per system and code; of several that differ the last in the order of their columns."""
    named = rows.dropna(subset=["code_system", "code"]).groupBy("code_system", "code").agg(F.max(F.struct("display", "concept_class", "maps_to")).alias("c"))
    return named.select(F.xxhash64("code_system", "code").alias("concept_sk"), "code_system", "code", "c.*")


def clinical_and_billed(clinical: DataFrame, billed: DataFrame, key: list[str]) -> DataFrame:
    """Union of clinical and billed facts, one row per key, with a flag for what was billed."""
    both = clinical.select(*key).withColumn("is_billed", F.lit(False)).unionByName(
        billed.select(*key).withColumn("is_billed", F.lit(True))
    )
    return both.groupBy(*key).agg(F.bool_or("is_billed").alias("is_billed"))


def kept_visits(appointments: DataFrame) -> DataFrame:
    """Appointments that became visits: only those that were started or finished count as encounters."""
    return appointments.filter(F.col("status").isin("arrived", "in-progress", "finished"))


# --- interchange resources (FHIR R4) ------------------------------------------------------------------


def _entries(lines: DataFrame) -> DataFrame:
    """Lines as they are, but a Bundle's as one line for each of its resources."""
    bundle = F.when(F.contains("value", F.lit("Bundle")), F.from_json("value", "resourceType string, entry array<struct<resource string>>"))
    resources = F.transform(F.filter(bundle["entry"], lambda e: e["resource"].isNotNull()), lambda e: e["resource"])
    return lines.select(F.explode(F.when((bundle["resourceType"] == "Bundle") & bundle["entry"].isNotNull(), resources).otherwise(F.array("value"))).alias("value"))


def land_resources(lines: DataFrame, source_system: str, bundle_id: str, ingested_at: Column) -> DataFrame:
    """Raw landing of NDJSON lines, Bundles resource by resource: type, id, the source's own version time and a digest beside the untouched payload.

    A resource without an id is known by its digest. Lines that are no resource have no type (see `quarantined`).
    """
    digest = F.sha2("payload", 256)
    parsed = _entries(lines).select(F.json_tuple("value", "resourceType", "id", "meta").alias("resource_type", "resource_id", "_meta"), F.col("value").alias("payload"))
    return parsed.select(
        "resource_type", F.when(F.col("resource_type").isNotNull(), F.coalesce("resource_id", digest)).alias("resource_id"),
        F.lit(source_system).alias("source_system"), "payload", F.lit(bundle_id).alias("bundle_id"),
        F.get_json_object("_meta", "$.lastUpdated").try_cast("timestamp").alias("version_time"), digest.alias("digest"), ingested_at.alias("ingested_at"),
    )


def quarantined(landed: DataFrame) -> DataFrame:
    """Landed lines that are no resource, with the reason."""
    reason = F.when(F.trim("payload") == "", "empty line").when(F.try_parse_json("payload").isNull(), "not JSON").otherwise("no resource type")
    return landed.filter(F.col("resource_type").isNull()).select("payload", "digest", reason.alias("reason"), "source_system", "bundle_id", "ingested_at")


def newest_resources(raw: DataFrame, bundle_id: str | None = None) -> DataFrame:
    """Of every resource its newest version; with a bundle, only those whose newest version came with it.

    Newer is what the source says is (its version time), else what was landed later; a payload that is sent again with the same bundle isn't landed again,
    so an old bundle that is repeated undoes nothing. Only fixed-width columns are compared; payloads are read once, for those chosen.
    """
    keys = ["resource_type", "resource_id"]
    named = raw.filter(F.col("resource_type").isNotNull())
    age = F.struct(F.coalesce("version_time", "ingested_at").alias("t"), "ingested_at", "digest")
    versions = named.select(*keys, age.alias("age"))
    if bundle_id is not None:
        named = named.filter(F.col("bundle_id") == bundle_id)
        versions = versions.join(named.select(*keys).distinct(), keys, "left_semi")
    newest = versions.groupBy(*keys).agg(F.max("age").alias("age")).select(*keys, F.col("age.digest").alias("digest"), F.col("age.ingested_at").alias("ingested_at"))
    return named.join(newest, [*keys, "digest", "ingested_at"], "left_semi").dropDuplicates(keys)


def land_rows(rows: DataFrame, source_table: str, key: list[str], batch_id: str, ingested_at: Column) -> DataFrame:
    """Raw landing of extracted rows: source table and natural key beside the whole row as JSON."""
    return rows.select(
        F.lit(source_table).alias("source_table"),
        F.concat_ws("|", *[F.col(name).cast("string") for name in key]).alias("natural_key"),
        F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("payload"),
        F.lit(batch_id).alias("extract_batch_id"), ingested_at.alias("ingested_at"),
    )


def landed_rows(raw: DataFrame, source_table: str, schema: str) -> DataFrame:
    """Rows of one source table again, from their landed JSON."""
    parsed = raw.filter(F.col("source_table") == source_table).select(F.from_json("payload", schema).alias("row"))
    return parsed.select("row.*")


_CODING = "array<struct<system:string,code:string,display:string>>"
_CONCEPT = f"struct<coding:{_CODING},text:string>"
_REF = "struct<reference:string>"
_NAMED = "struct<reference:string,display:string>"
_IDENTIFIERS = "array<struct<system:string,value:string>>"
_QUANTITY = "struct<value:double,unit:string>"
_ATTACHMENT = "struct<contentType:string,data:string,url:string>"
_RANGE = "array<struct<low:struct<value:double>,high:struct<value:double>>>"

RESOURCE_SCHEMAS: dict[str, str] = {
    "Patient": f"id string, identifier array<struct<system:string,value:string,type:{_CONCEPT},assigner:struct<display:string>>>, birthDate date, gender string, "
    "deceasedBoolean boolean, deceasedDateTime timestamp, address array<struct<city:string,state:string,postalCode:string>>",
    "Encounter": f"id string, subject {_REF}, status string, class struct<code:string>, type array<{_CONCEPT}>, "
    f"period struct<start:timestamp,end:timestamp>, participant array<struct<type:array<{_CONCEPT}>,individual:{_NAMED}>>, "
    f"serviceProvider {_NAMED}, location array<struct<location:{_NAMED}>>, "
    f"hospitalization struct<admitSource:{_CONCEPT},dischargeDisposition:{_CONCEPT}>",
    "Practitioner": f"id string, identifier {_IDENTIFIERS}, name array<struct<text:string,family:string,given:array<string>>>, "
    f"qualification array<struct<code:{_CONCEPT}>>",
    "Organization": f"id string, identifier {_IDENTIFIERS}, name string, type array<{_CONCEPT}>",
    "Location": f"id string, name string, type array<{_CONCEPT}>, managingOrganization {_REF}",
    "Condition": f"id string, subject {_REF}, encounter {_REF}, category array<{_CONCEPT}>, code {_CONCEPT}, "
    f"clinicalStatus {_CONCEPT}, verificationStatus {_CONCEPT}, onsetDateTime date, recordedDate date, abatementDateTime timestamp",
    "Observation": f"id string, subject {_REF}, encounter {_REF}, category array<{_CONCEPT}>, code {_CONCEPT}, "
    f"valueQuantity {_QUANTITY}, valueString string, referenceRange {_RANGE}, effectiveDateTime timestamp, "
    f"component array<struct<code:{_CONCEPT},valueQuantity:{_QUANTITY}>>",
    "MedicationRequest": f"id string, subject {_REF}, encounter {_REF}, status string, "
    f"medicationCodeableConcept {_CONCEPT}, authoredOn timestamp, category array<{_CONCEPT}>, "
    f"dosageInstruction array<struct<text:string,timing:struct<code:{_CONCEPT}>,route:{_CONCEPT},doseAndRate:array<struct<doseQuantity:{_QUANTITY}>>>>, "
    "dispenseRequest struct<validityPeriod:struct<end:timestamp>>",
    "MedicationAdministration": f"id string, subject {_REF}, context {_REF}, request {_REF}, status string, effectiveDateTime timestamp, "
    f"effectivePeriod struct<start:timestamp>, dosage struct<dose:{_QUANTITY},route:{_CONCEPT},rateQuantity:{_QUANTITY}>",
    "DiagnosticReport": f"id string, subject {_REF}, encounter {_REF}, status string, category array<{_CONCEPT}>, code {_CONCEPT}, "
    f"effectiveDateTime timestamp, presentedForm array<{_ATTACHMENT}>",
    "Binary": "id string, contentType string, data string",
    "Procedure": f"id string, subject {_REF}, encounter {_REF}, status string, code {_CONCEPT}, "
    "performedDateTime timestamp",
    "DocumentReference": f"id string, subject {_REF}, type {_CONCEPT}, category array<{_CONCEPT}>, date timestamp, "
    f"content array<struct<attachment:{_ATTACHMENT}>>, context struct<encounter:array<{_REF}>>",
}

# Encounter class codes of the interchange standard.
ENCOUNTER_CLASSES = {
    "IMP": "inpatient", "AMB": "ambulatory", "EMER": "emergency", "VR": "telehealth", "OBSENC": "outpatient",
}


# Statuses of an administration, and service sections of a report, in the interchange standard.
ADMINISTRATION_ACTIONS = {"completed": "given", "in-progress": "given", "stopped": "given", "on-hold": "held", "not-done": "refused"}
REPORT_CATEGORIES = {"LAB": "LAB", "HM": "LAB", "CH": "LAB", "PAT": "PATHOLOGY", "SP": "PATHOLOGY", "RAD": "RADIOLOGY", "MB": "MICRO"}

# Where a loaded row comes from: the conforming functions carry these columns along when asked to.
PROVENANCE = ("source_system", "source_id", "source_table_or_resource", "ingested_at")


def _resources(raw: DataFrame, kind: str) -> DataFrame:
    """The fields of all resources of a type, with the id they were landed under and their provenance."""
    parsed = raw.filter(F.col("resource_type") == kind).select(
        F.from_json("payload", RESOURCE_SCHEMAS[kind]).alias("r"), "source_system", F.col("resource_id").alias("source_id"),
        F.col("resource_type").alias("source_table_or_resource"), "ingested_at")
    return parsed.select("r.*", *PROVENANCE).withColumn("id", F.col("source_id"))


def _own_key(kind: str) -> Column:
    return _key_of(kind, F.col("id"))


def _key_of(kind: str, identifier: Column) -> Column:
    """Key of a resource: its id where that is a number, else a hash of type and id."""
    return F.when(identifier.isNotNull(), F.coalesce(identifier.try_cast("long"), F.xxhash64(F.lit(kind), identifier)))


def _key(reference: str) -> Column:
    """Key of the resource a reference such as Patient/17 points to."""
    return _key_in(F.col(reference))


def _key_in(reference: Column) -> Column:
    parts = F.split(reference, "/")
    kind, identifier = F.element_at(parts, -2), F.element_at(parts, -1)
    return F.when(
        F.size(parts) >= 2, F.coalesce(identifier.try_cast("long"), F.xxhash64(kind, identifier))
    )


def _coding(concept: str) -> Column:
    return F.get(F.col(f"{concept}.coding"), F.lit(0))


def _first_category() -> Column:
    return F.get(F.get(F.col("category"), F.lit(0))["coding"], F.lit(0))["code"]


def conform_patients(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    r = _resources(raw, "Patient")
    first_address = F.get("address", F.lit(0))
    return r.select(
        _own_key("Patient").alias("patient_sk"),
        F.get(F.filter("identifier", lambda i: i["system"] == "mrn"), F.lit(0))["value"].alias("mrn"),
        F.col("birthDate").alias("birth_date"), F.col("gender").alias("sex"),
        F.coalesce("deceasedBoolean", F.col("deceasedDateTime").isNotNull()).alias("deceased_flag"),
        F.to_date("deceasedDateTime").alias("deceased_date"), first_address["city"].alias("city"),
        first_address["state"].alias("state"), first_address["postalCode"].alias("zip"), *keep,
    )


# Identifier types of the interchange standard, as the clinical tables name them.
IDENTIFIER_TYPES = {"MR": "MRN", "PI": "source_pat_id", "SS": "SSN-last4", "MB": "member_id"}


def conform_identifiers(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Identifiers of patients, one row each however often a patient names it; the issuer is the authority, else the number's system.

    Of social security numbers only the last four digits are kept. A patient without any (usable) identifier gives one row without a key:
    it isn't stored, but says that identifiers of an older version have gone.
    """
    types = F.create_map(*[F.lit(v) for pair in IDENTIFIER_TYPES.items() for v in pair])

    def known(i: Column) -> Column:
        code = F.get(i["type"]["coding"], F.lit(0))["code"]
        kind = F.coalesce(types[code], F.when(F.lower(i["system"]) == "mrn", "MRN"), i["type"]["text"], code, i["system"])
        value = F.nullif(F.trim(i["value"]), F.lit(""))
        value = F.when(kind == "SSN-last4", F.nullif(F.right(F.regexp_replace(value, "[^0-9]", ""), F.lit(4)), F.lit(""))).otherwise(value)
        return F.struct(kind.alias("kind"), value.alias("value"), F.coalesce(i["assigner"]["display"], i["system"]).alias("authority"))

    usable = F.array_distinct(F.filter(F.transform("identifier", known), lambda i: i["value"].isNotNull()))
    rows = _resources(raw, "Patient").select(_own_key("Patient").alias("patient_sk"), F.explode_outer(usable).alias("i"), *keep)
    return rows.select(
        F.when(F.col("i").isNotNull(), F.xxhash64("patient_sk", "i.kind", "i.authority", "i.value")).alias("identifier_sk"), "patient_sk",
        F.col("i.kind").alias("identifier_type"), F.col("i.value").alias("identifier_value"), F.col("i.authority").alias("assigning_authority"), *keep,
    )


def _number_of(system: str) -> Column:
    """The first identifier of a system, named whole or by the last part of its address."""
    return F.get(F.filter("identifier", lambda i: F.lower(F.element_at(F.split(i["system"], "[/:]"), -1)) == system), F.lit(0))["value"]


def conform_providers(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Practitioners: the name as written, else given names and family name; the first qualification is the specialty."""
    name = F.get("name", F.lit(0))
    parts = F.nullif(F.trim(F.concat_ws(" ", name["given"], name["family"])), F.lit(""))
    return _resources(raw, "Practitioner").select(
        _own_key("Practitioner").alias("provider_sk"), _number_of("us-npi").alias("npi"), F.coalesce(name["text"], parts).alias("full_name"),
        _shown(F.get("qualification", F.lit(0))["code"]).alias("specialty"), *keep,
    )


def conform_organizations(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _resources(raw, "Organization").select(
        _own_key("Organization").alias("organization_sk"), "name", _shown(F.get("type", F.lit(0))).alias("type"),
        _number_of("practiceid").alias("practice_id"), *keep,
    )


def conform_locations(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _resources(raw, "Location").select(
        _own_key("Location").alias("location_sk"), "name", _shown(F.get("type", F.lit(0))).alias("type"),
        _key("managingOrganization.reference").alias("organization_sk"), *keep,
    )


def conform_encounters(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encounters with who attended (the participant said to, else the first), where, and how they began and ended."""
    attends = lambda p: F.exists(p["type"], lambda t: F.exists(t["coding"], lambda c: c["code"] == "ATND"))
    attending = F.coalesce(F.get(F.filter("participant", attends), F.lit(0)), F.get("participant", F.lit(0)))["individual"]
    classes = F.create_map(*[F.lit(v) for pair in ENCOUNTER_CLASSES.items() for v in pair])
    return _resources(raw, "Encounter").select(
        _own_key("Encounter").alias("encounter_sk"), _key("subject.reference").alias("patient_sk"),
        classes[F.col("class.code")].alias("encounter_class"), F.get("type", F.lit(0))["text"].alias("encounter_type"),
        "status", F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"),
        _shown(F.col("hospitalization.admitSource")).alias("admit_source"), _shown(F.col("hospitalization.dischargeDisposition")).alias("discharge_disposition"),
        attending["display"].alias("attending_provider_name"), F.col("serviceProvider.display").alias("facility_name"),
        _key_in(attending["reference"]).alias("attending_provider_sk"), _key("serviceProvider.reference").alias("organization_sk"),
        _key_in(F.get("location", F.lit(0))["location"]["reference"]).alias("location_sk"), *keep,
    )


def conform_conditions(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _resources(raw, "Condition").select(
        _own_key("Condition").alias("condition_sk"), _key("subject.reference").alias("patient_sk"),
        _key("encounter.reference").alias("encounter_sk"), _first_category().alias("category"),
        _coding("code")["code"].alias("condition_code"), _coding("clinicalStatus")["code"].alias("clinical_status"),
        F.col("onsetDateTime").alias("onset_date"), F.col("recordedDate").alias("recorded_date"),
        F.to_date("abatementDateTime").alias("resolved_date"), _coding("code")["display"].alias("condition_display"),
        _coding("verificationStatus")["code"].alias("verification_status"), *keep,
    )


def conform_observations(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Observations; components of a panel become rows that point to it, with keys hashed from its key."""
    r = _resources(raw, "Observation").withColumn("_sk", _own_key("Observation"))
    common = [
        _key("subject.reference").alias("patient_sk"), _key("encounter.reference").alias("encounter_sk"), _first_category().alias("category"),
    ]
    first_range = F.get("referenceRange", F.lit(0))
    no_limit = F.lit(None).cast("double")
    own = F.struct(
        F.lit(0).alias("no"), _coding("code")["code"].alias("code"),
        _coding("code")["display"].alias("display"), F.col("valueQuantity.value").alias("value"), F.col("valueString").alias("string"),
        F.col("valueQuantity.unit").alias("unit"), first_range["low"]["value"].alias("low"), first_range["high"]["value"].alias("high"),
    )
    parts = F.transform(
        F.coalesce("component", F.array().cast(T.ArrayType(_component_type()))),
        lambda part, i: F.struct(
            (i + 1).alias("no"), F.get(part["code"]["coding"], F.lit(0))["code"].alias("code"),
            F.get(part["code"]["coding"], F.lit(0))["display"].alias("display"),
            part["valueQuantity"]["value"].alias("value"), F.lit(None).cast("string").alias("string"),
            part["valueQuantity"]["unit"].alias("unit"), no_limit.alias("low"), no_limit.alias("high"),
        ),
    )
    rows = r.select("_sk", *common, "effectiveDateTime", *keep, F.inline(F.concat(F.array(own), parts)))
    return rows.select(
        F.when(F.col("no") == 0, F.col("_sk")).otherwise(F.xxhash64("_sk", "no")).alias("observation_sk"), "patient_sk", "category",
        F.col("code").alias("observation_code"), F.col("value").alias("value_numeric"),
        F.col("string").alias("value_string"), F.col("effectiveDateTime").alias("effective_datetime"),
        F.when(F.col("no") > 0, F.col("_sk")).alias("parent_observation_sk"),
        "encounter_sk", F.col("display").alias("observation_display"), "unit", F.col("low").alias("reference_range_low"),
        F.col("high").alias("reference_range_high"), *keep,
    )


def _component_type() -> T.DataType:
    return T.StructType.fromDDL(RESOURCE_SCHEMAS["Observation"])["component"].dataType.elementType


def conform_medication_orders(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    dosage = F.get("dosageInstruction", F.lit(0))
    dose = F.get(dosage["doseAndRate"], F.lit(0))["doseQuantity"]
    return _resources(raw, "MedicationRequest").select(
        _own_key("MedicationRequest").alias("med_order_sk"), _key("subject.reference").alias("patient_sk"),
        _key("encounter.reference").alias("encounter_sk"),
        _coding("medicationCodeableConcept")["code"].alias("med_code"),
        F.when(F.col("status") == "stopped", "discontinued").otherwise(F.col("status")).alias("order_status"),
        F.col("authoredOn").alias("start_datetime"), _coding("medicationCodeableConcept")["display"].alias("med_display"),
        dose["value"].cast("string").alias("dose_quantity"), dose["unit"].alias("dose_unit"), _shown(dosage["route"]).alias("route"),
        _shown(dosage["timing"]["code"]).alias("frequency"), dosage["text"].alias("sig_text"),
        F.when(_first_category() == "inpatient", "inpatient").when(_first_category().isNotNull(), "outpatient").alias("order_class"),
        F.col("dispenseRequest.validityPeriod.end").alias("end_datetime"), *keep,
    )


def conform_administrations(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doses given, held or refused; what was begun counts as given, entries made in error have no action."""
    actions = F.create_map(*[F.lit(v) for pair in ADMINISTRATION_ACTIONS.items() for v in pair])
    return _resources(raw, "MedicationAdministration").select(
        _own_key("MedicationAdministration").alias("med_admin_sk"), _key("request.reference").alias("med_order_sk"),
        _key("subject.reference").alias("patient_sk"), _key("context.reference").alias("encounter_sk"),
        F.coalesce("effectiveDateTime", "effectivePeriod.start").alias("admin_datetime"), actions[F.col("status")].alias("admin_action"),
        F.col("dosage.dose.value").alias("dose_given"), F.col("dosage.dose.unit").alias("dose_unit"), _shown(F.col("dosage.route")).alias("route"),
        F.col("dosage.rateQuantity.value").alias("infusion_rate"), *keep,
    )


def _shown(concept: Column) -> Column:
    first = F.get(concept["coding"], F.lit(0))
    return F.coalesce(concept["text"], first["display"], first["code"])


def _report_note(form: Column) -> Column:
    """Key of the note with a report's narrative: the document its form points to, else one made of the text within the report."""
    pointed = F.when(F.contains(form["url"], F.lit("DocumentReference/")), _key_in(form["url"]))
    return F.coalesce(pointed, F.when(form["data"].isNotNull() | form["url"].isNotNull(), F.xxhash64(F.lit("DiagnosticReport"), F.col("id"))))


def conform_reports(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Diagnostic reports and the note that holds their narrative (see conform_notes for narratives within reports)."""
    categories = F.create_map(*[F.lit(v) for pair in REPORT_CATEGORIES.items() for v in pair])
    return _resources(raw, "DiagnosticReport").select(
        _own_key("DiagnosticReport").alias("diagnostic_report_sk"), _key("subject.reference").alias("patient_sk"),
        _key("encounter.reference").alias("encounter_sk"), _coding("code")["code"].alias("report_code"), _coding("code")["display"].alias("report_display"),
        categories[_first_category()].alias("report_category"), "status", F.col("effectiveDateTime").alias("effective_datetime"),
        _report_note(F.get("presentedForm", F.lit(0))).alias("narrative_note_sk"), *keep,
    )


def conform_procedures(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _resources(raw, "Procedure").select(
        _own_key("Procedure").alias("procedure_sk"), _key("subject.reference").alias("patient_sk"),
        _key("encounter.reference").alias("encounter_sk"), _coding("code")["code"].alias("procedure_code"), "status",
        F.col("performedDateTime").alias("performed_datetime"), _coding("code")["display"].alias("procedure_display"), *keep,
    )


def _documents(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Attachments of document references, and of reports that hold their narrative themselves, in the columns of a note."""
    references = _resources(raw, "DocumentReference").withColumn("_encounter", F.get("context.encounter", F.lit(0))["reference"])
    own = references.select(
        _own_key("DocumentReference").alias("note_sk"), _key("subject.reference").alias("patient_sk"),
        _first_category().alias("note_category"), F.col("date").alias("service_date"), _coding("type")["code"].alias("note_type_code"),
        _coding("type")["display"].alias("note_type_display"), _key("_encounter").alias("encounter_sk"),
        F.get("content", F.lit(0))["attachment"].alias("_form"), *keep,
    )
    reports = _resources(raw, "DiagnosticReport").withColumn("_form", F.get("presentedForm", F.lit(0)))
    categories = F.create_map(F.lit("PATHOLOGY"), F.lit("pathology"), F.lit("RADIOLOGY"), F.lit("radiology"))
    sections = F.create_map(*[F.lit(v) for pair in REPORT_CATEGORIES.items() for v in pair])
    within = reports.withColumn("note_sk", _report_note(F.col("_form"))).filter(
        F.col("note_sk").isNotNull() & ~F.contains(F.coalesce("_form.url", F.lit("")), F.lit("DocumentReference/")))
    return own.unionByName(within.select(
        "note_sk", _key("subject.reference").alias("patient_sk"), F.coalesce(categories[sections[_first_category()]], F.lit("other")).alias("note_category"),
        F.col("effectiveDateTime").alias("service_date"), _coding("code")["code"].alias("note_type_code"),
        _coding("code")["display"].alias("note_type_display"), _key("encounter.reference").alias("encounter_sk"), "_form", *keep,
    ))


def _binary_id(url: Column) -> Column:
    """Id of the Binary that an attachment's address names (relative or whole, with or without a version)."""
    return F.nullif(F.regexp_extract(url, "(?:^|/)Binary/([^/?#]+)", 1), F.lit(""))


def with_attachments(raw: DataFrame, landed: DataFrame, binaries: bool = True) -> DataFrame:
    """The documents, reports and Binaries that the notes of a load are made of: `raw` (its newest resources), stored documents that point
    to a Binary of it (looked for if `binaries` says that it may hold some), and the newest of every Binary pointed to, in whatever bundle (`landed`) they came.
    """
    kinds, named = ("DocumentReference", "DiagnosticReport"), ["resource_type", "resource_id"]
    address = F.when(F.col("resource_type") == "DiagnosticReport", F.get_json_object("payload", "$.presentedForm[0].url")).otherwise(
        F.get_json_object("payload", "$.content[0].attachment.url"))

    def holders(df: DataFrame) -> DataFrame:
        return df.filter(F.col("resource_type").isin(*kinds)).withColumn("_binary", _binary_id(address))

    found = holders(raw)
    if binaries:
        sent = raw.filter(F.col("resource_type") == "Binary").select(F.col("resource_id").alias("_binary"))
        pointing = holders(landed).join(sent, "_binary", "left_semi").select(*named).distinct().join(found.select(*named), named, "left_anti")
        older = holders(newest_resources(landed.join(pointing, named, "left_semi"))).join(sent, "_binary", "left_semi")
        found = found.unionByName(older.select(*found.columns))
    wanted = found.select(F.lit("Binary").alias("resource_type"), F.col("_binary").alias("resource_id")).dropna().distinct()
    bodies = newest_resources(landed.filter(F.col("resource_type") == "Binary").join(wanted, named, "left_semi"))
    return found.select(*raw.columns).unionByName(bodies.select(*raw.columns))


def conform_notes(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents, and narratives within reports: base64 to text; HTML is stripped, other text kept. A document may hold its body or point to a Binary
    of `raw` (see with_attachments); without either its text is null. Bodies that are no text (PDF, images) have no text either.
    """
    documents = _documents(raw, keep).withColumn("_binary", _binary_id(F.col("_form.url")))
    bodies = raw.filter(F.col("resource_type") == "Binary").select(
        F.col("resource_id").alias("_binary"), F.from_json("payload", RESOURCE_SCHEMAS["Binary"]).alias("_body"))
    pointing = documents.filter(F.col("_binary").isNotNull()).join(bodies, "_binary", "left")
    held = documents.filter(F.col("_binary").isNull()).withColumn("_body", F.lit(None).cast("struct<id:string,contentType:string,data:string>"))
    decoded = held.unionByName(pointing).select(
        "*", F.lower(F.trim(F.split(F.coalesce("_form.contentType", "_body.contentType"), ";")[0])).alias("content_type"),
        F.try_to_binary(F.coalesce("_form.data", "_body.data"), F.lit("base64")).alias("_bytes"))
    is_html = F.col("content_type") == "text/html"
    is_text = F.col("content_type").isNull() | F.startswith("content_type", F.lit("text/"))
    plain = F.when(is_text, F.try_validate_utf8(F.col("_bytes").cast("string")))
    return decoded.select(
        "note_sk", "patient_sk", "encounter_sk", "note_category", "note_type_code", "note_type_display", "service_date", "content_type",
        F.when(is_html, html_to_text(plain)).otherwise(plain).alias("note_text"),
        F.when(is_html, "html_stripped").when(is_text, "structured_text").alias("text_extraction_method"), *keep,
    ).withColumn("text_char_length", F.length("note_text"))


CONFORMED = {
    "patient": conform_patients, "encounter": conform_encounters, "condition": conform_conditions,
    "observation": conform_observations, "medication_order": conform_medication_orders,
    "procedure": conform_procedures, "medication_administration": conform_administrations, "diagnostic_report": conform_reports,
    "clinical_note": conform_notes, "patient_identifier": conform_identifiers, "provider": conform_providers,
    "organization": conform_organizations, "location": conform_locations,
}
RESOURCE_TYPES = {
    "patient": "Patient", "encounter": "Encounter", "condition": "Condition", "observation": "Observation",
    "medication_order": "MedicationRequest", "procedure": "Procedure", "medication_administration": "MedicationAdministration",
    "diagnostic_report": "DiagnosticReport", "clinical_note": "DocumentReference", "patient_identifier": "Patient",
    "provider": "Practitioner", "organization": "Organization", "location": "Location",
}
# Tables that a load's counts name only where it holds such resources, and the resource types that notes are made of.
OPTIONAL = {"medication_administration", "diagnostic_report", "provider", "organization", "location"}
NOTE_TYPES = {"DocumentReference", "DiagnosticReport", "Binary"}
# Tables of parts of resources that are counted as rows of another table.
PARTS = {"patient_identifier"}
# What stands for the resource in a table where a resource makes several rows.
OWNERS = {"observation": "coalesce(parent_observation_sk, observation_sk)", "patient_identifier": "patient_sk"}


# The field in which a resource of each table gives its date.
_DATE_FIELDS = {"recordedDate": ["condition"], "authoredOn": ["medication_order"], "effectiveDateTime": ["observation", "note_nlp_entity"], "performedDateTime": ["procedure"]}


def _coded_as(table: Column, field: str) -> Column:
    return (table == "medication_order") == F.lit(field == "medicationCodeableConcept")


def cohort_bundles(members: DataFrame, patients: DataFrame) -> DataFrame:
    """One FHIR Bundle per member: the patient and the rows that triggered membership.

    `members` holds the array of triggers, so the size of a bundle follows the number of criteria.
    """
    resource_types = F.create_map(*[F.lit(v) for pair in {
        "condition": "Condition", "medication_order": "MedicationRequest", "observation": "Observation",
        "procedure": "Procedure", "note_nlp_entity": "Observation",
    }.items() for v in pair])
    subject = F.concat(F.lit("Patient/"), F.col("patient_sk").cast("string"))
    patient = F.struct(F.to_json(F.struct(
        F.lit("Patient").alias("resourceType"), F.col("patient_sk").cast("string").alias("id"),
        F.array(F.struct(F.lit("mrn").alias("system"), F.col("mrn").alias("value"))).alias("identifier"),
        F.col("sex").alias("gender"), F.col("birth_date").cast("string").alias("birthDate"),
    )).alias("resource"))
    facts = F.transform(
        F.coalesce("qualifying_evidence", F.array().cast(members.schema["qualifying_evidence"].dataType)),
        lambda e: F.struct(F.to_json(F.struct(
            resource_types[e["table"]].alias("resourceType"),
            # Mentions become observations of their own: their keys must not meet those of stored observations.
            F.concat(F.when(e["table"] == "note_nlp_entity", "mention-").otherwise(""), e["ref_sk"].cast("string")).alias("id"),
            F.struct(subject.alias("reference")).alias("subject"),
            *[F.when(_coded_as(e["table"], field), F.struct(F.array(F.struct(e["code"].alias("code"))).alias("coding"))).alias(field) for field in ("code", "medicationCodeableConcept")],
            *[F.when(e["table"].isin(*tables), e["event_date"].cast("string")).alias(field) for field, tables in _DATE_FIELDS.items()],
        )).alias("resource")),
    )
    entries = F.array_join(F.transform(F.concat(F.array(patient), facts), lambda entry: F.concat(
        F.lit('{"resource":'), entry["resource"], F.lit("}"))), ",")
    bundle = F.concat(
        F.lit('{"resourceType":"Bundle","type":"collection","id":"'), F.col("cohort_sk").cast("string"), F.lit("-"),
        F.col("patient_sk").cast("string"), F.lit('","entry":['), entries, F.lit("]}"),
    )
    joined = members.join(patients.select("patient_sk", "mrn", "sex", "birth_date"), "patient_sk")
    return joined.select("cohort_sk", "patient_sk", bundle.alias("value"))
