"""Jobs that write: saving and refreshing cohorts, status changes, exports, extraction runs, features.

Members and mentions never pass through the driver. A cohort run writes its evidence and members under a
run id and is finished by one row in cohort_run; readers look at finished runs only, so a job that dies
half-way leaves nothing that is read, and can simply be started again.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.operators import analysis, cohort, features, ingest, notes, review
from cohortloom.operators.criteria import CohortSpec, Criterion, CriteriaRecord, cohort_spec, primary_concept
from cohortloom.operators.criteria_sql import cohort_sql
from cohortloom.operators.evidence import event_date, evidence_rows, folded, trigger_rows, with_note_date
from cohortloom.schemas import TABLES
from cohortloom.session import checkpoint_folder
from cohortloom.sources.lake import Lake, conform, export_folder, hash_key, new_key
from cohortloom.sources.snapshots import Conflict

CLINICAL = ("patient", "condition", "medication_order", "observation", "note_nlp_entity")


def _staged(df: DataFrame, *partition_columns: str) -> DataFrame:
    """Compute once into files in the shared checkpoint folder and go on from there.

    The files survive the loss of executors, and Spark knows their size when it chooses joins.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_columns).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clinical_tables(lake: Lake) -> dict[str, DataFrame]:
    tables = lake.tables(*CLINICAL)
    tables["note_nlp_entity"] = with_note_date(tables["note_nlp_entity"], lake.table("clinical_note"))
    return tables


# --- cohorts -----------------------------------------------------------------------------------------


def save_cohort(
    lake: Lake, record: CriteriaRecord, name: str, cohort_type: str, cohort_category: str, created_by: str = "unknown",
    description: str = "", as_of=None, comparison_cohort_sk: int | None = None,
    lookback_days: int | None = None, follow_up_days: int | None = None,
) -> int:
    """Store a definition (the next version of its name; older versions are archived) and its members.

    A control cohort that names its case cohort in `comparison_cohort_sk` holds the patients who meet
    none of the record's criteria.
    """
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    same_name = lake.table("cohort_definition").filter(F.col("name") == name)
    version = _next_version(lake, name, same_name.agg(F.max("version")).first()[0] or 0)
    cohort_sk = new_key(name, version, uuid.uuid4().hex)
    code, system = lake.spark.range(1).select(
        *primary_concept(*[F.lit(text) for text in (record.icd_codes, record.med_codes, record.lab_code, record.nlp_concept, record.nlp_terms)])
    ).first()
    is_control = cohort_type == "control" and comparison_cohort_sk is not None
    spec = cohort.control_spec(record, as_of) if is_control else cohort_spec(record, as_of)
    # Members first, then the definition, then the end of the older versions: a save that dies leaves those as they were.
    _run_specs(lake, {cohort_sk: spec})
    lake.append_record(
        "cohort_definition", cohort_sk=cohort_sk, name=name, description=description, cohort_type=cohort_type,
        cohort_category=cohort_category, primary_concept_code=code, primary_concept_system=system,
        definition_logic=record.to_json(), is_nlp_derived=record.uses_notes,
        index_event_description="Structured criteria, see definition_logic", lookback_days=lookback_days,
        follow_up_days=follow_up_days, min_age_years=record.min_age, max_age_years=record.max_age,
        comparison_cohort_sk=comparison_cohort_sk, status="active", version=version, created_by=created_by, created_at=now,
    )
    _archive_older(lake, name)
    return cohort_sk


def _next_version(lake: Lake, name: str, newest: int) -> int:
    """A version number that nobody else has taken: of two saves at once each gets its own. A save that dies leaves its number unused."""
    own = hashlib.sha256(name.encode()).hexdigest()
    while not lake.log("cohort_definition").claim(f"{own}-{newest + 1}"):
        newest += 1
    return newest + 1


def _archive_older(lake: Lake, name: str) -> None:
    """Ends all versions but the newest of those that are there; of two saves at once, the one that finishes last sees both."""
    versions = current_definitions(lake).filter(F.col("name") == name).select("cohort_sk", "version", "status").collect()  # a cohort's own versions
    newest = max(r["version"] for r in versions)
    ended = [(r["cohort_sk"], "archived") for r in versions if r["version"] < newest and r["status"] != "archived"]
    if ended:
        lake.append(lake.spark.createDataFrame(ended, "cohort_sk long, status string").coalesce(1), "cohort_status_change")


def save_control(lake: Lake, case_cohort_sk: int, name: str, as_of=None, created_by: str = "unknown") -> int:
    """The control cohort of a stored case cohort, linked to it."""
    case = review.definition_detail(lake.table("cohort_definition"), case_cohort_sk).first()
    return save_cohort(
        lake, CriteriaRecord.from_json(case["definition_logic"]), name, "control", case["cohort_category"], created_by,
        f"Patients without the criteria of {case['name']}", as_of, comparison_cohort_sk=case_cohort_sk,
    )


def _stored_spec(lake: Lake, cohort_sk: int, as_of) -> CohortSpec:
    stored = review.definition_detail(lake.table("cohort_definition"), cohort_sk).first()
    record = CriteriaRecord.from_json(stored["definition_logic"])
    is_control = stored["cohort_type"] == "control" and stored["comparison_cohort_sk"] is not None
    return cohort.control_spec(record, as_of) if is_control else cohort_spec(record, as_of)


def run_cohorts(lake: Lake, cohort_sks: list[int], as_of=None) -> dict[int, str]:
    """Evaluate stored cohorts and store evidence rows, members and the finished runs; returns the run ids.

    However many cohorts are run, every clinical table is read once: the criteria of all of them are
    matched in that pass and the evidence is staged by cohort.
    """
    return _run_specs(lake, {cohort_sk: _stored_spec(lake, cohort_sk, as_of) for cohort_sk in cohort_sks})


def _pinned(lake: Lake) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The clinical tables and the versions they are read at."""
    versions = {name: lake.log(name).read().version for name in (*CLINICAL, "clinical_note")}
    tables = {name: lake.table(name, version) for name, version in versions.items()}
    tables["note_nlp_entity"] = with_note_date(tables["note_nlp_entity"], tables.pop("clinical_note"))
    return tables, versions


def _run_specs(lake: Lake, specs: dict[int, CohortSpec]) -> dict[int, str]:
    tables, versions = _pinned(lake)
    criteria = [
        Criterion(f"{cohort_sk}/{c.id}", c.table, c.matches, c.source, c.codes) for cohort_sk, spec in specs.items() for c in spec.criteria
    ]
    rows = None
    if criteria:
        label = F.split("criterion", "/", 2)
        rows = _staged(
            evidence_rows(tables, criteria).withColumns({"cohort_sk": label[0].cast("long"), "criterion": label[1]}), "cohort_sk"
        )
    runs = {}
    for cohort_sk, spec in specs.items():
        own = rows.filter(F.col("cohort_sk") == cohort_sk).drop("cohort_sk") if spec.criteria else None
        runs[cohort_sk] = _store_run(lake, cohort_sk, spec, tables, versions, own)
    return runs


def run_cohort(lake: Lake, cohort_sk: int, as_of=None) -> str:
    return run_cohorts(lake, [cohort_sk], as_of)[cohort_sk]


def _store_run(
    lake: Lake, cohort_sk: int, spec: CohortSpec, tables: dict[str, DataFrame], versions: dict[str, int], rows: DataFrame | None,
    state: DataFrame | None = None, based_on: str | None = None,
) -> str:
    """Store what the evidence rows found, folded into an earlier run's state if one is given."""
    run_id = uuid.uuid4().hex
    place = {"cohort_sk": cohort_sk, "run_id": run_id}
    if spec.criteria:
        found = None if rows is None else trigger_rows(rows)
        triggers = _staged(state if found is None else found if state is None else folded(state, found))
        lake.append(triggers, "cohort_state", ordered=True, **place)
        members = _staged(cohort.members_from_triggers(tables, spec, triggers))
    else:
        members = _staged(cohort.members_with_evidence(tables, spec))
    required = spec.expression.required()
    if required and rows is not None:
        # Rows of patients who aren't members are kept as well: a later run may find what makes them so. A run writes only what it has read.
        lake.append(rows.filter(F.col("criterion").isin(required)), "cohort_evidence", ordered=True, **place)
    members = members.withColumn("cohort_member_sk", F.xxhash64(F.lit(run_id), F.lit(cohort_sk), "patient_sk"))
    n_members = lake.append(members, "cohort_member", ordered=True, **place)
    lake.append_record("cohort_run", cohort_sk=cohort_sk, run_id=run_id, n_members=n_members, read_versions=json.dumps(versions), based_on=based_on)
    return run_id


# A refresh that folds new rows into the state of the last run may follow another at most so often before all rows are read again.
MOST_STEPS = 30


def _chain(runs: dict[str, str | None], run_id: str) -> list[str]:
    """A run and those it was based on, newest first."""
    out = []
    while run_id in runs:
        out.append(run_id)
        run_id = runs[run_id]
    return out


def _all_runs(lake: Lake) -> dict[str, str | None]:
    """What each run was based on: one short row a run."""
    return {row["run_id"]: row["based_on"] for row in lake.table("cohort_run").select("run_id", "based_on").collect()}


def run_evidence(lake: Lake, cohort_sk: int) -> DataFrame:
    """All evidence rows of the members of a cohort's newest run, whichever run read them."""
    run_id = _newest_runs(lake, [cohort_sk])[cohort_sk]
    rows = lake.table("cohort_evidence", run_id=set(_chain(_all_runs(lake), run_id)))
    return rows.join(lake.table("cohort_member", run_id=run_id).select("patient_sk"), "patient_sk", "left_semi")


def refresh_incremental(lake: Lake, cohort_sk: int, as_of=None) -> str:
    """A run that reads only the rows added to the clinical tables since the cohort's last one and folds them into its state; equal to a full run.

    It is a full run instead if there is no usable earlier one, if rows that one has read have gone or were replaced, or if notes have come that mentions
    without a date may belong to. Patients are always read: age and death are as of the day of the run.
    """
    last = lake.table("cohort_run").filter(F.col("cohort_sk") == cohort_sk).orderBy(F.col("finished_at").desc(), F.col("run_id").desc()).first()
    spec = _stored_spec(lake, cohort_sk, as_of)
    if last is None or last["read_versions"] is None or not spec.criteria or len(_chain(_all_runs(lake), last["run_id"])) >= MOST_STEPS:
        return run_cohort(lake, cohort_sk, as_of)
    tables, versions = _pinned(lake)
    marks = json.loads(last["read_versions"])
    state = lake.table("cohort_state", run_id=last["run_id"])
    fresh = {}
    new_notes, notes_gone = lake.added_since("clinical_note", marks["clinical_note"])
    for name in {c.table for c in spec.criteria}:
        added, gone = lake.added_since(name, marks[name])
        if name == "note_nlp_entity":
            undated = F.col("event_date").isNull() & (F.col("table") == name)
            gone = gone or notes_gone or (new_notes is not None and not state.filter(undated).isEmpty())
            added = None if added is None else with_note_date(added, lake.table("clinical_note", versions["clinical_note"]))
        if gone:
            return run_cohort(lake, cohort_sk, as_of)
        if added is not None:
            fresh[name] = added
    criteria = [c for c in spec.criteria if c.table in fresh]
    rows = _staged(evidence_rows(fresh, criteria)) if criteria else None
    return _store_run(lake, cohort_sk, spec, tables, versions, rows, state, last["run_id"])


def _newest_runs(lake: Lake, cohort_sks: list[int] | None = None) -> dict[int, str]:
    """The newest finished run of every cohort (or of those named): one short row a cohort definition."""
    newest = F.max(F.struct("finished_at", "run_id"))["run_id"]
    runs = lake.table("cohort_run")
    if cohort_sks is not None:
        runs = runs.filter(F.col("cohort_sk").isin(cohort_sks))
    return {row["cohort_sk"]: row["run_id"] for row in runs.groupBy("cohort_sk").agg(newest.alias("run_id")).collect()}


def current_members(lake: Lake, cohort_sks: list[int] | None = None) -> DataFrame:
    """Members of the newest finished run of every cohort (or of those named); files of other runs are not even listed."""
    return lake.table("cohort_member", run_id=set(_newest_runs(lake, cohort_sks).values()))


def expire_runs(lake: Lake, keep: int = 2) -> int:
    """Takes all but the newest `keep` finished runs of each cohort out of the history; returns how many went for good. Their files go with the logs' next vacuum.

    Evidence that a kept run is based on stays, and the rows of the runs that read it.
    """
    place = Window.partitionBy("cohort_sk").orderBy(F.col("finished_at").desc(), F.col("run_id").desc())
    ranked = lake.table("cohort_run").withColumn("_place", F.row_number().over(place))
    newest = {row["run_id"]: row["_place"] <= keep for row in ranked.select("run_id", "_place").collect()}  # one short row a run
    based_on = _all_runs(lake)
    needed = {run for kept, stays in newest.items() if stays for run in _chain(based_on, kept)}  # evidence of a run lies with those it was based on
    gone = [run for run, stays in newest.items() if not stays]
    for table, without in (("cohort_member", gone), ("cohort_state", gone), ("cohort_evidence", [run for run in gone if run not in needed])):
        lake.log(table).commit(lambda there: [folder for folder in there if folder.rpartition("run_id=")[2] not in without])
    dropped = [run for run in gone if run not in needed]
    if dropped:
        lake.overwrite(_staged(lake.table("cohort_run").filter(~F.col("run_id").isin(dropped))).coalesce(1), "cohort_run")
    return len(dropped)


def current_definitions(lake: Lake) -> DataFrame:
    return review.current_status(lake.table("cohort_definition"), lake.table("cohort_status_change"))


def change_status(lake: Lake, cohort_sk: int, status: str) -> None:
    if status not in ("draft", "active", "archived"):
        raise ValueError(f"unknown status {status!r}")
    lake.append_record("cohort_status_change", cohort_sk=cohort_sk, status=status)


def refresh_cohorts(lake: Lake, cohort_sks: list[int], as_of=None, incremental: bool = False) -> DataFrame:
    """Re-run the stored logic of cohorts; per cohort who was added, dropped and kept against the prior run.

    All of them in one pass over the clinical tables, or each from the rows added since its last run.
    """
    prior = _staged(current_members(lake, cohort_sks).select("cohort_sk", "patient_sk"))
    runs = {sk: refresh_incremental(lake, sk, as_of) for sk in cohort_sks} if incremental else run_cohorts(lake, cohort_sks, as_of)
    members = lake.table("cohort_member", run_id=set(runs.values())).select("cohort_sk", "patient_sk")
    return analysis.membership_difference(prior, members, ("cohort_sk", "patient_sk"))


def refresh_cohort(lake: Lake, cohort_sk: int, as_of=None) -> DataFrame:
    return refresh_cohorts(lake, [cohort_sk], as_of)


def refresh_prospective(lake: Lake, as_of=None) -> DataFrame:
    """The nightly job: all active prospective cohorts, whose criteria capture new data over time."""
    chosen = review.filter_definitions(current_definitions(lake), categories=("prospective",), statuses=("active",))
    return refresh_cohorts(lake, [row["cohort_sk"] for row in chosen.select("cohort_sk").collect()], as_of)


def member_events(lake: Lake, cohort_sk: int, table: str) -> DataFrame:
    """Rows of a clinical table for the members, within the definition's look-back and follow-up days."""
    days = review.definition_detail(lake.table("cohort_definition"), cohort_sk).select("lookback_days", "follow_up_days").first()
    members = current_members(lake, [cohort_sk])
    rows = lake.table(table)
    return cohort.events_around_index(members, rows, event_date(table, rows), days["lookback_days"], days["follow_up_days"])


def export_members(lake: Lake, cohort_sk: int, folder: str, limit: int | None = None) -> str:
    """CSV of the member list by MRN, named after the cohort: all members unless a limit is given."""
    name = review.definition_detail(lake.table("cohort_definition"), cohort_sk).select("name").first()["name"]
    rows = review.export_rows(current_members(lake, [cohort_sk]), lake.table("patient"), cohort_sk, limit)
    return lake.export_csv(rows, f"{folder}/{export_folder(cohort_sk, name)}", "mrn", "patient_sk")


def export_bundles(lake: Lake, cohort_sk: int, folder: str) -> str:
    """One FHIR Bundle per line and member, written by all tasks."""
    members = current_members(lake, [cohort_sk])
    return lake.export_lines(ingest.cohort_bundles(members, lake.table("patient")), folder)


def preview(lake: Lake, record: CriteriaRecord, as_of=None) -> tuple[int, DataFrame, str]:
    """Size of a cohort, a sample page, and the query as readable SQL text."""
    members = _staged(cohort.build_cohort(_clinical_tables(lake), cohort_spec(record, as_of)))
    return members.count(), cohort.preview(members), cohort_sql(record, as_of)[0]


# --- sources -------------------------------------------------------------------------------------------


def load_resources(lake: Lake, folder: str, source_system: str, bundle_id: str) -> dict[str, int]:
    """Land the NDJSON files of a folder (resources, or Bundles of them) and conform them into the clinical tables; rows written per table.

    Every payload is landed once a bundle, and only the newest version of a resource (over all bundles) is conformed: repeating any load changes nothing, and
    starting again completes one that died. Lines that are no resource go to raw_quarantine.
    """
    landed = _staged(ingest.land_resources(lake.spark.read.text(folder), source_system, bundle_id, F.current_timestamp()))
    counts = {"raw_quarantine": lake.append(_not_landed(lake, ingest.quarantined(landed), "raw_quarantine", bundle_id), "raw_quarantine")}
    lake.append(_not_landed(lake, landed.filter(F.col("resource_type").isNotNull()), "raw_fhir_resource", bundle_id), "raw_fhir_resource")
    raw = _staged(ingest.newest_resources(lake.table("raw_fhir_resource"), bundle_id))
    there = {row[0] for row in raw.select("resource_type").distinct().collect()}  # a few names
    for table, conform_resources in ingest.CONFORMED.items():
        needed, of = (ingest.NOTE_TYPES, None) if table == "clinical_note" else ({ingest.RESOURCE_TYPES[table]}, raw)
        if there.isdisjoint(needed):
            if table not in ingest.OPTIONAL | ingest.PARTS:
                counts[table] = 0
            continue
        if of is None:  # a Binary may come with another bundle than the document that points to it
            of = _staged(ingest.with_attachments(raw, lake.table("raw_fhir_resource"), "Binary" in there))
        written = _merge(lake, conform_resources(of, ingest.PROVENANCE), table)
        if table not in ingest.PARTS:
            counts[table] = written
    return counts


def load_concepts(lake: Lake, rows: DataFrame) -> int:
    """Add terminology, or change it: rows of code_system, code, display, concept_class, maps_to. Equal rows are left; returns how many were written."""
    return _merge(lake, ingest.newest_concepts(rows), "concept")


def _not_landed(lake: Lake, rows: DataFrame, table: str, bundle_id: str) -> DataFrame:
    there = lake.table(table).filter(F.col("bundle_id") == bundle_id).select("digest")
    return rows.dropDuplicates(["digest"]).join(there, "digest", "left_anti")


def _merge(lake: Lake, rows: DataFrame, table: str) -> int:
    """Rows of new resources are added, those of changed ones take the place of the stored ones, equal ones are left; returns how many were written.

    Resources are compared as a whole (all rows of each), so rows that a newer version no longer has go; one that has none is given by a row without a key. Stored rows are looked at by key first: only those of the
    load are digested, and only the files of writes that hold changed rows are written anew, in one step that readers see whole or not at all.
    """
    spec = TABLES[table]
    owner = F.expr(ingest.OWNERS.get(table, spec.key))
    columns = [name for name in spec.schema.names if name not in ("loaded_at", "ingested_at")]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)

    def by_owner(df: DataFrame) -> DataFrame:
        return df.groupBy("_owner").agg(F.sort_array(F.collect_list(F.when(F.col(spec.key).isNotNull(), digest))).alias("_digests"))

    rows = _staged(conform(rows, spec).withColumn("_owner", owner)).filter("_owner IS NOT NULL")
    while True:
        stored = lake.table(table).withColumn("_owner", owner).join(rows.select("_owner").distinct(), "_owner", "left_semi")
        there = by_owner(stored).withColumnRenamed("_digests", "_stored")
        changed = _staged(by_owner(rows).join(there, "_owner", "left").filter(F.col("_digests") != F.coalesce("_stored", F.array().cast("array<string>"))).select("_owner", F.col("_stored").isNotNull().alias("_known")))
        fresh = rows.filter(F.col(spec.key).isNotNull()).join(changed, "_owner", "left_semi").drop("_owner")
        known = changed.filter("_known").select("_owner")
        try:
            if known.isEmpty():
                return lake.append(fresh, table, ordered=True)
            lake.replace_rows(fresh, table, known, ingest.OWNERS.get(table))
            return fresh.count()
        except Conflict:  # the table has changed meanwhile: compare again
            continue


def load_extract(lake: Lake, rows: DataFrame, source_table: str, key: list[str], batch_id: str) -> int:
    """Land rows extracted from a relational source; returns their number."""
    return lake.append(ingest.land_rows(rows, source_table, key, batch_id, F.current_timestamp()), "raw_extract_row")


# --- extraction runs -----------------------------------------------------------------------------------


def rule_extractor(todo: DataFrame) -> DataFrame:
    """Answers of the rule-based extractor: all notes, those without any mention with an empty list."""
    mentions = notes.extract_mentions(todo)
    entity = F.struct(*[F.col(name) for name in notes.MENTION.names])
    per_note = mentions.groupBy("note_sk").agg(F.collect_list(entity).alias("entities"))
    empty = F.array().cast(notes.ANSWER_SCHEMA["entities"].dataType)
    return todo.select("note_sk").join(per_note, "note_sk", "left").select(
        "note_sk", F.lit("ok").alias("outcome"), F.coalesce("entities", empty).alias("entities")
    )


def run_extraction(
    lake: Lake, extractor: Callable[[DataFrame], DataFrame] = rule_extractor, model_name: str = "rules",
    model_version: str = "1", max_notes: int | None = None,
) -> int:
    """Extract mentions from all notes not yet answered; returns the run's key.

    Good answers are remembered even when they hold no mention; failed notes are asked again in the next
    run. Raises when every note failed.
    """
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    run_sk = new_key(model_name, model_version, uuid.uuid4().hex)
    done = lake.table("note_nlp_outcome").filter(F.col("outcome") == "ok")
    texts = lake.table("clinical_note")
    keys = _staged(notes.unprocessed_keys(texts, lake.table("note_nlp_entity"), done, limit=max_notes))
    todo = texts.join(keys, "note_sk", "left_semi")  # few new keys are broadcast, so texts are not shuffled
    lake.append_record("nlp_run", nlp_run_sk=run_sk, model_name=model_name, model_version=model_version, run_started_at=started)
    answers = _staged(extractor(todo))
    totals = notes.check_outcomes(notes.outcome_counts(answers))
    entities = notes.with_note_keys(notes.entities_of(answers), texts).withColumns({
        "nlp_run_sk": F.lit(run_sk), "entity_sk": hash_key("note_sk", F.lit(run_sk), "mention_no"),
    })
    lake.append(entities.drop("mention_no"), "note_nlp_entity", ordered=True)
    lake.append(
        answers.select("note_sk", "outcome", F.size("entities").alias("n_entities"), F.lit(run_sk).alias("nlp_run_sk")),
        "note_nlp_outcome",
    )
    finished = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    lake.append_record(
        "nlp_run", nlp_run_sk=run_sk, model_name=model_name, model_version=model_version,
        run_finished_at=finished, note_count=sum(totals.values()),
    )
    return run_sk


def build_features(lake: Lake, as_of) -> int:
    """Assemble patient_feature as of a day; returns the number of patients."""
    tables = lake.tables("patient", "encounter", "condition", "medication_order", "observation", "note_nlp_entity")
    tables["note_nlp_entity"] = with_note_date(tables["note_nlp_entity"], lake.table("clinical_note"))
    # The joins leave the rows sorted by patient within files, so they are not ordered again.
    return lake.overwrite(features.patient_features(tables, as_of), "patient_feature", ordered=False)
