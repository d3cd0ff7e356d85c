"""Tables of the lakehouse: schemas, scans, appends, overwrites, replaced rows, logged updates, exports.

Every table is a log of versions over folders of Parquet files (`snapshots`): a write is seen whole or not at all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from contextlib import suppress
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.schemas import NOW, TABLES, Table
from cohortloom.sources.snapshots import WRITE as WRITE_COLUMN
from cohortloom.sources.snapshots import Conflict, SnapshotLog

# Writes of single records that a table may consist of before they are put together.
MOST_FOLDERS = 64


def new_key(*parts: str | int) -> int:
    """A key for one new small record (definition, run), known before it is written."""
    digest = hashlib.sha256("|".join(str(part) for part in parts).encode()).digest()
    return int.from_bytes(digest[:8], "big") >> 1


def hash_key(*columns: str):
    """Key of a row as a hash of its business key: the same on every recomputation."""
    return F.xxhash64(*columns)


def conform(df: DataFrame, table: Table) -> DataFrame:
    """Columns in the order and types of the table's schema; defaults fill what is missing or null."""
    columns = []
    for f in table.schema.fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in table.defaults:
            default = table.defaults[f.name]
            value = F.coalesce(value, F.current_timestamp() if default == NOW else F.lit(default))
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def without_internal_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose name starts with an underscore; untyped null columns become text."""
    df = df.drop(*[name for name in df.columns if name.startswith("_")])
    untyped = {f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    return df.withColumns(untyped) if untyped else df


def _lookup_options(spec: Table) -> dict[str, str]:
    """Bloom filters, as large as the rows of a file need, of the columns rows are looked up by: a reader skips row groups that can't hold the value.

    These columns are (nearly) unique, so a dictionary of them would only take the filter's place and grow too large to be of use.
    """
    options = {"parquet.bloom.filter.adaptive.enabled": "true"} if spec.lookups else {}
    for name in spec.lookups:
        options |= {f"parquet.bloom.filter.enabled#{name}": "true", f"parquet.enable.dictionary#{name}": "false"}
    return options


@dataclass
class Lake:
    """Names and operations of the tables in their schemas; a layer that isn't named keeps its own name."""

    spark: SparkSession
    schemas: Mapping[str, str] = field(
        default_factory=lambda: {"bronze": "landing", "silver": "clinical", "gold": "cohorts"}
    )

    root: str | None = None

    def log(self, table: str) -> SnapshotLog:
        root = self.root or self.spark.conf.get("spark.sql.warehouse.dir")
        return SnapshotLog(self.spark, f"{root.rstrip('/')}/{self.schemas.get(TABLES[table].layer, TABLES[table].layer)}/{table}")

    def create(self) -> None:
        """Every table as an empty one, where it is missing."""
        for table in TABLES:
            self.log(table).publish(0, [])

    def table(self, table: str, version: int | None = None, **partition) -> DataFrame:
        """The newest version of a table, or an older one; of a partitioned table only the writes with the values (or one of the values) named."""
        log, spec = self.log(table), TABLES[table]
        snapshot = log.read(version)
        if snapshot is None:
            raise LookupError(f"there is no table {table}")
        wanted = [{f"{name}={value}" for value in (values if isinstance(values, (list, set)) else [values])} for name, values in partition.items()]
        return self._read(log, spec, [folder for folder in snapshot.folders if all(names & set(folder.split("/")) for names in wanted)])

    def _read(self, log: SnapshotLog, spec: Table, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], spec.schema)
        rows = self.spark.read.schema(spec.schema).option("basePath", log.data).parquet(*[f"{log.data}/{folder}" for folder in folders])
        return rows.select(*spec.schema.names)

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in names}

    def query(self, text: str, **parameters) -> DataFrame:
        """SQL with named parameters; {patient} and the like stand for tables."""
        return self.spark.sql(text, args=parameters, **{name: self.table(name) for name in set(re.findall(r"\{(\w+)\}", text))})

    def _write(self, df: DataFrame, table: str, ordered: bool, partition: Mapping[str, object]) -> tuple[str, int]:
        """A folder with the rows, which no version names yet, and their number."""
        spec, log = TABLES[table], self.log(table)
        if tuple(partition) != spec.partitions:
            raise ValueError(f"{table} is written by {spec.partitions or 'no'} partition")
        seen = Observation()
        out = conform(without_internal_columns(df), spec).drop(*spec.partitions)
        layout = [name for name in spec.layout if name not in spec.partitions]
        if ordered and layout:
            # The range covers time or key as well, so one patient with very many rows is spread out.
            out = out.repartitionByRange(*layout).sortWithinPartitions(*layout)
        folder = "/".join([log.new_write(), *[f"{name}={value}" for name, value in partition.items()]])
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**_lookup_options(spec)).parquet(f"{log.data}/{folder}")
        return folder, seen.get["n"]

    def overwrite(self, df: DataFrame, table: str, ordered: bool = True, **partition) -> int:
        """Replace a table; the number of rows written comes from the write itself.

        Readers see the old rows until all new ones are there; if the write fails, they stay. The rows may come from the table itself.
        Ordering reads the input twice (once to find the ranges): stage an input that is costly to compute.
        """
        folder, n = self._write(df, table, ordered, partition)
        self.log(table).commit(lambda _: [folder])
        return n

    def append(self, df: DataFrame, table: str, ordered: bool = False, **partition) -> int:
        """Add rows; of a partitioned table those of one partition, whose values are named."""
        folder, n = self._write(df, table, ordered, partition)
        if n:
            self.log(table).commit(lambda there: [*there, folder])
        return n

    def added_since(self, table: str, version: int) -> tuple[DataFrame | None, bool]:
        """Rows written since a version (None if there are none), and whether rows of that version have gone (replaced, or its log is gone)."""
        log, spec = self.log(table), TABLES[table]
        if version not in log.versions():
            return None, True
        then, now = set(log.read(version).folders), log.read().folders
        added = [folder for folder in now if folder not in then]
        return self._read(log, spec, added) if added else None, not then <= set(now)

    def supersede(self, df: DataFrame, table: str, **partition) -> bool:
        """Put rows in place of all that were written under the same values but the last one, a number that must be higher than theirs; False (and no change) if it isn't."""
        log = self.log(table)
        *own, (counter, number) = partition.items()
        own = {f"{name}={value}" for name, value in own}
        mine = lambda folder: own <= set(folder.split("/"))
        behind = lambda there: all(int(f.rpartition(f"{counter}=")[2]) < number for f in there if mine(f))
        newest = log.read()
        if not behind(newest.folders):
            return False
        folder, _ = self._write(df, table, True, partition)
        changed: list[bool] = []

        def change(there: list[str]) -> list[str]:
            changed[:] = [behind(there)]
            return [*[f for f in there if not mine(f)], folder] if changed[0] else there

        log.commit(change)
        return changed[0]

    def replace_rows(self, df: DataFrame, table: str, gone: DataFrame, owner: str | None = None) -> int:
        """Put rows in the place of those whose key (or `owner` expression) is in `gone`, in one version; returns how many were written.

        Only the folders of writes that hold such rows are written anew. Raises Conflict if the table has changed meanwhile.
        """
        spec, log = TABLES[table], self.log(table)
        newest, owner = log.read(), owner or spec.key
        keys = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
        stored = self._read(log, spec, list(newest.folders))
        touched = [] if not newest.folders else (
            self.spark.read.schema(spec.schema).option("basePath", log.data).parquet(*[f"{log.data}/{f}" for f in newest.folders])
            .select(F.expr(owner).alias("_gone"), WRITE_COLUMN).join(keys, "_gone", "left_semi").select(WRITE_COLUMN).distinct().collect()
        )
        # One short name a write: there are as many as writes since the table was last written whole.
        names = {f"{WRITE_COLUMN}={row[0]}" for row in touched}
        old = [folder for folder in newest.folders if folder.split("/")[0] in names]
        if old:
            stored = self._read(log, spec, old)
            df = stored.join(keys, F.expr(owner) == F.col("_gone"), "left_anti").unionByName(conform(df, spec))
        folder, n = self._write(df, table, True, {})
        log.commit(lambda there: [*[f for f in there if f not in old], folder], newest.version)
        return n

    def append_record(self, table: str, **values) -> None:
        """One new record from plain values; columns that are not named take their default.

        Tables of such records are small: once they have grown to many files they are written as one.
        """
        spec, log = TABLES[table], self.log(table)
        schema = T.StructType([spec.schema[name] for name in values])
        self.append(self.spark.createDataFrame([tuple(values.values())], schema).coalesce(1), table)
        newest = log.read()
        if len(newest.folders) >= MOST_FOLDERS:
            folder, _ = self._write(self._read(log, spec, list(newest.folders)).coalesce(1), table, False, {})
            with suppress(Conflict):  # somebody has added a record: the next one who does will write the table anew
                log.commit(lambda _: [folder], newest.version)

    def export_csv(self, df: DataFrame, folder: str, *order: str) -> str:
        """CSV files with a header, written by all tasks: in the order of their names they hold the rows in order."""
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        df.write.mode("overwrite").option("header", True).csv(folder)
        return folder

    def export_lines(self, df: DataFrame, folder: str) -> str:
        """Text files of the column `value`, written by all tasks."""
        df.select("value").write.mode("overwrite").text(folder)
        return folder


def export_folder(cohort_sk: int, name: str) -> str:
    return f"cohort_{cohort_sk}_{name.replace(' ', '_').replace('/', '_')}.csv"
