"""Helpers the operators of this subpackage share: row selection, staging in the shared folder, whole-text defaults."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the contracts: blank and the five controls from tab to carriage return.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


_SENT: set[str] = set()


def send_code(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package (as --py-files would), once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(context._temp_dir) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SENT.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the setting is missing and the session is local (tests) is a folder of our own made; on a cluster a
    missing setting is an error, as a machine-local folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="run-checkpoint-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder: lost executors don't lose them.

    Spark deletes the files when the frame is no longer referenced and cleaning of checkpoints is on.
    """
    spark = df.sparkSession
    shared_folder(spark)
    return df.checkpoint(eager=True)


_HELD: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What a Python worker keeps between the tasks of one operator. What it kept for another is let go, as workers live through many stages."""
    if owner not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[owner] = {}
    return _HELD[owner]


def give_back() -> None:
    """Returns what this process's allocators hold unused to the system: a worker that waits, or goes on to another operator, should hold what it keeps only."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def gathered(rows: DataFrame, each: int) -> tuple[DataFrame, int, int]:
    """Staged rows in as many partitions as hold about `each` of them (never more than they have), their number, and that of the partitions.

    Small frames of many partitions would cost their every reader a task for each.
    """
    n = rows.count()
    parts = max(1, -(-n // each))
    return rows.coalesce(parts), n, parts


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle and checkpoint files that nothing refers to any more.

    Spark does so when the driver's garbage is collected, which a loop of many small jobs may not bring about for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that new_folder named, when nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(docs: DataFrame, *extra: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id (long), text (null: empty) and the extra columns named; all other columns are dropped, so that none can clash."""
    return docs.select(
        docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), *(docs[name] for name in extra)
    )


def without_spaces(text: Column) -> Column:
    """Text without any character of SPACES (one fast replacement for each)."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
