"""Tables in the folder that driver and executors share, so that later stages depend on files and not on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession | None = None) -> SparkSession:
    """The session (the active one if none is given); Python workers of functions made from now on can import this package from its own folder.

    On a cluster whose executors don't see that folder, install the package there.
    """
    spark = spark or SparkSession.active()
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own on a single machine, and an error on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if (kept := context._jsc.sc().getCheckpointDir()).isDefined():
        return kept.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="tracewell-shared-")
    context.setCheckpointDir(f"file://{made}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def clean_shuffles(spark: SparkSession):
    """Removes the shuffles of the queries that are run within it, each once it has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read again.

    Once the files are there, nobody needs the shuffles that made them, so these are removed.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    with clean_shuffles(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._table_path = path
    return made


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_tables(*made: DataFrame) -> None:
    """Removes the files of tables that table() wrote; no plan that is still to run may read them."""
    for df in made:
        drop_path(df.sparkSession, df._table_path)


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Puts a file with text in place in one step (a rename); an error if it is there already."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    where, draft = of(path), of(f"{path}-{uuid.uuid4().hex}.draft")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(where) or not files.rename(draft, where):
        files.delete(draft, False)
        raise FileExistsError(path)
