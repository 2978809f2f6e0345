"""Intermediate tables in the folder that every node of the cluster shares.

Writing a table cuts the lineage of a plan: a lost executor re-reads files
instead of re-running everything before them.  The folder comes from the
session's ``spark.checkpoint.dir``.  Only where that is unset and the session
runs on this machine alone (tests, a laptop) a temporary folder is used instead;
on a cluster its absence is an error, as executors could not read each other's
files.

A written table needs the shuffles before it no longer, so their files are
removed as soon as it is complete and do not pile up behind a chain of tables.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for removing the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session, or a temporary one where none is set and the master is local."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions inside leave no shuffle files; the session's own setting is restored."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkloom/{label}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stage`` returned and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        roots = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
        for root in roots:
            if "/sparkloom/" in root:
                path = spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
