"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


class NoSharedFolder(RuntimeError):
    """The session runs on a cluster and names no ``spark.checkpoint.dir``."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session of one machine may name none: then a temporary folder takes its
    place, which goes when Python ends. The session's settings stay as they are.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lexmill-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexmill-{spark.sparkContext.applicationId}"


def settled_path(spark: SparkSession, name: str) -> str:
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of an execution go when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WRITERS, _BEFORE = threading.Lock(), [0], [""]


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Within, CLEANUP is set; the last of several threads puts back what was there before the first."""
    with _LOCK:
        if not _WRITERS[0]:
            _BEFORE[0] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _WRITERS[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS[0] -= 1
            if not _WRITERS[0]:
                spark.conf.set(CLEANUP, _BEFORE[0])


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor, and
    what is used twice is computed once. The shuffle files of ``df`` go at once,
    as nothing reads them once the table is written.
    """
    path = settled_path(df.sparkSession, name)
    with _freeing(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more: all that was made from them is settled itself."""
    for table in tables:
        _delete(table.sparkSession, table.settled_at)


def forget(spark: SparkSession) -> None:
    """Delete all that this application has settled; results that still read it are lost."""
    _delete(spark, _own(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
