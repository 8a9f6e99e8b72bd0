"""Tables written to the shared folder to cut lineage.

The folder is the one the cluster names in ``spark.checkpoint.dir``; where that is unset and all of Spark
runs in this process (tests, a laptop) a temporary folder of this machine is named instead.  A table in it survives the loss of
any executor, is read back by column, and has a lineage of one file scan.  Tables live until they are
dropped, :func:`release`, or the end of the driver's Python process: call ``release`` between jobs of a
long session, when nothing reads their results any more.  The shuffle files that a table took go once it is
written; else they would stay until the driver happens to collect its garbage.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one of this machine only where the session names none and has no other machine."""
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError(f"{_CONF} has to name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="veriscope-"))
        found = _own[0]
    return found.rstrip("/")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _cleaning(spark: SparkSession):
    """Within it, shuffle files are deleted at the end of the query that made them."""
    return _setting(spark, _CLEAN, "true")


def unsorted(spark: SparkSession, folders: int):
    """Within it, a task that writes rows to so many folders at most writes to all of them at once, and does not sort its rows first."""
    return _setting(spark, _WRITERS, str(folders))


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/veriscope-{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table, as :func:`table` returned it; nothing may read it afterwards."""
    for made in [m for m in _made if m[1] == table.scratch_path]:
        _made.remove(made)
        _delete(*made)


def mark() -> int:
    """A point in time for :func:`release`."""
    return len(_made)


def release(keep: DataFrame | None = None, since: int = 0) -> None:
    """Delete every table made here since a mark, but for ``keep`` as :func:`table` returned it."""
    held = getattr(keep, "scratch_path", None)
    for made in [m for m in _made[since:] if m[1] != held]:
        _made.remove(made)
        _delete(*made)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the cluster's own cleaning of the folder is left
        pass


atexit.register(release)
