"""Intermediate tables: written once to the folder that all executors share, and read back.

The folder is the session's spark.checkpoint.dir. Only a local master without that setting gets a folder of its own, which
goes when the process ends. A table is computed once, its lineage ends there, and a lost executor costs a retry and not the job.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_written: list[str] = []
_lasting: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        path = tempfile.mkdtemp(prefix="shelfmark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dirs[app] = "file://" + path
    return _own_dirs[app]


#: Spark's own switch: with it a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back. A lasting table outlives the scratch() it is made in. The shuffle files that made it go at once, as nothing reads them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfmark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    (_lasting if lasting else _written).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: what it held of finished queries (broadcasts, plans) goes, and its heap shrinks again.

    For operators of many queries, between their parts: a driver's heap grows while there is room, and only a full collection gives memory back.
    """
    spark.sparkContext._jvm.System.gc()


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for what isn't one table; it goes as the tables of cut() do."""
    path = f"{shared_dir(spark)}/shelfmark/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def drop(df: DataFrame) -> None:
    """Delete a table of cut() that nothing will read again, as what was made of it is itself cut."""
    path = getattr(df, "scratch_path", None)
    for paths in (_written, _lasting):
        if path in paths:
            paths.remove(path)
            _delete(df.sparkSession, path)


def drop_scratch(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables of this process but for the first keep (then lasting ones stay, too); call it after the results that use them are written."""
    n = 0
    while len(_written) > keep:
        n += _delete(spark, _written.pop())
    while _lasting and not keep:
        n += _delete(spark, _lasting.pop())
    return n


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside go at the end: write what is wanted before it."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            _delete(spark, _written.pop())
