"""Versions of a table: a new one is written whole beside the old, and a pointer is moved when it stands.

A run that fails, or is killed, before the pointer moves leaves the old version as it was. Two writers never write to one place, and one that
was outrun makes its version anew from the other's. Works on any Hadoop file system that can create a file only where there is none.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    """The numbers that the entries of a folder are named after, behind prefix; none if there is no such folder."""
    fs, at = _fs(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit()]


def present(spark: SparkSession, pattern: str) -> bool:
    """Whether anything is at a path with wildcards."""
    fs, at = _fs(spark, pattern)
    return len(fs.globStatus(at) or []) > 0


def claim(spark: SparkSession, folder: str) -> int:
    """The next number of a folder, taken by making an empty file of that name, which only one of several writers can; the others take later ones."""
    n = max(numbers(spark, folder), default=0) + 1
    while True:
        fs, at = _fs(spark, f"{folder}/{n}")
        try:
            fs.create(at, False).close()
            return n
        except Exception:  # noqa: BLE001  which error says that the file is there differs between file systems
            if not fs.exists(at):
                raise
            n += 1


def _set(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file, unless there is one; whether this call made it."""
    fs, at = _fs(spark, path)
    try:
        out = fs.create(at, False)
    except Exception:  # noqa: BLE001
        if not fs.exists(at):
            raise
        return False
    out.writeBytes(text)
    out.close()
    return True


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, in the place of one that is there."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.writeBytes(text)
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _latest(spark: SparkSession, base: str) -> tuple[int, str | None, list[int]]:
    """(number, folder) of the last version that stands, (0, None) before the first; and the later numbers whose writer hasn't said its folder (yet)."""
    blank = []
    for n in sorted(numbers(spark, f"{base}/current"), reverse=True):
        if folder := read_text(spark, f"{base}/current/{n}"):
            return n, f"{base}/{folder}", blank
        blank.append(n)
    return 0, None, blank


def current(spark: SparkSession, base: str) -> DataFrame | None:
    """The table that the pointer shows, None before the first version."""
    folder = _latest(spark, base)[1]
    return spark.read.parquet(folder) if folder else None


def _written(df: DataFrame, base: str) -> str:
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{folder}")
    return folder


def publish(df: DataFrame, base: str) -> int:
    """Write df as the next version, whatever others publish meanwhile, and move the pointer to it; returns its number. What failed runs wrote is never read."""
    folder, n = _written(df, base), max(numbers(df.sparkSession, f"{base}/current"), default=0) + 1
    while not _set(df.sparkSession, f"{base}/current/{n}", folder):
        n += 1
    return n


def update(spark: SparkSession, base: str, make: Callable[[DataFrame | None], DataFrame], tries: int = 6, wait: float = 1.0) -> int:
    """Publish make(the current version) as the one right after it; made again from the newer one if another writer was first, so no update is lost.

    A number that stays blank over a wait is of a writer that died between its two steps, and is passed over.
    """
    known: set[int] = set()
    for _ in range(tries):
        last, folder, blank = _latest(spark, base)
        if set(blank) <= known:
            made = _written(make(spark.read.parquet(folder) if folder else None), base)
            n = max([last, *blank]) + 1
            if _set(spark, f"{base}/current/{n}", made):
                return n
        else:
            time.sleep(wait)
        known |= set(blank)
    raise RuntimeError(f"others published first {tries} times")


def attempt(spark: SparkSession, base: str, make: Callable[[DataFrame | None], DataFrame], record: Callable[[bool, str | None], None]) -> bool:
    """Publish make(the current version) and record (True, None); if it fails, record (False, the error) and leave the current version."""
    try:
        update(spark, base, make)
    except Exception as error:  # noqa: BLE001
        record(False, str(error)[:300])
        return False
    record(True, None)
    return True
