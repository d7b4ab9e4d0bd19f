"""Saving in one step: a target shows its old rows until the new ones are whole.

A target is a folder with a folder of rows for each version and a folder of records, numbered from 0. A version counts
once its record is there, and the record is made by an operation that fails if its name is taken. So a writer that is
killed changes nothing that readers see, and of two writers that began from the same version one is refused.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_RECORDS, _ROWS = "_commits", "rows-"


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and a function that gives names below it."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = name(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(root)
    return system, lambda *below: name("/".join([root.toString(), *below]))


def _numbers(system, at) -> list[int]:
    """Numbers of the records, those included whose writer has not finished them."""
    records = at(_RECORDS)
    names = [x.getPath().getName() for x in system.listStatus(records)] if system.exists(records) else []
    return sorted(int(n) for n in names if n.isdigit())


def _record(spark: SparkSession, system, at, number: int) -> str | None:
    """The folder that a record names; None while its line isn't whole."""
    stream = system.open(at(_RECORDS, f"{number:08d}"))
    try:
        line = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return line[:-1] if line.endswith("\n") else None


def _claim(spark: SparkSession, system, at, number: int, folder: str) -> bool:
    """Makes the record, or says that another writer has."""
    system.mkdirs(at(_RECORDS))
    record, line = at(_RECORDS, f"{number:08d}"), (folder + "\n").encode()
    if system.getScheme() == "file":
        # Hadoop's local file system looks first and creates then, which two writers could both pass.
        try:
            made = os.open(record.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(made, "wb") as out:
            out.write(line)
        return True
    try:
        out = system.create(record, False)
    except Exception:
        if system.exists(record):
            return False
        raise
    out.write(line)
    out.close()
    return True


def _latest(spark: SparkSession, system, at) -> str | None:
    found = (_record(spark, system, at, n) for n in reversed(_numbers(system, at)))
    return next((folder for folder in found if folder), None)


def save_version(spark: SparkSession, path: str, overwrite: bool, write: Callable[[str], None]) -> None:
    """``write`` gets a folder of its own; when it is done, that folder becomes the target's rows.

    Without ``overwrite`` anything at ``path`` is an error (AnalysisException), as it is if another writer was quicker;
    either leaves what is there. Rows of a version that was replaced stay for its readers until ``tidy``. The file
    system must refuse to create what is there, as HDFS and local ones do.
    """
    system, at = _hadoop(spark, path)
    numbers = _numbers(system, at)
    if not overwrite and system.exists(at()):
        raise AnalysisException(f"{path} is there already")
    folder = _ROWS + uuid.uuid4().hex
    try:
        write(at(folder).toString())
        won = _claim(spark, system, at, numbers[-1] + 1 if numbers else 0, folder)
    except BaseException:
        system.delete(at(folder), True)
        raise
    if not won:
        system.delete(at(folder), True)
        raise AnalysisException(f"{path} was written by another meanwhile")


def saved_folder(spark: SparkSession, path: str) -> str:
    """The folder of the rows that a target shows now."""
    system, at = _hadoop(spark, path)
    folder = _latest(spark, system, at)
    if folder is None:
        raise AnalysisException(f"{path} holds nothing saved")
    return at(folder).toString()


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(saved_folder(spark, path))


def tidy(spark: SparkSession, path: str, hours: float = 24) -> list[str]:
    """Removes rows that no reader needs, those of replaced versions and of killed writers, once they are ``hours`` old;
    returns the folders' names. What is younger may belong to a writer or a reader at work."""
    system, at = _hadoop(spark, path)
    shown = _latest(spark, system, at)
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    old = [x.getPath().getName() for x in system.listStatus(at()) if x.getModificationTime() <= now - hours * 3_600_000]
    gone = sorted(n for n in old if n.startswith(_ROWS) and n != shown)
    for folder in gone:
        system.delete(at(folder), True)
    return gone
