"""Stores of versions: folders that are never changed once written, and a pointer that is written last.

A version has one or more tables, each a folder of many files, so no store
passes through one row or task.  Its number becomes the current one when its
pointer file is there and whole; a crash before leaves the version before, and
no reader sees tables of different versions.  A pointer is created only where
none of that number is, so of two writers that began from the same version one
gets ``Conflict`` and has changed nothing.  That needs of the file system that a
new file can be created exclusively, which HDFS and object stores with
conditional writes give; no rename is involved.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTERS = "_pointers"


class Conflict(Exception):
    """Another writer has committed since the version that this one was made from."""


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all pointers, whole or not, newest first."""
    files, at = _hadoop(spark, f"{path}/{POINTERS}")
    if not files.exists(at):
        return []
    return sorted((int(name) for status in files.listStatus(at) if (name := status.getPath().getName()).isdigit()), reverse=True)


def _pointer(spark: SparkSession, path: str, number: int) -> dict | None:
    """What a pointer says; None while it is being written or where its writer died."""
    files, at = _hadoop(spark, f"{path}/{POINTERS}/{number:010d}")
    try:
        stream = files.open(at)
        try:
            return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    except (ValueError, PySparkException):
        return None
    except Exception as error:  # a pointer may be removed between listing and reading
        if "FileNotFound" in str(error):
            return None
        raise


def is_store(spark: SparkSession, path: str) -> bool:
    files, at = _hadoop(spark, f"{path.rstrip('/')}/{POINTERS}")
    return files.exists(at)


def current(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """The number of the newest whole version and what its pointer says."""
    for number in _numbers(spark, path.rstrip("/")):
        if found := _pointer(spark, path.rstrip("/"), number):
            return number, found
    return None


def commit(tables: Mapping[str, DataFrame], path: str, made_from: int | None = None, note: Mapping[str, str] | None = None, form: str = "parquet") -> int:
    """Write the tables as the next version and make it current; its number.

    ``made_from``: the version that the tables were computed from (0: none); ``Conflict`` if it is not current any
    more.  ``note``: a few texts to be kept in the pointer.
    """
    spark, path = next(iter(tables.values())).sparkSession, path.rstrip("/")
    numbers, now = _numbers(spark, path), current(spark, path)
    if made_from is not None and (now[0] if now else 0) != made_from:
        raise Conflict(f"{path}: version {now[0] if now else 0} is current, not {made_from}")
    number, folder = (numbers[0] if numbers else 0) + 1, f"v{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.format(form).save(f"{path}/{folder}/{name}")
        said = {"folder": folder, "form": form, "note": dict(note or {}), "schemas": {name: df.schema.jsonValue() for name, df in tables.items()}}
        _point(spark, path, number, json.dumps(said))
    except Exception:
        files, at = _hadoop(spark, f"{path}/{folder}")
        files.delete(at, True)
        raise
    return number


def _point(spark: SparkSession, path: str, number: int, said: str) -> None:
    files, at = _hadoop(spark, f"{path}/{POINTERS}/{number:010d}")
    try:
        stream = files.create(at, False)
    except Exception as error:
        if "AlreadyExists" in str(error):
            raise Conflict(f"{path}: version {number} was committed meanwhile") from error
        raise
    try:
        stream.write(bytearray(said.encode("utf-8")))
    finally:
        stream.close()


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current version, with the schema it was written with."""
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path} has no version")
    said = found[1]
    return spark.read.schema(T.StructType.fromJson(said["schemas"][name])).format(said["form"]).load(f"{path.rstrip('/')}/{said['folder']}/{name}")


def note(spark: SparkSession, path: str) -> dict[str, str]:
    found = current(spark, path)
    return found[1]["note"] if found else {}


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` whole versions, and folders that no pointer names; how many folders went.

    Not to be run beside a writer: what it is writing has no pointer yet.
    """
    path = path.rstrip("/")
    whole = [(n, said) for n in _numbers(spark, path) if (said := _pointer(spark, path, n))]
    for number, _ in whole[keep:]:
        files, at = _hadoop(spark, f"{path}/{POINTERS}/{number:010d}")
        files.delete(at, False)
    kept = {said["folder"] for _, said in whole[:keep]}
    files, at = _hadoop(spark, path)
    gone = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("v") and s.getPath().getName() not in kept]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)
