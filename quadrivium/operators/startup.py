"""The start of the application as a graph of stores: each is rebuilt only when something it is made from has changed.

A store is kept as versions (``sources.versions``), and a version notes of what
it was made: of a store the version, of files their number, bytes and newest
time.  A store is fresh if the notes of its current version are what there is
now.  Stores are looked at in the order of their needs, so what depends on a
rebuilt store is rebuilt in its turn, and nothing else is.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from ..sources import versions

Build = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Store:
    """``build`` gets the tables of ``needs`` by name; ``settings``, a text, makes versions of other settings stale."""

    name: str
    needs: tuple[str, ...]
    build: Build
    settings: str = ""


def state_of_files(spark: SparkSession, path: str) -> str:
    """Number, bytes and newest time of the files under a path: read from their directory entries."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return "none"
    n = size = newest = 0
    each = files.listFiles(target, True)
    while each.hasNext():
        status = each.next()
        n, size, newest = n + 1, size + status.getLen(), max(newest, status.getModificationTime())
    return f"{n} files, {size} bytes, {newest}"


def refresh(spark: SparkSession, folder: str, sources: Mapping[str, tuple[str, DataFrame]], stores: Sequence[Store]) -> list[tuple[str, bool, str, int]]:
    """Bring all stores up to date; (store, rebuilt, reason, version) in the order they were looked at.

    ``sources``: of every table that is no store the path whose files tell its state, and the table.  A build that
    fails leaves the version there was.  A cycle of needs and a name that is nothing are errors.
    """
    by_name, done = {s.name: s for s in stores}, []
    unknown = {n for s in stores for n in s.needs} - by_name.keys() - sources.keys()
    if unknown:
        raise ValueError(f"no store and no source: {sorted(unknown)}")
    state = {name: state_of_files(spark, path) for name, (path, _) in sources.items()}
    for name in TopologicalSorter({s.name: [n for n in s.needs if n in by_name] for s in stores}).static_order():
        store, path = by_name[name], f"{folder.rstrip('/')}/{name}"
        made_of = {n: state[n] for n in store.needs} | {"settings": store.settings}
        found = versions.current(spark, path)
        noted = json.loads(found[1]["note"]["made_of"]) if found else {}
        changed = sorted(n for n in made_of if noted.get(n) != made_of[n])
        if found and not changed:
            reason, number = "fresh", found[0]
        else:
            tables = {n: sources[n][1] if n in sources else versions.read(spark, f"{folder.rstrip('/')}/{n}", "rows") for n in store.needs}
            number = versions.commit({"rows": store.build(tables)}, path, note={"made_of": json.dumps(made_of)})
            reason = f"changed: {', '.join(changed)}" if found else "missing"
        state[name] = f"version {number}"
        done.append((name, reason != "fresh", reason, number))
    return done


def store(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return versions.read(spark, f"{folder.rstrip('/')}/{name}", "rows")


def load_or_build(spark: SparkSession, folder: str, name: str, source: str, rows: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A store made from one source: as it is where the source has not changed since, else built anew."""
    refresh(spark, folder, {"source": (source, rows)}, [Store(name, ("source",), lambda t: build(t["source"]))])
    return store(spark, folder, name)


def report(spark: SparkSession, done: Sequence[tuple[str, bool, str, int]]) -> DataFrame:
    return spark.createDataFrame(list(done), "store string, rebuilt boolean, reason string, version int")


def upload_jobs(events: DataFrame) -> DataFrame:
    """Jobs as their latest event says: (id, status, filename, doc_id, error, created_at) from (id, seq, status, ...).

    A job begins as processing and ends ready or failed; what an event does not say stays as it was.
    """
    from pyspark.sql import functions as F

    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.groupBy("id").agg(last("status"), last("filename"), last("doc_id"), F.max_by("error", "seq").alias("error"), F.min("at").alias("created_at"))
