"""Writers. Stores are replaced as a whole: as a new version (``versions``), or as a folder that takes the old one's name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas, versions
from .readers import exists, json_document


def replace(df: DataFrame, path: str, form: str = "json") -> None:
    """Readers that come before or after see the old rows or the new ones; a failed write or rename leaves the old ones.

    The new folder is written beside the old one; the old one is moved aside and deleted only when the new one has its
    name.  After a crash between the two renames the old rows are in ``<path>.<id>.old``, which ``recover`` puts back.
    """
    target, staged = path.rstrip("/"), f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.format(form).save(staged)
    spark, aside = df.sparkSession, f"{staged}.old"
    had = exists(spark, target)
    if had and not _rename(spark, target, aside):
        _delete(spark, staged)
        raise OSError(f"cannot move {target} aside")
    try:
        if not _rename(spark, staged, target):
            raise OSError(f"cannot rename {staged} to {target}")
    except Exception:
        if had:
            _rename(spark, aside, target)
        _delete(spark, staged)
        raise
    if had:
        _delete(spark, aside)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back the rows that a crashed ``replace`` left aside, where the store is missing; whether there were any."""
    target = path.rstrip("/")
    if exists(spark, target):
        return False
    files, hadoop_path = _files(spark, target)
    found = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}.*.old"))
    return bool(found) and _rename(spark, found[0].getPath().toString(), target)


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _rename(spark: SparkSession, old: str, new: str) -> bool:
    files, source = _files(spark, old)
    return files.rename(source, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new))


def _delete(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def write_deadlines(deadlines: DataFrame, header: DataFrame, path: str, generated_at: str, source_file: str) -> int:
    """The deadlines store: ``rows`` by bucket and the counts in ``header``, in one version, so that they always agree."""
    head = header.withColumns({"generated_at": F.lit(generated_at), "source_file": F.lit(source_file)}).coalesce(1)
    return versions.commit({"rows": deadlines.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id"), "header": head}, path)


def write_store(rows: DataFrame, path: str, name: str) -> int:
    """A store of documents, chunks, threads, content objects or summaries: a row each, ``pos`` the order of the store."""
    return versions.commit({name: rows}, path)


def append_ledger(calls: DataFrame, path: str) -> None:
    """Append priced calls as JSON lines; a call without request id gets one."""
    calls.withColumn("request_id", F.coalesce("request_id", F.expr("uuid()"))).select(*schemas.LEDGER_COLUMNS).write.mode("append").json(path)


def ledger_csv(ledger: DataFrame) -> DataFrame:
    """The twelve columns in their order, as text, '' for missing; other columns go."""
    return ledger.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in schemas.LEDGER_COLUMNS])


def write_ledger_csv(ledger: DataFrame, path: str) -> None:
    ledger_csv(ledger).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_overrides(overrides: DataFrame, path: str, comment: str | None = None) -> int:
    """The overrides store: an entry a row, in as many files as tasks write; a comment kept from the store before is carried on."""
    return versions.commit({"overrides": overrides.select("id", "edits", "dismissed", "edited_at", "manual_add")}, path, note={"_comment": comment} if comment is not None else None)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Parquet by course, so that retrieval for a course reads that folder only."""
    chunks.withColumn("course_id", F.col("metadata.course_id")).write.mode("overwrite").partitionBy("course_id").parquet(path)


def write_stamped(rows: DataFrame, folder: str, name: str, at: str) -> str:
    """A scan's rows as JSON under a name with its time (``2026-01-31T10:20:30``): scans stand side by side, a scan is never changed."""
    path = f"{folder.rstrip('/')}/{name}_{at[:10].replace('-', '')}_{at[11:19].replace(':', '')}.json"
    rows.write.json(path)
    return path


def write_text(lines: DataFrame, path: str) -> None:
    lines.select(F.regexp_replace("line", "\x1b\\[[0-9;]*m", "").alias("value")).write.mode("overwrite").text(path)


def read_comment(spark: SparkSession, path: str) -> str | None:
    """The comment of an overrides store, or of a JSON document of overrides."""
    if versions.is_store(spark, path):
        return versions.note(spark, path).get("_comment")
    row = json_document(spark, path, schemas.OVERRIDES).select("_comment").first()
    return row[0] if row else None
