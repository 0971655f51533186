"""Readers: each gives a DataFrame; a missing path gives an empty one where the store tolerates that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas, versions


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(schema))


def json_document(spark: SparkSession, path: str, schema: str, tolerant: bool = True) -> DataFrame:
    """A whole-file JSON document; damaged files give no usable row, missing ones an empty frame if ``tolerant``."""
    if tolerant and not exists(spark, path):
        return empty(spark, schema)
    whole = spark.read.text(path, wholetext=True).where(F.try_parse_json("value").isNotNull())
    return whole.select(F.from_json("value", schema).alias("document")).select("document.*")


def courses(content: DataFrame) -> DataFrame:
    return content.select(F.posexplode("courses").alias("course_pos", "c")).select("course_pos", "c.course_id", "c.course_name", "c.course_url", "c.content_objects")


def content_objects(content: DataFrame) -> DataFrame:
    """One row per item; (course_pos, pos) is the order of the file."""
    rows = courses(content).select("course_pos", "course_id", "course_name", F.posexplode("content_objects").alias("pos", "item"))
    return rows.select("course_pos", "pos", "course_id", "course_name", *[F.col(f"item.{c.split()[0]}") for c in schemas.CONTENT_OBJECT.split(", ") if c.split()[0] not in ("course_id", "course_name")])


def content_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of a JSON document, or of a store, which has them as rows."""
    if versions.is_store(spark, path):
        return versions.read(spark, path, "content")
    return content_objects(json_document(spark, path, schemas.CONTENT, tolerant=False))


def course_names(content: DataFrame) -> DataFrame:
    """course_id -> course_name; of a repeated id the last one counts."""
    return courses(content).groupBy("course_id").agg(F.max_by("course_name", "course_pos").alias("course_name"))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, course_id, summary) of a store, or of a JSON object of texts; values that are not text are left out.

    A store may keep such values as JSON in ``value``, beside ``summary``.
    """
    if versions.is_store(spark, path):
        return versions.read(spark, path, "summaries").where("summary is not null").select("pos", "course_id", "summary")
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    rows = raw.select(F.expr("cast(v as map<string, variant>)").alias("m")).select(F.posexplode("m").alias("pos", "course_id", "value"))
    return rows.where(F.schema_of_variant("value") == "STRING").select("pos", "course_id", F.expr("cast(value as string)").alias("summary"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "documents", schemas.DOCUMENT)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "chunks", schemas.CHUNK)


def threads(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "threads", schemas.THREAD)


def _listed(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Rows of a store, or of the list under one top-level key of a JSON document, with their order as ``pos``."""
    if versions.is_store(spark, path):
        return versions.read(spark, path, key)
    inner = T.StructType().add(key, T.ArrayType(T.StructType.fromDDL(schema)))
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("pos", T.IntegerType()), *T.StructType.fromDDL(schema).fields]))
    rows = spark.read.schema(inner).option("multiLine", True).json(path)
    return rows.select(F.posexplode(key).alias("pos", "row")).select("pos", "row.*")


def memory_enabled(spark: SparkSession, path: str) -> bool:
    """The one setting of the chat store; on unless switched off."""
    schema = "settings struct<memory_enabled: boolean>"
    found = json_document(spark, path, schema).select("settings.memory_enabled").first()
    return found is None or found[0] is not False


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(id, edits, dismissed, edited_at, manual_add), edits in their order of entry."""
    if not exists(spark, path):
        return empty(spark, schemas.OVERRIDE_ROWS)
    if versions.is_store(spark, path):
        return versions.read(spark, path, "overrides")
    return override_rows(json_document(spark, path, schemas.OVERRIDES))


def deadlines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Rows and header of the deadlines store, of one version; None where there is none."""
    return (versions.read(spark, path, "rows"), versions.read(spark, path, "header")) if versions.current(spark, path) else None


def override_rows(stored: DataFrame) -> DataFrame:
    rows = stored.select(F.explode("overrides").alias("id", "o"))
    edits = F.transform(F.map_entries("o.edits"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select("id", F.coalesce(edits, F.array().cast("array<struct<field: string, value: string>>")).alias("edits"), flag("o.dismissed").alias("dismissed"), "o.edited_at", flag("o.manual_add").alias("manual_add"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped whatever columns are asked for."""
    if not exists(spark, path):
        return empty(spark, schemas.LEDGER)
    return ledger_lines(spark.read.text(path))


def ledger_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    good = lines.where(F.col(line).rlike(r"\S") & F.try_parse_json(line).isNotNull())
    return good.select(F.from_json(line, schemas.LEDGER).alias("r")).select("r.*")


def semester(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, schemas.SEMESTER)


def semester_window(config: DataFrame) -> tuple[Column, Column]:
    """Start and end of the default term as literals; null when unknown, which disables the window test."""
    row = config.select(F.try_to_date("default.semester_start"), F.try_to_date("default.semester_end")).first()
    start, end = row if row and None not in row else (None, None)
    return F.lit(start).cast("date"), F.lit(end).cast("date")


def semester_anchor(config: DataFrame, course_ids: DataFrame) -> DataFrame:
    """(course_id, anchor): the course's own term, else the default one."""
    own = config.select(F.explode("courses").alias("course_id", "own"))
    default = config.select(F.col("default"))  # one row
    return course_ids.join(own, "course_id", "left").join(F.broadcast(default)).select("course_id", F.coalesce("own", "default").alias("anchor"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of raw files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def newest(found: DataFrame, keep_old: bool = False) -> DataFrame:
    """The most recent file; ``*.OLD.json`` is left out unless ``keep_old``."""
    rows = found if keep_old else found.where(~F.col("path").endswith(".OLD.json"))
    return rows.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def paired(path: Column | str) -> Column:
    """``paired_path`` of a column of paths."""
    return F.regexp_replace(path, r"(^|/)preprocessed_([^/]*)$", "$1$2")


def paired_path(path: str) -> str:
    """Of a preprocessed summary file, the content file it was made from."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/{name.removeprefix('preprocessed_')}" if folder else name.removeprefix("preprocessed_")


def fresh(found: DataFrame, cache: str, source: str) -> bool:
    """Whether a cache file is at least as new as its source; both by the tail of their path."""
    times = found.select("path", "modificationTime")
    row = times.agg(F.max(F.when(F.col("path").endswith(cache), F.col("modificationTime"))), F.max(F.when(F.col("path").endswith(source), F.col("modificationTime")))).first()
    return row[0] is not None and row[1] is not None and row[0] >= row[1]
