"""Shared plumbing of the training-data operators.

Every operator first projects the columns it needs, so extra or clashing
columns in a table never reach it.  Intermediate tables are written as Parquet
under the cluster's shared folder (``spark.checkpoint.dir``), which is what
lets a lost executor be replaced without recomputing the whole lineage.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest table, in bytes, that an operator broadcasts after measuring it.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.

    Where none is configured: in local mode a private temporary folder, on a
    cluster one below the warehouse; a warehouse on a machine's own disk is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="quadrivium-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"
            if root.partition(":")[0] in ("file", root):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is on a local disk")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quadrivium/{uuid.uuid4().hex}-{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort at interpreter exit: the session may already be gone."""
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001
        pass


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quadrivium_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df.quadrivium_path)


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Adds ``rank``, from 0, of every row of a key in an order; with ``total`` also ``before``, its sum over the earlier rows.

    ``order`` should end in a column that tells equal rows apart.  Rows are
    dealt by ranges of (keys, order), so a key with very many rows is spread
    over tasks; within a range rows are numbered, and each range of a key
    starts where the ranges before it end: a small table of (key, range).
    """
    spark = rows.sparkSession
    dealt = materialise(rows.repartitionByRange(partitions(spark), *keys, *order).withColumn("__range", F.spark_partition_id()), name)
    value = F.col(total) if total else F.lit(0)
    parts = dealt.groupBy(*keys, "__range").agg(F.count("*").alias("__n"), F.sum(value).alias("__t"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that go over a border of ranges need a start other than 0, at most two a range.
    starts = materialise(parts.withColumns({"__n0": F.sum("__n").over(earlier), "__t0": F.sum("__t").over(earlier)}).where("__n0 is not null").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__at"), "__n0", "__t0"), f"{name}-starts")
    same = F.col("__range") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = Window.partitionBy(*keys, "__range").orderBy(*order)
    sums = F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumns({"__i": F.row_number().over(within), "__s": sums}).join(small(starts, starts.count(), 64 * (len(keys) + 3)), same, "left")
    found = {"rank": (F.coalesce("__n0", F.lit(0)) + F.col("__i") - 1).cast("long")}
    if total:
        found["before"] = (F.coalesce("__t0", F.lit(0)) + F.coalesce("__s", F.lit(0))).cast("long")
    return out.select(*rows.columns, *[c.alias(n) for n, c in found.items()])


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint only for a side whose counted size is below ``BROADCAST_BYTES``."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: Rows of a batch that a Python worker is given in a pipeline stage: Spark's own 10,000 of long texts take much memory on both sides.
STAGE_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = STAGE_ROWS) -> Iterator[None]:
    """Within it, Python workers get batches of ``rows`` rows; the session's setting is as before after it.

    A plan takes the setting when it runs, so what is to be run so must be written within.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have, whatever the caller called its columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def hand_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and would keep the peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
