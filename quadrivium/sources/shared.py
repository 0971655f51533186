"""Folders that all executors see, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest side, in bytes, that is broadcast after it was measured.
BROADCAST_BYTES = 32 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder: in the checkpoint folder, or where none is set below the warehouse; deleted at the end of the session.

    On a cluster a warehouse on a machine's own disk is no such folder, and an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"
        if root.partition(":")[0] in ("file", root) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is on a local disk")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a scratch folder: a lost executor costs a read, not the work before."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort at interpreter exit: the session may already be gone."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001
        pass
