"""Bounded, deterministic samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, label: str, id_col: str, train: Column, bound: int) -> DataFrame:
    """At most about ``bound`` training labels, chosen by a hash of the id.

    One row per id (the largest label where an id is labelled twice); null ids
    and null labels are left out.  The expected sample is ``bound`` rows when
    more exist; the hash threshold keeps it within a few standard deviations,
    so the result may be broadcast.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & train).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("double").alias("y"))
    have = rows.count()
    if have > bound:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int((1 << 30) * bound / have))
    return rows


def with_text(documents: DataFrame, sample: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, text, y) of the sampled documents, one row per id: of an id with several texts the least one.

    The sample side is bounded and broadcast; the bound on labels is one on rows, however often an id repeats.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = docs.join(F.broadcast(sample), "id")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():  # a scan of ids alone
        rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return rows
