"""Values that depend on the rows before, for groups of any size.

A group's rows are dealt into segments by their place, a whole number, so that
one group with a third of all rows is spread over tasks.  What a segment does
to the value that is carried is found by an aggregation with map-side
combination; a window over the few segments of a group gives what each begins
with; and a window within each segment does the rest.  Segments follow from the
place alone, so a lost task is computed again with the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places to a segment; with places that are dense within a group, also the most rows of a group in one.
SEGMENT = 1 << 16


def segment(place: Column | str, width: int = SEGMENT) -> Column:
    return F.floor((F.col(place) if isinstance(place, str) else place) / width).cast("long")


def _met(rows: DataFrame, starts: DataFrame, keys: Sequence[str], what: Sequence[str]) -> DataFrame:
    """Rows with what their segment begins with, null for the first one; keys may be null."""
    known = starts.select(*[F.col(k).alias(f"__of_{k}") for k in (*keys, "__segment")], *what)
    same = F.lit(True)
    for k in (*keys, "__segment"):
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(known, same, "left").drop(*[f"__of_{k}" for k in (*keys, "__segment")])


def carried(rows: DataFrame, keys: Sequence[str], place: str, event: Column, name: str, width: int = SEGMENT) -> DataFrame:
    """Adds ``name``: the last non-null event before a row of its group, null where there is none.

    ``event`` should be a struct where null is to be carried as a value.
    """
    return carried_by(rows, keys, place, place, event, name, width)


def carried_by(rows: DataFrame, keys: Sequence[str], place: str, order: str, event: Column, name: str, width: int = SEGMENT) -> DataFrame:
    """``carried`` with rows of equal ``place`` told apart by ``order``, which must agree with ``place``."""
    rows = rows.withColumns({"__segment": segment(place, width), "__event": event})
    effects = rows.groupBy(*keys, "__segment").agg(F.max_by("__event", F.when(F.col("__event").isNotNull(), F.col(order))).alias("__effect"))
    earlier = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = effects.withColumn("__begin", F.last("__effect", ignorenulls=True).over(earlier)).where("__begin is not null")
    within = Window.partitionBy(*keys, "__segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = _met(rows, starts, keys, ["__begin"]).withColumn(name, F.coalesce(F.last("__event", ignorenulls=True).over(within), F.col("__begin")))
    return out.drop("__segment", "__event", "__begin")


def running(rows: DataFrame, keys: Sequence[str], place: str, value: Column, name: str, order: Sequence[str] = (), width: int = SEGMENT) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group up to and with this one, by place, then ``order``."""
    rows = rows.withColumns({"__segment": segment(place, width), "__value": value})
    sums = rows.groupBy(*keys, "__segment").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__begin", F.sum("__sum").over(earlier)).where("__begin is not null and __begin <> 0")
    within = Window.partitionBy(*keys, "__segment").orderBy(place, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _met(rows, starts, keys, ["__begin"]).withColumn(name, F.sum("__value").over(within) + F.coalesce("__begin", F.lit(0)))
    return out.drop("__segment", "__value", "__begin")


def numbered(rows: DataFrame, keys: Sequence[str], place: str, name: str, order: Sequence[str] = (), width: int = SEGMENT) -> DataFrame:
    """Adds ``name``: how many rows of the group come before this one."""
    out = running(rows, keys, place, F.lit(1), name, order, width)
    return out.withColumn(name, F.col(name) - 1)
