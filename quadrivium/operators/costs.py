"""Cost ledger: pricing and the four roll-ups, each one aggregation."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled


def pricing(spark: SparkSession, rates: dict[str, tuple[float, float]]) -> DataFrame:
    """model -> price of a million input and output tokens."""
    return spark.createDataFrame([(m, float(i), float(o)) for m, (i, o) in rates.items()], "model string, in_rate double, out_rate double")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``cost_usd``; a model without a price costs 0. Spark broadcasts the prices if they are few, which it sees from their size."""
    cost = (F.col("input_tokens") * F.col("in_rate") + F.col("output_tokens") * F.col("out_rate")) / 1_000_000
    return calls.join(prices, "model", "left").withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("in_rate", "out_rate")


def own_date(event_time: str) -> Column:
    """The date as written, in the text's own offset; null unless the whole text is a time."""
    return F.when(F.try_to_timestamp(F.col(event_time)).isNotNull(), F.try_to_date(F.left(F.col(event_time), F.lit(10)), "yyyy-MM-dd"))


def by_period(ledger: DataFrame, as_of: datetime.date, day: Column | None = None) -> DataFrame:
    """One row: cost and calls today, in the last seven days (and later), and ever; undated calls only ever."""
    d = own_date("event_time") if day is None else day
    cost = F.coalesce("cost_usd", F.lit(0.0))
    today, week = F.coalesce(d == F.lit(as_of), F.lit(False)), F.coalesce(d >= F.lit(as_of - datetime.timedelta(days=6)), F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, cost)), F.lit(0.0))
    return ledger.agg(
        total(today).alias("today_cost"), F.count_if(today).alias("today_calls"), total(week).alias("week_cost"), F.count_if(week).alias("week_calls"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("all_cost"), F.count("*").alias("all_calls"),
    )


def by_operation(ledger: DataFrame) -> DataFrame:
    """Calls, tokens and cost per operation ('untagged' for null or ''), dearest first, ties as first seen (``pos``)."""
    op = F.coalesce(filled("operation"), F.lit("untagged"))
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    out = ledger.groupBy(op.alias("operation")).agg(F.count("*").alias("calls"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"), F.min("pos").alias("first_pos"))
    return out.orderBy(F.desc("cost_usd"), "first_pos")


def by_request(ledger: DataFrame, limit: int | None = 50) -> DataFrame:
    """Per request ('unknown' for null or ''): earliest time, operations in first-seen order, sums; latest first.

    The earliest time is the least text, except that an empty time in the first row stays.
    Per (request, operation) sums come first, so that a request with very many calls combines before it is dealt.
    """
    request, op = F.coalesce(filled("request_id"), F.lit("unknown")), F.coalesce(filled("operation"), F.lit("untagged"))
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    parts = ledger.groupBy(request.alias("request_id"), op.alias("operation")).agg(
        F.min("pos").alias("pos"), F.min(F.struct("pos", F.coalesce("event_time", F.lit("")).alias("t"))).alias("first"), F.min(filled("event_time")).alias("least"),
        F.count("*").alias("calls"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"),
    )
    ops = F.transform(F.array_sort(F.collect_list(F.struct("pos", "operation"))), lambda x: x["operation"])
    first = F.min("first")["t"]
    out = parts.groupBy("request_id").agg(F.when(first == "", "").otherwise(F.min("least")).alias("earliest"), ops.alias("operations"), F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"), F.min("pos").alias("first_pos"))
    out = out.orderBy(F.desc("earliest"), "first_pos")
    return out if limit is None else out.limit(limit)


def dearest(ledger: DataFrame, limit: int = 10) -> DataFrame:
    return ledger.orderBy(F.desc(F.coalesce("cost_usd", F.lit(0.0))), "pos").limit(limit)
