"""Ledger queries: ``events`` stands for the cost ledger."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import costs
from ..sources import readers, writers
from .tables import table

AS_OF = datetime.date(2024, 1, 30)
RATES = {"purchase": (3.0, 15.0), "click": (1.0, 5.0)}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the ledger's schema: type is operation and model, user the request, value the cost."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("request_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_time"), "ts",
        F.col("event_type").alias("model"), F.col("event_type").alias("operation"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 97).alias("output_tokens"), F.col("value").alias("cost_usd"),
    )


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def by_operation(spark, sf_dir):
    return rounded(costs.by_operation(ledger(spark, sf_dir)), 2, "cost_usd").drop("first_pos")


def by_period(spark, sf_dir):
    return rounded(costs.by_period(ledger(spark, sf_dir), AS_OF, F.to_date("ts")), 2, "today_cost", "week_cost", "all_cost")


def by_request(spark, sf_dir):
    out = costs.by_request(ledger(spark, sf_dir), 50).withColumn("operations", F.array_join("operations", ","))
    return rounded(out, 2, "cost_usd").drop("first_pos")


def top_calls(spark, sf_dir):
    return costs.dearest(ledger(spark, sf_dir)).select("event_id", "operation", "cost_usd")


def priced(spark, sf_dir):
    rows = costs.priced(ledger(spark, sf_dir).drop("cost_usd"), costs.pricing(spark, RATES))
    return rounded(rows.groupBy("model").agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls")), 6, "cost_usd")


def csv_rows(spark, sf_dir):
    whole = ledger(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("user_id", "school_id", "thread_id", "tier")})
    return writers.ledger_csv(whole.withColumn("cost_usd", F.format_string("%.2f", "cost_usd")))


def json_lines(spark, sf_dir):
    """The ledger as lines, errors cut short and signups blank: only whole lines come back."""
    e = ledger(spark, sf_dir)
    line = F.when(F.col("operation") == "error", "{broken").when(F.col("operation") == "signup", "  ").otherwise(F.to_json(F.struct("event_id", "operation", "input_tokens", "cost_usd")))
    rows = readers.ledger_lines(e.select(line.alias("value")))
    return rounded(rows.groupBy("operation").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("cost_usd").alias("cost_usd")), 2, "cost_usd")


QUERIES = {
    "ledger_by_operation": by_operation, "ledger_by_period": by_period, "ledger_by_request_recent50": by_request, "ledger_top10_calls": top_calls,
    "ledger_priced_cost": priced, "ledger_csv": csv_rows, "ledger_json_lines": json_lines,
}
SQL = {
    "ledger_by_operation": "SELECT event_type AS operation, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 97) AS BIGINT) AS output_tokens, round(sum(value), 2) AS cost_usd FROM events GROUP BY event_type",
    "ledger_by_period": """
        SELECT round(coalesce(sum(value) FILTER (CAST(ts AS DATE) = DATE '2024-01-30'), 0), 2) AS today_cost, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-30') AS today_calls,
               round(coalesce(sum(value) FILTER (CAST(ts AS DATE) >= DATE '2024-01-24'), 0), 2) AS week_cost, count(*) FILTER (CAST(ts AS DATE) >= DATE '2024-01-24') AS week_calls,
               round(sum(value), 2) AS all_cost, count(*) AS all_calls FROM events""",
    "ledger_by_request_recent50": """
        WITH op AS (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY ALL),
        ops AS (SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS operations FROM op GROUP BY user_id)
        SELECT CAST(e.user_id AS VARCHAR) AS request_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS earliest, any_value(operations) AS operations, count(*) AS calls,
               CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 97) AS BIGINT) AS output_tokens, round(sum(value), 2) AS cost_usd
        FROM events e JOIN ops USING (user_id) GROUP BY e.user_id ORDER BY earliest DESC, min(event_id) LIMIT 50""",
    "ledger_top10_calls": "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS operation, value AS cost_usd FROM events ORDER BY value DESC, events.event_id LIMIT 10",
    "ledger_priced_cost": """
        SELECT event_type AS model, round(sum(CASE event_type WHEN 'purchase' THEN ((event_id % 1000) * 3.0 + (event_id % 97) * 15.0) / 1e6 WHEN 'click' THEN ((event_id % 1000) * 1.0 + (event_id % 97) * 5.0) / 1e6 ELSE 0 END), 6) AS cost_usd, count(*) AS calls
        FROM events GROUP BY event_type""",
    "ledger_csv": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS request_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS event_time, '' AS user_id, '' AS school_id, '' AS thread_id, event_type AS model, '' AS tier, event_type AS operation,
               CAST(event_id % 1000 AS VARCHAR) AS input_tokens, CAST(event_id % 97 AS VARCHAR) AS output_tokens, printf('%.2f', value) AS cost_usd FROM events""",
    "ledger_json_lines": "SELECT event_type AS operation, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, round(sum(value), 2) AS cost_usd FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY event_type",
}
