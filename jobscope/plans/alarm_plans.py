"""Alarms over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators import alarms
from jobscope.plans.registry import query
from jobscope.session import load

SUM_SQL = """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS period_start,
       CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS total,
       count(*) FILTER (event_type = 'error') >= 1 AS in_alarm
FROM events GROUP BY 1
"""

# Every period of the month, breached or not; three in a row must breach.
IDLE_SQL = """
WITH p AS (
  SELECT time_bucket(INTERVAL '5 minutes', ts) AS t,
         CAST(min(CAST(value >= 50 AS INTEGER)) AS BIGINT) AS hit
  FROM events GROUP BY 1),
grid AS (
  SELECT unnest(generate_series((SELECT min(t) FROM p), (SELECT max(t) FROM p),
                                INTERVAL '5 minutes')) AS t),
streak AS (
  SELECT grid.t, sum(coalesce(hit, 0)) OVER (ORDER BY grid.t ROWS BETWEEN 2 PRECEDING
                                             AND CURRENT ROW) AS hits
  FROM grid LEFT JOIN p USING (t))
SELECT t AS period_start FROM streak WHERE hits = 3
"""


def is_error() -> Column:
    return F.when(F.col("event_type") == "error", 1).otherwise(0)


def is_high() -> Column:
    return F.when(F.col("value") >= 50, 1).otherwise(0)


@query(SUM_SQL)
def sum_alarm(spark: SparkSession, folder: str) -> DataFrame:
    metrics = load(spark, folder, "events").select("ts", is_error().alias("errors"))
    return alarms.sum_alarm(metrics, "ts", "errors")


@query(
    """
    SELECT time_bucket(INTERVAL '5 minutes', ts) AS period_start, user_id,
           CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS total,
           count(*) FILTER (event_type = 'error') >= 1 AS in_alarm
    FROM events GROUP BY 1, 2
    """
)
def keyed_sum_alarm(spark: SparkSession, folder: str) -> DataFrame:
    metrics = load(spark, folder, "events").select("ts", "user_id", is_error().alias("errors"))
    return alarms.sum_alarm(metrics, "ts", "errors", ["user_id"])


@query(IDLE_SQL)
def idle_alarm(spark: SparkSession, folder: str) -> DataFrame:
    metrics = load(spark, folder, "events").select("ts", is_high().alias("high"))
    return alarms.idle_alarm(metrics, "ts", "high")
