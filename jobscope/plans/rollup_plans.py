"""Event summaries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.casts import event_date
from jobscope.operators import distincts, rollups
from jobscope.plans.registry import query
from jobscope.session import load, scratch
from jobscope.sources.generators import synth_events
from jobscope.vocab import COUNTRIES, EVENT_TYPES


def dated_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table under the names the roll-ups use."""
    return load(spark, folder, "events").select(
        event_date(F.col("ts")).alias("event_date"),
        "event_type",
        F.col("user_id").alias("customer_id"),
        F.col("value").alias("amount"),
    )


DAILY_SQL = """
WITH cents AS (
  SELECT CAST(ts AS DATE) AS event_date, event_type, user_id,
         CAST(round(value * 100) AS BIGINT) AS c
  FROM events),
sums AS (
  SELECT event_date, event_type, count(*) AS event_count,
         count(DISTINCT user_id) AS unique_customers,
         CAST(sum(c) AS BIGINT) AS s, count(c) AS n
  FROM cents GROUP BY event_date, event_type)
SELECT event_date, event_type, event_count, unique_customers,
       CAST(s AS DOUBLE) / 100 AS net_amount,
       CAST((2 * s + n) // (2 * n) AS DOUBLE) / 100 AS average_amount
FROM sums
"""

TYPE_SQL = """
SELECT event_type, count(*) AS event_count,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS net_amount
FROM events GROUP BY event_type
"""


@query(DAILY_SQL)
def daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.daily(dated_events(spark, folder), ["event_type"])


@query(TYPE_SQL)
def type_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.by_type(dated_events(spark, folder))


@query(
    f"""
    SELECT 'daily' AS summary, event_date, event_type AS name, event_count, unique_customers,
           net_amount, average_amount
    FROM ({DAILY_SQL})
    UNION ALL
    SELECT 'type', NULL, event_type, event_count, NULL, net_amount, NULL FROM ({TYPE_SQL})
    """
)
def one_pass_summaries(spark: SparkSession, folder: str) -> DataFrame:
    events = dated_events(spark, folder).withColumn("category", F.col("event_type"))
    combined = rollups.both(events, "category")
    daily = rollups.daily_part(combined, "category").withColumnRenamed("category", "name")
    types = rollups.type_part(combined).withColumnRenamed("event_type", "name")
    return daily.withColumn("summary", F.lit("daily")).unionByName(
        types.withColumn("summary", F.lit("type")), allowMissingColumns=True
    )


@query(
    """
    WITH cents AS (
      SELECT CAST(ts AS DATE) AS event_date, CASE WHEN event_id % 10 > 0 THEN event_type END AS category, user_id,
             CAST(round(value * 100) AS BIGINT) AS c
      FROM events),
    sums AS (
      SELECT event_date, category, CAST(grouping(event_date) + grouping(category) AS INTEGER) AS level,
             count(*) AS event_count, count(DISTINCT user_id) AS unique_customers,
             CAST(sum(c) AS BIGINT) AS s, count(c) AS n
      FROM cents GROUP BY ROLLUP (event_date, category))
    SELECT event_date, category, level, event_count, unique_customers, CAST(s AS DOUBLE) / 100 AS net_amount,
           CAST((2 * s + n) // (2 * n) AS DOUBLE) / 100 AS average_amount
    FROM sums
    """
)
def event_subtotals(spark: SparkSession, folder: str) -> DataFrame:
    """Days, and types of which every tenth event has none."""
    events = load(spark, folder, "events").select(
        event_date(F.col("ts")).alias("event_date"),
        F.when(F.col("event_id") % 10 > 0, F.col("event_type")).alias("category"),
        F.col("user_id").alias("customer_id"),
        F.col("value").alias("amount"),
    )
    return rollups.subtotals(events, ["event_date", "category"])


@query(
    """
    SELECT event_type, count(*) AS event_count, count(DISTINCT user_id) AS unique_customers, true AS sketch_is_close
    FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY event_type
    """
)
def customers_of_two_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Two weeks of customers from stored daily sketches, beside the exact count of their events."""
    events = dated_events(spark, folder)
    path = scratch(spark, "day-sketches")
    distincts.store_days(distincts.day_sketches(events, ["event_type"]), path)
    since, until = date(2024, 1, 8), date(2024, 1, 21)
    merged = distincts.merge_days(distincts.stored_days(spark, path), ["event_type"], since, until)
    exact = events.where(F.col("event_date").between(F.lit(since), F.lit(until))).groupBy("event_type").agg(
        F.count_distinct("customer_id").alias("unique_customers")
    )
    off = F.abs(F.col("about_customers") - F.col("unique_customers"))
    close = off <= F.greatest(F.lit(1), 5 * distincts.relative_error() * F.col("unique_customers"))
    return merged.join(exact, "event_type").select("event_type", "event_count", "unique_customers", close.alias("sketch_is_close"))


@query(f"SELECT *, 'run-0001' AS run_id FROM ({TYPE_SQL})")
def stamped_rounded(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.stamp(rollups.by_type(dated_events(spark, folder)), "run-0001")


@query(
    """
    SELECT 'event_type' AS column_name, v AS value,
           CAST((SELECT count(*) FROM events e WHERE e.event_type = v) AS BIGINT) AS row_count
    FROM (VALUES ('view'), ('click'), ('purchase'), ('refund')) t(v)
    """
)
def value_profile(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    return rollups.profile(events, {"event_type": ["view", "click", "purchase", "refund"]})


# The generator draws from the hex digits of md5(seed:id); any engine can redo that.
SYNTH_SQL = """
WITH h AS (
  SELECT event_id AS id, md5('20260527:' || CAST(event_id AS VARCHAR)) AS m FROM events),
d AS (
  SELECT id,
         CAST('0x' || substr(m, 1, 5) AS BIGINT) % 100 AS k,
         CAST('0x' || substr(m, 6, 6) AS BIGINT) AS a,
         CAST('0x' || substr(m, 12, 5) AS BIGINT) % 20161 AS t,
         CAST('0x' || substr(m, 17, 4) AS BIGINT) % 5 AS c,
         CAST('0x' || substr(m, 21, 12) AS BIGINT)
           % greatest(20, (SELECT count(*) FROM events) // 8) + 1 AS u
  FROM h)
SELECT 'evt-' || lpad(CAST(id AS VARCHAR), 8, '0') AS event_id,
       'cust-' || lpad(CAST(u AS VARCHAR), 6, '0') AS customer_id,
       CASE WHEN k < 52 THEN 'view' WHEN k < 77 THEN 'cart'
            WHEN k < 97 THEN 'purchase' ELSE 'refund' END AS event_type,
       CAST(CASE WHEN k < 52 THEN 0 WHEN k < 77 THEN 1000 + a % 24001
                 WHEN k < 97 THEN 1500 + a % 48501 ELSE -(500 + a % 19501) END AS DOUBLE) / 100
         AS amount,
       strftime(TIMESTAMP '2026-01-01' + to_minutes(t), '%Y-%m-%dT%H:%M:%SZ') AS event_ts,
       ['AU', 'US', 'GB', 'IN', 'SG'][c + 1] AS country
FROM d
"""


def generated(spark: SparkSession, folder: str) -> DataFrame:
    ids = load(spark, folder, "events").select(F.col("event_id").alias("id"))
    return synth_events(ids, ids.agg(F.count(F.lit(1))).scalar())


@query(SYNTH_SQL)
def synth_event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return generated(spark, folder)


@query(
    f"""
    WITH s AS ({SYNTH_SQL})
    SELECT 'event_type' AS column_name, event_type AS value, count(*) AS row_count
    FROM s GROUP BY event_type
    UNION ALL
    SELECT 'country', country, count(*) FROM s GROUP BY country
    """
)
def synth_events_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.profile(
        generated(spark, folder), {"event_type": EVENT_TYPES, "country": COUNTRIES}
    )


@query(
    f"""
    WITH s AS ({SYNTH_SQL}),
    sums AS (
      SELECT CAST(substr(event_ts, 1, 10) AS DATE) AS event_date, country,
             count(*) AS event_count, count(DISTINCT customer_id) AS unique_customers,
             CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) AS t, count(*) AS n
      FROM s GROUP BY ALL)
    SELECT event_date, country, event_count, unique_customers,
           CAST(t AS DOUBLE) / 100 AS net_amount,
           CAST(CASE WHEN t < 0 THEN -((-2 * t + n) // (2 * n))
                     ELSE (2 * t + n) // (2 * n) END AS DOUBLE) / 100 AS average_amount
    FROM sums
    """
)
def country_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Signed amounts: refunds can make a group's sum negative."""
    return rollups.daily(rollups.with_event_date(generated(spark, folder)))
