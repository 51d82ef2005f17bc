"""Record quality, payload size and guarded Python functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobscope.functions.casts import try_double, try_ts
from jobscope.operators import quality, udfs
from jobscope.plans.registry import query
from jobscope.session import load

def rules() -> dict[str, Column]:
    return {
        "bad_amount": try_double(F.col("amount_txt")).isNull(),
        "bad_ts": try_ts(F.col("ts_txt")).isNull(),
    }


def as_text(events: DataFrame) -> DataFrame:
    """Every event with amount and time as text, some of it malformed or missing."""
    return events.selectExpr(
        "event_id",
        "CASE WHEN event_id % 90 = 0 THEN NULL WHEN event_id % 50 = 0 THEN 'not-a-number' "
        "ELSE CAST(event_id AS STRING) END AS amount_txt",
        "CASE WHEN event_id % 70 = 0 THEN 'not-a-timestamp' "
        "ELSE concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') END AS ts_txt",
    )


def text_events(spark: SparkSession, folder: str) -> DataFrame:
    return as_text(load(spark, folder, "events"))


MARKED_SQL = """
SELECT event_id,
       CASE WHEN event_id % 90 = 0 THEN NULL WHEN event_id % 50 = 0 THEN 'not-a-number'
            ELSE CAST(event_id AS VARCHAR) END AS amount_txt,
       CASE WHEN event_id % 70 = 0 THEN 'not-a-timestamp'
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS ts_txt,
       concat_ws(',', CASE WHEN event_id % 90 = 0 OR event_id % 50 = 0 THEN 'bad_amount' END,
                      CASE WHEN event_id % 70 = 0 THEN 'bad_ts' END) AS reasons,
       event_id % 90 = 0 OR event_id % 50 = 0 OR event_id % 70 = 0 AS is_bad
FROM events
"""


@query(MARKED_SQL)
def quarantine_split(spark: SparkSession, folder: str) -> DataFrame:
    marked = quality.quarantine(text_events(spark, folder), rules())
    return marked.withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""
    SELECT reason, count(*) AS row_count
    FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM ({MARKED_SQL}) WHERE is_bad)
    GROUP BY reason
    """
)
def quarantine_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return quality.reason_counts(quality.quarantine(text_events(spark, folder), rules()))


@query(f"SELECT event_id, amount_txt, ts_txt FROM ({MARKED_SQL}) WHERE NOT is_bad")
def valid_records(spark: SparkSession, folder: str) -> DataFrame:
    good, _ = quality.split_valid(text_events(spark, folder), rules())
    return good


@query(
    f"""
    SELECT event_id, amount_txt, ts_txt, reasons FROM ({MARKED_SQL})
    WHERE is_bad ORDER BY event_id LIMIT 20
    """
)
def bad_sample(spark: SparkSession, folder: str) -> DataFrame:
    marked = quality.quarantine(text_events(spark, folder), rules())
    return (
        quality.sample_bad(marked, "event_id", 20)
        .withColumn("reasons", F.array_join("reasons", ","))
        .drop("is_bad")
    )


@query(
    """
    SELECT 'amount_txt' AS column_name, 'double' AS target_type,
           count(*) FILTER (event_id % 90 = 0) AS null_in,
           count(*) FILTER (event_id % 90 <> 0 AND event_id % 50 = 0) AS cast_failed,
           count(*) FILTER (event_id % 90 <> 0 AND event_id % 50 <> 0) AS ok
    FROM events
    UNION ALL
    SELECT 'ts_txt', 'timestamp', 0, count(*) FILTER (event_id % 70 = 0),
           count(*) FILTER (event_id % 70 <> 0)
    FROM events
    """
)
def cast_audit(spark: SparkSession, folder: str) -> DataFrame:
    return quality.cast_audit(
        text_events(spark, folder), {"amount_txt": "double", "ts_txt": "timestamp"}
    )


@query(
    """
    SELECT 'amount_txt' AS column_name, 'double' AS expected_type, 'string' AS actual_type,
           'type_changed' AS status, count(*) FILTER (event_id % 90 = 0) AS null_in,
           count(*) FILTER (event_id % 90 <> 0 AND event_id % 50 = 0) AS cast_failed,
           count(*) FILTER (event_id % 90 <> 0 AND event_id % 50 <> 0) AS ok
    FROM events
    UNION ALL SELECT 'country', 'string', NULL, 'missing', NULL, NULL, NULL
    UNION ALL SELECT 'event_id', 'bigint', 'bigint', 'match', 0, 0, count(*) FROM events
    UNION ALL SELECT 'ts_txt', NULL, 'string', 'unexpected', NULL, NULL, NULL
    """
)
def schema_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Expected against actual fields, with the rows each change would lose."""
    expected = StructType.fromDDL("event_id bigint, amount_txt double, country string")
    return quality.schema_impact(text_events(spark, folder), expected)


@query(
    """
    SELECT source, count(*) AS row_count, sum(octet_length(encode(text)))::BIGINT AS payload_bytes,
           sum(octet_length(encode(text))) > 100000 AS over_limit
    FROM documents GROUP BY source
    """
)
def payload_budget(spark: SparkSession, folder: str) -> DataFrame:
    return quality.payload_budget(load(spark, folder, "documents"), "source", ["text"], 100_000)


@query(
    """
    SELECT event_id,
           CASE WHEN event_id % 9 <> 0 THEN (1000 // (event_id % 9)) END AS value,
           CASE WHEN event_id % 9 = 0
                THEN 'ZeroDivisionError: integer division or modulo by zero' END AS error
    FROM events
    """
)
def guarded_udf(spark: SparkSession, folder: str) -> DataFrame:
    share = udfs.guarded(lambda x: 1000 // int(x), "bigint")
    return (
        load(spark, folder, "events")
        .select("event_id", share(F.col("event_id") % 9).alias("r"))
        .select("event_id", "r.value", "r.error")
    )


@query("SELECT user_id, count(*) AS row_count FROM events GROUP BY user_id")
def partition_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per Arrow batch in Python, then one small shuffle of the partial counts."""

    def count_users(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.groupby("user_id").size().reset_index(name="part")

    users = load(spark, folder, "events").select("user_id")
    partial = udfs.per_partition(users, count_users, "user_id bigint, part bigint")
    return partial.groupBy("user_id").agg(F.sum("part").alias("row_count"))
