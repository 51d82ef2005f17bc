"""The streaming forms, run over the event files until all of them are read.

A period or run is reported once the watermark has passed it, so the SQL asks for what is
closed ten minutes before the last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators.logs import log_entries
from jobscope.operators.quality import quarantine
from jobscope.plans.alarm_plans import IDLE_SQL, SUM_SQL, is_error, is_high
from jobscope.plans.quality_plans import MARKED_SQL, as_text, rules
from jobscope.plans.registry import query
from jobscope.plans.run_plans import TEN_DAYS, TERMINAL_SQL, state_history
from jobscope.session import scratch
from jobscope.sources.files import stream_folder, stream_parquet
from jobscope.streaming.alarms import stream_idle_alarm as idle
from jobscope.streaming.alarms import stream_sum_alarm as total
from jobscope.streaming.readiness import stream_log_readiness as readiness
from jobscope.streaming.run_tracker import run_slots, terminal_states
from jobscope.streaming.sink import drain, drain_to

_WATERMARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream; a watermark needs an instant, not a local time."""
    return stream_parquet(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def local_start(df: DataFrame) -> DataFrame:
    return df.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query(f"SELECT * FROM ({SUM_SQL}) WHERE period_start + INTERVAL 5 MINUTE <= {_WATERMARK}")
def stream_sum_alarm(spark: SparkSession, folder: str) -> DataFrame:
    metrics = event_stream(spark, folder).select("ts", is_error().alias("errors"))
    return local_start(drain(spark, total(metrics, "ts", "errors"), "sum-alarm"))


@query(f"SELECT * FROM ({IDLE_SQL}) WHERE period_start + INTERVAL 5 MINUTE <= {_WATERMARK}")
def stream_idle_alarm(spark: SparkSession, folder: str) -> DataFrame:
    metrics = event_stream(spark, folder).select("ts", is_high().alias("high"))
    return local_start(drain(spark, idle(metrics, "ts", "high"), "idle-alarm"))


@query(MARKED_SQL)
def stream_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    marked = quarantine(as_text(stream_parquet(spark, folder, "events")), rules())
    stored = drain(spark, marked, "quarantine", ["is_bad"])
    return stored.withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""
    WITH runs AS MATERIALIZED ({TERMINAL_SQL}),
    slots AS MATERIALIZED (SELECT DISTINCT time_bucket(INTERVAL '5 minutes', ts) AS slot FROM events),
    closed AS MATERIALIZED (SELECT max(slot) AS slot FROM slots WHERE slot + INTERVAL 5 MINUTE <= {_WATERMARK})
    SELECT run_id, epoch_us(submitted_at) // 1000 AS submitted_ms,
           epoch_us(finished_at) // 1000 AS finished_ms,
           final_state
    FROM runs, closed WHERE coalesce(finished_at, deadline) <= closed.slot
    """
)
def stream_terminal_state(spark: SparkSession, folder: str) -> DataFrame:
    slots = run_slots(state_history(event_stream(spark, folder)))
    closed = stream_folder(spark, drain_to(slots, scratch(spark, "run-slots")), slots.schema)
    return drain(spark, terminal_states(closed, TEN_DAYS), "terminal-state")


@query(
    """
    WITH r AS (SELECT event_id AS k, ts FROM events WHERE event_id % 4 = 0),
    e AS (SELECT event_id, event_id - event_id % 4 AS k, ts AS seen, user_id FROM events WHERE event_id % 4 > 0),
    closed AS (SELECT least((SELECT max(ts) FROM r), (SELECT max(seen) FROM e)) - INTERVAL 10 MINUTE AS until),
    f AS (
      SELECT r.k, r.ts, coalesce(bool_or(event_id % 4 = 1 AND user_id % 5 > 0), false) AS step,
             coalesce(bool_or(event_id % 4 = 2), false) AS app,
             coalesce(bool_or(event_id % 4 = 1 AND user_id % 5 = 0), false) AS job,
             coalesce(bool_or(event_id % 4 = 3), false) AS stream
      FROM r LEFT JOIN e ON e.k = r.k AND seen BETWEEN r.ts AND r.ts + INTERVAL 5 DAY GROUP BY ALL)
    SELECT CAST(k AS VARCHAR) AS run_id, ts AS submitted_at,
           CASE WHEN k // 4 % 3 = 2 OR k // 4 % 7 = 6 THEN 'not_checked'
                WHEN k // 4 % 3 = 0 THEN CASE WHEN step AND (k // 4 % 2 = 1 OR app) THEN 'ready' ELSE 'waiting' END
                WHEN job OR stream THEN 'ready' ELSE 'waiting' END AS logs
    FROM f, closed WHERE ts + INTERVAL 5 DAY < until
    """
)
def stream_log_readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth event as a run, the three after it as its logs: five days to come in."""
    runs = event_stream(spark, folder).where("event_id % 4 = 0").selectExpr(
        "CAST(event_id AS STRING) AS run_id",
        "ts AS submitted_at",
        "elt(event_id div 4 % 3 + 1, 'emr_ec2', 'emr_serverless', 'emr_eks') AS runtime",
        "if(event_id div 4 % 7 = 6, 'running', 'failed') AS expected_outcome",
        "if(event_id div 4 % 2 = 0, 'cluster', 'client') AS deploy_mode",
        "'s3n://logs/' AS log_uri",
        "'us-east-1' AS region",
        "concat('j-', event_id % 97) AS cluster_id",
        "concat('s-', event_id) AS step_id",
        "concat('a-', event_id) AS application_id",
        "concat('sa-', event_id % 89) AS serverless_application_id",
        "concat('jr-', event_id) AS job_run_id",
        "'lg' AS cloudwatch_log_group",
        "'/pre/' AS cloudwatch_log_stream_prefix",
    )
    logs = event_stream(spark, folder).withColumn("run", F.expr("event_id - event_id % 4"))
    listing = logs.where("event_id % 4 IN (1, 2)").selectExpr(
        "ts AS seen_at",
        "CASE WHEN event_id % 4 = 2 THEN concat('s3a://logs/j-', run % 97, '/containers/a-', run, '/') "
        "WHEN user_id % 5 = 0 THEN concat('s3://logs/applications/sa-', run % 89, '/jobs/jr-', run, '/') "
        "ELSE concat('s3://logs/j-', run % 97, '/steps/s-', run, '/') END AS prefix",
        "concat('2026-01-01 00:00:00  99 x/', CASE WHEN event_id % 4 = 2 THEN 'stdout' "
        "WHEN user_id % 5 = 0 THEN 'job-metadata.log' ELSE 'controller.gz' END) AS line",
    )
    streams = logs.where("event_id % 4 = 3").selectExpr(
        "ts AS seen_at", "'lg' AS log_group",
        "concat('pre/applications/sa-', run % 89, '/jobs/jr-', run, '/driver/1') AS stream",
    )
    entries = log_entries(listing, streams, ["seen_at"])
    found = drain(spark, readiness(runs, entries, "5 days"), "log-readiness")
    return found.withColumn("submitted_at", F.col("submitted_at").cast("timestamp_ntz"))
