"""Log lines and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators import logs
from jobscope.plans.registry import query
from jobscope.session import load
from jobscope.vocab import LOG_FILE_ORDER, SIGNAL_RULES, UNCLASSIFIED_SENTINEL

_PHRASES = [phrase for _, phrase in SIGNAL_RULES] + [UNCLASSIFIED_SENTINEL, "all is well"]
_N = len(_PHRASES) + 1  # the last kind of line holds two phrases


def log_lines(events: DataFrame) -> DataFrame:
    """Every event as a log line that holds a phrase in some case, none, or two of them."""
    phrases = F.array(*[F.lit(p) for p in _PHRASES])
    first = F.get(phrases, (F.col("event_id") % _N).cast("int"))
    both = F.lit(f"{_PHRASES[0]}; {_PHRASES[5]}")
    phrase = F.coalesce(first, both)
    shown = F.when(F.col("user_id") % 2 == 0, F.upper(phrase)).otherwise(phrase)
    return events.select(
        "event_id", "event_type", F.concat(F.lit("E "), shown, F.lit(" at 12")).alias("line")
    )


_RULE_ROWS = ", ".join(f"('{c}', '{p}')" for c, p in SIGNAL_RULES)
LINES_SQL = (
    "SELECT event_id, event_type, user_id, 'E ' || coalesce(["
    + ", ".join(f"'{p}'" for p in _PHRASES)
    + f"][event_id % {_N} + 1], '{_PHRASES[0]}; {_PHRASES[5]}') || ' at 12' AS raw FROM events"
)


@query(
    f"""
    SELECT event_id, category, phrase
    FROM ({LINES_SQL}) JOIN (VALUES {_RULE_ROWS}) r(category, phrase)
      ON contains(lower(raw), lower(phrase))
    """
)
def log_signals(spark: SparkSession, folder: str) -> DataFrame:
    lines = log_lines(load(spark, folder, "events"))
    return logs.scan_signals(lines).select("event_id", "category", "phrase")


_FILES = ", ".join(f"'{n}'" for n in LOG_FILE_ORDER)


@query(
    """
    SELECT user_id AS run_id,
           arg_min('application_' || event_id || '_7', (event_id // 3 % 9) * 1000000000 + event_id)
             AS application_id
    FROM events WHERE event_id % 3 = 0 AND event_id // 3 % 9 < 8 GROUP BY user_id
    """
)
def application_id(spark: SparkSession, folder: str) -> DataFrame:
    """Files in search order by event; one in nine files is not a log file."""
    lines = load(spark, folder, "events").selectExpr(
        "user_id AS run_id",
        f"elt(event_id div 3 % 9 + 1, {_FILES}, 'trace.txt') AS file_name",
        "event_id AS line_no",
        "CASE event_id % 3 WHEN 0 THEN concat('up application_', event_id, '_7 application_1_2') "
        "WHEN 1 THEN 'application_x' ELSE 'nothing' END AS line",
    )
    return logs.application_ids(lines)


def ready_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as runs of three runtimes."""
    return load(spark, folder, "orders").selectExpr(
        "o_orderkey AS run_id",
        "elt(o_orderkey % 3 + 1, 'emr_ec2', 'emr_serverless', 'emr_eks') AS runtime",
        "elt(o_orderkey % 4 + 1, 'failed', 'success', 'running', 'failed') AS expected_outcome",
        "if(o_orderkey % 2 = 0, 'cluster', 'client') AS deploy_mode",
        "if(o_orderkey % 31 = 0, '', 's3n://logs/') AS log_uri",
        "'us-east-1' AS region",
        "concat('j-', o_orderkey % 97) AS cluster_id",
        "concat('s-', o_orderkey) AS step_id",
        "if(o_orderkey % 5 = 0, NULL, concat('a-', o_orderkey)) AS application_id",
        "concat('sa-', o_orderkey % 89) AS serverless_application_id",
        "concat('jr-', o_orderkey) AS job_run_id",
        "if(o_custkey % 2 = 0, 'lg', NULL) AS cloudwatch_log_group",
        "'/pre/' AS cloudwatch_log_stream_prefix",
    )


@query(
    """
    WITH f AS (
      SELECT l_orderkey AS k,
             bool_or(l_linenumber % 3 = 0 AND l_returnflag <> 'N') AS step,
             bool_or(l_linenumber % 3 = 1 AND l_returnflag = 'A') AS app,
             bool_or(l_linenumber % 3 = 2 AND l_returnflag <> 'R') AS job,
             bool_or(l_linenumber % 2 = 0 AND l_suppkey % 2 = 0) AS stream
      FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS run_id,
      CASE WHEN o_orderkey % 3 = 2 OR o_orderkey % 4 = 2 THEN 'not_checked'
           WHEN o_orderkey % 3 = 0 AND o_orderkey % 31 = 0 THEN 'not_checked'
           WHEN o_orderkey % 3 = 0 THEN
             CASE WHEN coalesce(step, false) AND
                       (NOT (o_orderkey % 2 = 0 AND o_orderkey % 4 IN (0, 3))
                        OR (o_orderkey % 5 <> 0 AND coalesce(app, false)))
                  THEN 'ready' ELSE 'waiting' END
           WHEN (o_orderkey % 31 <> 0 AND coalesce(job, false))
             OR (o_custkey % 2 = 0 AND coalesce(stream, false)) THEN 'ready'
           ELSE 'waiting' END AS logs
    FROM orders LEFT JOIN f ON k = o_orderkey
    """
)
def log_readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as listed files and log streams of their order."""
    files = load(spark, folder, "lineitem")
    listing = files.selectExpr(
        "elt(l_linenumber % 3 + 1, concat('s3://logs/j-', l_orderkey % 97, '/steps/s-', "
        "l_orderkey, '/'), "
        "concat('s3a://logs/j-', l_orderkey % 97, '/containers/a-', l_orderkey, '/'), "
        "concat('s3://logs/applications/sa-', l_orderkey % 89, '/jobs/jr-', l_orderkey, '/')) "
        "AS prefix",
        "concat('2026-01-01 00:00:00  99 x/', elt(l_linenumber % 3 + 1, "
        "CASE l_returnflag WHEN 'N' THEN 'note' ELSE 'controller.gz' END, "
        "CASE l_returnflag WHEN 'A' THEN 'stdout' WHEN 'N' THEN 'controller' ELSE 'n' END, "
        "CASE l_returnflag WHEN 'R' THEN 'syslog' ELSE 'job-metadata.log' END)) AS line",
    )
    streams = files.selectExpr(
        "'lg' AS log_group",
        "concat(if(l_linenumber % 2 = 0 AND l_suppkey % 2 = 0, 'pre', 'other'), "
        "'/applications/sa-', l_orderkey % 89, '/jobs/jr-', l_orderkey, '/driver/', l_linenumber) "
        "AS stream",
    )
    return logs.log_readiness(ready_runs(spark, folder), listing, streams).select("run_id", "logs")


@query(
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """
)
def orders_without_logs(spark: SparkSession, folder: str) -> DataFrame:
    runs = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return logs.runs_without_logs(runs, lines, "o_orderkey")
