"""Sources and sinks: whole tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators import logs, quality, rollups, runs, task_metrics, validation
from jobscope.plans.finding_plans import FINDINGS_CTE, evaluated
from jobscope.plans.log_plans import _RULE_ROWS, LINES_SQL, log_lines
from jobscope.plans.quality_plans import rules, text_events
from jobscope.plans.registry import query
from jobscope.plans.rollup_plans import DAILY_SQL, TYPE_SQL, dated_events
from jobscope.session import load, scratch
from jobscope.sinks import files as sinks
from jobscope.sources import files as sources
from jobscope.vocab import LOG_FILE_ORDER


@query(
    """
    SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id,
           event_type, CASE WHEN event_id % 50 <> 0 THEN value END AS amount,
           strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_ts, 'AU' AS country,
           CAST(ts AS DATE) AS event_date
    FROM events
    """
)
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Typed CSV: a malformed amount comes back as NULL in a row that stays."""
    path = scratch(spark, "events-csv")
    load(spark, folder, "events").selectExpr(
        "event_id",
        "user_id AS customer_id",
        "event_type",
        "if(event_id % 50 = 0, 'not-a-number', cast(value AS STRING)) AS amount",
        "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') AS event_ts",
        "'AU' AS country",
    ).write.option("header", True).csv(path)
    events = rollups.with_event_date(sources.read_events_csv(spark, path))
    return events.drop("event_timestamp")


@query(
    """
    SELECT 'amount_txt' AS column_name, 'double' AS target_type,
           count(*) FILTER (event_id % 90 = 0) AS null_in,
           count(*) FILTER (event_id % 90 <> 0 AND event_id % 50 = 0) AS cast_failed,
           count(*) FILTER (event_id % 90 <> 0 AND event_id % 50 <> 0) AS ok
    FROM events
    UNION ALL SELECT 'event_id', 'bigint', 0, 0, count(*) FROM events
    """
)
def raw_csv_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Untyped CSV, audited after reading."""
    path = scratch(spark, "raw-csv")
    text_events(spark, folder).write.option("header", True).csv(path)
    raw = sources.read_raw_csv(spark, path)
    return quality.cast_audit(raw, {"amount_txt": "double", "event_id": "bigint"})


@query(DAILY_SQL)
def partitioned_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "daily")
    daily = rollups.daily(dated_events(spark, folder), ["event_type"])
    sinks.write_partitioned(daily, path, "event_date")
    return sources.read_parquet(spark, path)


@query(f"SELECT *, 'r1' AS run_id FROM ({TYPE_SQL})")
def write_once_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "once")
    summary = rollups.by_type(dated_events(spark, folder))
    sinks.write_once(summary, path, "new_run_prefix", run_id="r1")
    return sources.read_parquet(spark, path)


@query(TYPE_SQL)
def json_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "types-json")
    sinks.write_json(rollups.by_type(dated_events(spark, folder)), path)
    ddl = "event_type string, event_count bigint, net_amount double"
    return sources.read_docs(spark, path, ddl, one_per_file=False)


@query(
    """
    SELECT 'bad_amount' AS rule,
           count(*) FILTER (event_id % 90 = 0 OR event_id % 50 = 0) AS row_count FROM events
    UNION ALL SELECT 'bad_ts', count(*) FILTER (event_id % 70 = 0) FROM events
    """
)
def staged_validation(spark: SparkSession, folder: str) -> DataFrame:
    _, counts = sinks.stage_and_validate(
        text_events(spark, folder), scratch(spark, "staged"), rules()
    )
    return counts


@query(
    f"""
    WITH c AS (SELECT count(*) AS daily_rows FROM ({DAILY_SQL})),
         t AS (SELECT count(*) AS type_rows FROM ({TYPE_SQL})),
         i AS (SELECT count(*) AS input_rows FROM events)
    SELECT 'r1' AS run_id, input_rows, daily_rows, type_rows,
           '{{"daily_rows":' || daily_rows || ',"input_rows":' || input_rows ||
           ',"run_id":"r1","type_rows":' || type_rows || '}}' AS metrics
    FROM c, t, i
    """
)
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "metrics")
    events = dated_events(spark, folder)
    outputs = {
        "daily": rollups.daily(events, ["event_type"]),
        "type": rollups.by_type(events),
    }
    for name, df in outputs.items():
        sinks.write_parquet(df, sinks.child_path(path, name))
    stored = {n: sources.read_parquet(spark, sinks.child_path(path, n)) for n in outputs}
    return sinks.run_metrics(spark, "r1", stored["daily"], stored, F.sum("event_count"))


@query("SELECT o_orderstatus, count(*) AS row_count FROM orders GROUP BY o_orderstatus")
def catalog_scan(spark: SparkSession, folder: str) -> DataFrame:
    view = f"jobscope_orders_{uuid.uuid4().hex}"  # callers that share a session don't meet
    load(spark, folder, "orders").createOrReplaceTempView(view)
    orders = sources.read_table(spark, view)
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("row_count"))


@query("SELECT url AS value, count(*) AS row_count FROM pages GROUP BY url")
def line_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "lines")
    load(spark, folder, "pages").select("url").write.text(path)
    lines = sources.read_lines(spark, path)
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    f"""
    SELECT event_type AS run_id, category, count(*) AS row_count
    FROM ({LINES_SQL}) JOIN (VALUES {_RULE_ROWS}) r(category, phrase)
      ON contains(lower(raw), lower(phrase))
    GROUP BY ALL
    """
)
def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """Gzipped log files, one folder per run, scanned for signals."""
    path = scratch(spark, "logs")
    lines = log_lines(load(spark, folder, "events")).select("line", "event_type")
    lines.write.option("compression", "gzip").partitionBy("event_type").text(path)
    found = logs.scan_signals(sources.read_logs(spark, path))
    run = F.regexp_extract("file_path", "event_type=([^/]+)/", 1)
    return found.groupBy(run.alias("run_id"), "category").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    f"""
    WITH l AS (
      SELECT event_id, event_type, ['stdout', 'stderr', 'notes.txt'][event_id % 3 + 1] AS file,
             event_id % 2 AS part FROM events WHERE event_id % 5 <> 0)
    SELECT event_type AS run_id,
           arg_min('application_' || event_id || '_1',
                   list_position([{", ".join(f"'{n}'" for n in LOG_FILE_ORDER)}], file) * 10000000000000
                   + part * 1000000000000 + event_id) AS application_id
    FROM l WHERE file <> 'notes.txt' GROUP BY event_type
    """
)
def first_application_id(spark: SparkSession, folder: str) -> DataFrame:
    """Log files on disk: files of one name in two folders of a run, read in path order."""
    path = scratch(spark, "run-logs")
    lines = load(spark, folder, "events").selectExpr(
        "event_id",
        "event_type AS run",
        "event_id % 2 AS part",
        "elt(event_id % 3 + 1, 'stdout', 'stderr', 'notes.txt') AS file",
        "if(event_id % 5 = 0, 'no id', concat('at application_', event_id, '_1')) AS value",
    )
    folders = ["run", "part", "file"]
    ordered = lines.repartition(*folders).sortWithinPartitions(*folders, "event_id").drop("event_id")
    ordered.write.partitionBy(*folders).text(path)

    def in_path(name: str) -> Column:
        return F.regexp_extract("file_path", f"/{name}=([^/]+)/", 1)

    read = sources.read_logs(spark, path)
    named = read.withColumns({"run_id": in_path("run"), "file_name": in_path("file")})
    return logs.application_ids(named)


@query(
    f"""
    WITH {FINDINGS_CTE}
    SELECT o.scenario, o.run_id, o.outcome, o.summary, count(*) AS n_checks
    FROM outcomes o JOIN checks c
      ON c.scenario = o.scenario AND c.run_id IS NOT DISTINCT FROM o.run_id
    GROUP BY ALL
    """
)
def docs_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Validation reports stored as JSON per scenario and read back."""
    path = scratch(spark, "reports")
    reports = validation.report_rows(
        validation.summarise(evaluated(spark, folder)), F.lit("2026-01-01T00:00:00Z")
    )
    sinks.write_reports(reports, path)
    stored = sources.read_docs(spark, path, reports.schema, one_per_file=False)
    return stored.select(
        "scenario", "run_id", "outcome", "summary", F.size("checks").cast("bigint").alias("n_checks")
    )


@query(
    """
    SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"'
             || CASE WHEN event_id % 2 = 0 THEN ',"user_id":' || user_id ELSE '' END || '}' AS doc
    FROM events
    """
)
def sorted_json(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").selectExpr(
        "event_id", "if(event_id % 2 = 0, user_id, NULL) AS user_id", "event_type"
    )
    doc = runs.sorted_json(events, ["user_id", "event_type", "event_id"])
    return events.select("event_id", doc.alias("doc"))


@query(
    """
    WITH t AS (
      SELECT l_linenumber AS stage_id, CAST(l_quantity * 60000 AS BIGINT) AS ms,
             CAST(l_quantity AS BIGINT) * 1048576 AS spilled,
             CAST(floor(l_extendedprice) AS BIGINT) * 1048576 AS read, l_tax > 0.07 AS lost
      FROM lineitem)
    SELECT stage_id::BIGINT AS stage_id, round(max(ms) / 60000, 2) AS max_task_runtime_minutes,
           round(median(ms) / 60000, 2) AS median_task_runtime_minutes,
           CAST(greatest(1, floor(max(ms) / greatest(median(ms), 1))) AS BIGINT) AS skew_ratio,
           CAST(sum(spilled) // 1048576 AS BIGINT) AS shuffle_spill_mb,
           count(*) FILTER (ms IS NULL) AS active_task_count,
           round(CAST(sum(read) AS BIGINT) / 1073741824, 2) AS input_gb,
           round(max(ms) / 60000, 2) AS elapsed_minutes, 0::BIGINT AS active_stage_count,
           count(*) FILTER (lost) AS executor_failures
    FROM t GROUP BY stage_id
    """
)
def event_log_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Task records in event-log form, among other listener events; packed, in files small enough to read side by side."""
    path = scratch(spark, "event-log")
    load(spark, folder, "lineitem").select(
        F.to_json(
            F.expr(
                """named_struct('Event', 'SparkListenerTaskEnd', 'Stage ID', l_linenumber,
                   'Task Info', named_struct('Task ID', xxhash64(l_orderkey, l_linenumber,
                     l_partkey, l_suppkey, l_shipdate, l_extendedprice), 'Launch Time', 1000L,
                     'Finish Time', 1000 + cast(l_quantity * 60000 AS BIGINT)),
                   'Task End Reason', named_struct('Reason',
                     if(l_tax > 0.07, 'ExecutorLostFailure', 'Success')),
                   'Task Metrics', named_struct(
                     'Memory Bytes Spilled', cast(l_quantity AS BIGINT) * 1048576,
                     'Input Metrics', named_struct('Bytes Read',
                       cast(l_extendedprice AS BIGINT) * 1048576)))"""
            )
        ).alias("value")
    ).union(
        load(spark, folder, "orders").selectExpr(
            """concat('{"Event":"SparkListenerJobStart","Job ID":', o_orderkey, '}') AS value"""
        )
    ).write.option("maxRecordsPerFile", 100_000).text(path, compression="lz4")
    return task_metrics.task_signals(sources.read_event_log(spark, path), ["stage_id"])
