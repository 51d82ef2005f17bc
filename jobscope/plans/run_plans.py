"""Run states, contexts, requests, latest runs, terminal states and small run labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions import text, times
from jobscope.operators import diagnostics, lifecycle, plan_trees, pods, runs, task_metrics
from jobscope.plans.registry import query
from jobscope.session import load
from jobscope.vocab import RUN_STATES

_RAW = (
    "PENDING",
    "RUNNING",
    "SUCCESS",
    "COMPLETED",
    "FAILED",
    "CANCELLED",
    "CANCEL_PENDING",
    "INTERRUPTED",
    "SCHEDULED",
)
_RUNTIMES = ("emr_ec2", "emr_serverless", "emr_eks")
_RAW_LIST = ", ".join(f"'{s}'" for s in _RAW)
_RUNTIME_LIST = ", ".join(f"'{r}'" for r in _RUNTIMES)
_STATE_ROWS = ", ".join(
    f"('{r}', '{raw}', '{state}')" for r, m in RUN_STATES.items() for raw, state in m.items()
)
_AS_OF = "TIMESTAMP_NTZ '2024-02-01 00:00:00'"


@query(
    f"""
    WITH r AS (SELECT event_id AS run_id, [{_RUNTIME_LIST}][event_id % 3 + 1] AS runtime,
                      [{_RAW_LIST}][user_id % 9 + 1] AS raw_state,
                      CASE WHEN event_id % 2 = 0 THEN 'running' END AS context_state FROM events),
    m(runtime, raw_state, state) AS (VALUES {_STATE_ROWS})
    SELECT run_id, runtime, raw_state, coalesce(state, context_state, 'unknown') AS job_state
    FROM r LEFT JOIN m USING (runtime, raw_state)
    """
)
def run_states(spark: SparkSession, folder: str) -> DataFrame:
    records = load(spark, folder, "events").selectExpr(
        "event_id AS run_id",
        f"elt(event_id % 3 + 1, {_RUNTIME_LIST}) AS runtime",
        f"elt(user_id % 9 + 1, {_RAW_LIST}) AS raw_state",
        "CASE WHEN event_id % 2 = 0 THEN 'running' END AS job_state",
    )
    return runs.with_run_state(records)


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a run record with gaps: NULL and empty text both occur."""
    iso = "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00')"
    return load(spark, folder, "events").selectExpr(
        "event_id AS run_id",
        f"elt(event_id % 3 + 1, {_RUNTIME_LIST}) AS runtime",
        f"elt(user_id % 9 + 1, {_RAW_LIST}) AS raw_state",
        "CASE WHEN event_id % 2 = 0 THEN 'running' END AS job_state",
        "CASE WHEN event_id % 7 <> 0 THEN event_type END AS scenario",
        "CASE WHEN event_id % 6 <> 0 THEN 'failed' END AS expected_outcome",
        "elt(event_id % 4 + 1, '', 'client', 'cluster', NULL) AS deploy_mode",
        f"CASE event_id % 4 WHEN 0 THEN {iso} WHEN 1 THEN '' END AS started_at",
        "CASE event_id % 5 WHEN 0 THEN cast(1704067200 + event_id AS STRING) "
        "WHEN 1 THEN concat(1704067200 + event_id, '.25') END AS created_at",
        f"CASE event_id % 6 WHEN 0 THEN {iso} WHEN 1 THEN '' END AS ended_at",
        f"CASE event_id % 8 WHEN 0 THEN {iso} END AS updated_at",
        "named_struct('start', CASE event_id % 9 WHEN 0 THEN 'w0' WHEN 1 THEN '' END, "
        "'end', CASE event_id % 10 WHEN 0 THEN 'w1' WHEN 1 THEN '' END) AS time_window",
        "concat('app-', user_id) AS serverless_application_id",
        "concat('vc-', user_id) AS virtual_cluster_id",
        "CASE WHEN event_id % 11 <> 0 THEN concat('jr-', event_id) ELSE '' END AS job_run_id",
        "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN cast(event_id % 4 AS STRING) END AS attempt",
        "CASE WHEN event_id % 5 = 0 THEN 'eks-a' END AS eks_cluster_name",
        "CASE WHEN event_id % 4 = 0 THEN 'ns' ELSE '' END AS namespace",
        "CASE WHEN event_id % 13 <> 0 THEN concat('j-', user_id) END AS cluster_id",
        "CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('s-', event_id) END AS step_id",
        "CASE WHEN event_id % 8 = 0 THEN concat('application_1_', event_id) END AS application_id",
        "CASE WHEN event_id % 17 <> 0 THEN 'us-east-1' END AS region",
        "CASE event_id % 4 WHEN 0 THEN map('skew_ratio', '12', 'log_signal', 'x') "
        "WHEN 1 THEN map('root_cause_hint', 'y') "
        "WHEN 2 THEN map('input_gb', cast(event_id AS STRING)) END AS diagnostic_signals",
    )


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_CREATED = """CASE event_id % 5
  WHEN 0 THEN strftime(make_timestamp((1704067200 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
  WHEN 1 THEN strftime(make_timestamp((1704067200 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%S')
              || '.250000Z' END"""
CONTEXT_SQL = f"""
SELECT event_id AS run_id, runtime, scenario, expected_outcome, deploy_mode, job_state,
       coalesce(CASE WHEN runtime <> 'emr_eks' AND event_id % 4 = 0 THEN {_ISO} END,
                {_CREATED}, CASE WHEN event_id % 9 = 0 THEN 'w0' END,
                '2024-01-31T23:30:00Z') AS window_start,
       coalesce(CASE WHEN event_id % 6 = 0 THEN {_ISO} END,
                CASE WHEN runtime = 'emr_serverless' AND event_id % 8 = 0 THEN {_ISO} END,
                CASE WHEN event_id % 10 = 0 THEN 'w1' END, '2024-02-01T00:00:00Z') AS window_end
FROM (
  SELECT event_id, ts, [{_RUNTIME_LIST}][event_id % 3 + 1] AS runtime,
         CASE WHEN event_id % 7 <> 0 THEN event_type ELSE 'happy_path' END AS scenario,
         CASE WHEN event_id % 6 <> 0 THEN 'failed' ELSE 'success' END AS expected_outcome,
         CASE event_id % 4 WHEN 1 THEN 'client' WHEN 2 THEN 'cluster' ELSE 'unknown' END
           AS deploy_mode,
         coalesce((SELECT state FROM (VALUES {_STATE_ROWS}) m(r, raw, state)
                   WHERE r = [{_RUNTIME_LIST}][event_id % 3 + 1]
                     AND raw = [{_RAW_LIST}][user_id % 9 + 1]),
                  CASE WHEN event_id % 2 = 0 THEN 'running' END, 'unknown') AS job_state
  FROM events)
"""


def contexts(spark: SparkSession, folder: str) -> DataFrame:
    return runs.build_context(run_records(spark, folder), F.expr(_AS_OF))


@query(CONTEXT_SQL)
def run_context(spark: SparkSession, folder: str) -> DataFrame:
    return contexts(spark, folder).select(
        "run_id",
        "runtime",
        "scenario",
        "expected_outcome",
        "deploy_mode",
        "job_state",
        F.col("time_window.start").alias("window_start"),
        F.col("time_window.end").alias("window_end"),
    )


@query(
    f"""
    SELECT c.run_id, 'acct' AS account_id,
           CASE WHEN NOT typed AND c.run_id % 8 = 0 THEN 'application_1_' || c.run_id END
             AS application_id,
           CASE WHEN NOT typed THEN CASE WHEN c.run_id % 13 <> 0 THEN 'j-' || user_id ELSE '' END
             END AS cluster_id,
           CASE WHEN NOT typed THEN deploy_mode END AS deploy_mode,
           CASE c.run_id % 4 WHEN 0 THEN 'skew_ratio=12' WHEN 2 THEN 'input_gb=' || c.run_id END
             AS signals,
           job_state,
           CASE WHEN c.run_id % 17 <> 0 THEN 'us-east-1' ELSE '' END AS region,
           CASE WHEN typed THEN runtime END AS runtime,
           CASE WHEN NOT typed AND c.run_id % 7 <> 0 THEN 's-' || c.run_id END AS step_id,
           CASE WHEN runtime = 'emr_serverless' THEN 'app-' || user_id END
             AS serverless_application_id,
           CASE WHEN runtime = 'emr_eks' THEN 'vc-' || user_id END AS virtual_cluster_id,
           CASE WHEN typed AND c.run_id % 11 <> 0 THEN 'jr-' || c.run_id END AS job_run_id,
           CASE WHEN runtime = 'emr_serverless' AND c.run_id % 3 = 1
                THEN CAST(c.run_id % 4 AS INTEGER) END AS attempt,
           CASE WHEN runtime = 'emr_eks' AND c.run_id % 5 = 0 THEN 'eks-a' END AS eks_cluster_name,
           CASE WHEN runtime = 'emr_eks' AND c.run_id % 4 = 0 THEN 'ns' END AS namespace,
           window_start, window_end
    FROM (SELECT *, runtime <> 'emr_ec2' AS typed FROM ({CONTEXT_SQL})) c
    JOIN events e ON e.event_id = c.run_id
    """
)
def run_requests(spark: SparkSession, folder: str) -> DataFrame:
    requests = runs.build_request(contexts(spark, folder), "acct")
    signals = F.transform(
        F.map_entries("request.diagnostic_signals"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return requests.select(
        "run_id", "request.*", F.array_join(signals, ",").alias("signals")
    ).select(
        "*",
        "target.*",
        F.col("time_window.start").alias("window_start"),
        F.col("time_window.end").alias("window_end"),
    ).drop("target", "time_window", "diagnostic_signals")


@query(
    """
    SELECT run_id, field, value FROM (
      SELECT event_id AS run_id, 'skew_ratio' AS field, '12' AS value FROM events
      WHERE event_id % 4 = 0
      UNION ALL SELECT event_id, 'input_gb', CAST(event_id AS VARCHAR) FROM events
      WHERE event_id % 4 = 2)
    """
)
def signal_whitelist(spark: SparkSession, folder: str) -> DataFrame:
    return runs.signal_rows(run_records(spark, folder))


@query(
    """
    SELECT event_type AS scenario, run_id, event_id FROM (
      SELECT *, event_type || '-' || strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || event_id AS run_id,
             row_number() OVER (PARTITION BY event_type ORDER BY
               event_type || '-' || strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || event_id DESC) AS rn
      FROM events WHERE event_id % 10 <> 9) WHERE rn = 1
    """
)
def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    records = load(spark, folder, "events").selectExpr(
        "event_type AS scenario",
        "concat_ws('-', event_type, date_format(ts, \"yyyyMMdd'T'HHmmss'Z'\"), event_id) AS run_id",
        "event_id",
        "concat(event_id, if(event_id % 10 = 9, '-exported.json', '.json')) AS file_name",
    )
    newest = runs.latest_run(records, exported=F.col("file_name").endswith("-exported.json"))
    return newest.select("scenario", "run_id", "event_id")


TEN_DAYS = 10 * 24 * 3600
TERMINAL_SQL = """
WITH h AS (
  SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id) AS submitted_at,
         ['emr_ec2', 'emr_serverless', 'emr_eks'][user_id % 3 + 1] AS runtime,
         ['PENDING', 'RUNNING', 'SUCCESS', 'COMPLETED', 'FAILED', 'CANCELLED', 'CANCEL_PENDING',
          'INTERRUPTED', 'SCHEDULED'][event_id % 9 + 1] AS state,
         event_id % 9 IN (2, 3, 4, 5, 7) AND event_id % 4 = 0 AS loud
  FROM events),
t AS (
  SELECT * FROM h
  WHERE loud AND ((runtime = 'emr_ec2' AND state IN ('COMPLETED', 'FAILED', 'CANCELLED', 'INTERRUPTED'))
     OR (runtime = 'emr_serverless' AND state IN ('SUCCESS', 'FAILED', 'CANCELLED'))
     OR (runtime = 'emr_eks' AND state IN ('COMPLETED', 'FAILED', 'CANCELLED'))))
SELECT CAST(u.user_id AS VARCHAR) AS run_id, u.submitted_at,
       u.submitted_at + INTERVAL 10 DAY AS deadline,
       f.ts AS finished_at, coalesce(f.state, 'TIMEOUT') AS final_state
FROM (SELECT user_id, min(ts) AS submitted_at FROM events GROUP BY user_id) u
LEFT JOIN (SELECT user_id, min(ts) AS ts, arg_min(state, (ts, state)) AS state FROM t
           WHERE ts < submitted_at + INTERVAL 10 DAY GROUP BY user_id) f
  ON u.user_id = f.user_id
"""


def state_history(events: DataFrame) -> DataFrame:
    """Events as polled run states; three in four show no final state, to reach time-outs."""
    states = ", ".join(f"'{s}'" for s in _RAW)
    return events.selectExpr(
        "cast(user_id AS STRING) AS run_id",
        f"elt(user_id % 3 + 1, {_RUNTIME_LIST}) AS runtime",
        f"CASE WHEN event_id % 4 = 0 THEN elt(event_id % 9 + 1, {states}) ELSE 'RUNNING' END "
        "AS state",
        "ts AS submitted_at",
        "ts",
    )


@query(TERMINAL_SQL)
def terminal_state(spark: SparkSession, folder: str) -> DataFrame:
    return runs.terminal_state(state_history(load(spark, folder, "events")), TEN_DAYS)


@query(
    r"""
    SELECT page_id,
           CASE WHEN page_id % 2 = 0 THEN 's3://' || substr(url, 8) ELSE url END AS uri,
           rtrim(CASE WHEN page_id % 2 = 0 THEN 's3://' || substr(url, 8) ELSE url END, '/')
             || '/j-1/steps/s-' || page_id || '/' AS step_prefix,
           CASE page_id % 4 WHEN 0 THEN 'stderr.gz' WHEN 1 THEN 'notes.txt' WHEN 2 THEN 'stdout'
                END AS file,
           page_id % 4 IN (0, 2) AS is_log
    FROM pages
    """
)
def uri_normalise(spark: SparkSession, folder: str) -> DataFrame:
    pages = load(spark, folder, "pages").selectExpr(
        "page_id",
        "CASE WHEN page_id % 2 = 0 THEN concat(if(page_id % 3 = 0, 's3a://', 's3n://'), "
        "substr(url, 8)) ELSE url END AS raw",
        "CASE page_id % 4 WHEN 0 THEN concat('2026-01-01 00:00:00   12 a/', page_id, '/stderr.gz') "
        "WHEN 1 THEN 'x y/notes.txt' WHEN 2 THEN 'stdout' ELSE '' END AS line",
    )
    return pages.select(
        "page_id",
        text.normalise_uri(F.col("raw")).alias("uri"),
        text.step_log_prefix(
            F.concat("raw", F.lit("//")), F.lit("j-1"), F.concat(F.lit("s-"), "page_id")
        ).alias("step_prefix"),
        text.listing_file(F.col("line")).alias("file"),
        text.names_log_file(F.col("line"), ("stderr", "stdout")).alias("is_log"),
    )


@query(
    """
    SELECT event_id,
           CASE event_id % 3 WHEN 0 THEN 'cluster' WHEN 1 THEN
                CASE WHEN user_id % 2 = 0 THEN 'client' ELSE 'cluster' END ELSE 'odd' END AS mode,
           event_id % 3 <> 2 AS mode_ok,
           CASE WHEN event_id % 2 = 0 THEN '2024-01-01' ELSE '(unknown start)' END || ' to ' ||
             CASE WHEN event_id % 3 = 0 THEN '2024-01-02' ELSE '(unknown end)' END AS window_label,
           event_id % 4 = 0 AS has_key,
           event_id % 5 <> 0 AS safe,
           'run-' || CASE WHEN user_id % 2 = 0 THEN 'spot-interruption'
                          ELSE 'long-running-resource-delay-' END
             || '-' || substr('r' || event_id || '-20240101T000000Z', 1, 18) AS job_name,
           CASE WHEN event_id % 2 = 1 AND event_id % 3 <> 0 THEN 'start,end'
                WHEN event_id % 2 = 1 THEN 'start' WHEN event_id % 3 <> 0 THEN 'end' ELSE '' END
             AS missing
    FROM events
    """
)
def run_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = load(spark, folder, "events").selectExpr(
        "event_id",
        "CASE event_id % 3 WHEN 0 THEN 'cluster' WHEN 1 THEN '' ELSE 'odd' END AS explicit",
        "if(user_id % 2 = 0, 'spot_interruption', 'long_running_resource_delay_x') AS scenario",
        "CASE WHEN event_id % 2 = 0 THEN '2024-01-01' END AS start",
        "CASE WHEN event_id % 3 = 0 THEN '2024-01-02' ELSE '' END AS end",
        "elt(event_id % 4 + 1, 's3://b/k', 's3://b', 's3://b/', 'http://b/k') AS uri",
        "if(event_id % 5 = 0, 'a b', concat('a_b-', event_id)) AS name",
        "concat('r', event_id, '-20240101T000000Z') AS run_id",
    )
    mode = text.deploy_mode(F.col("explicit"), F.col("scenario"))
    start, end = F.col("start"), F.col("end")
    return labels.select(
        "event_id",
        mode.alias("mode"),
        text.valid_deploy_mode(mode).alias("mode_ok"),
        text.window_label(start, end).alias("window_label"),
        text.has_object_key(F.col("uri")).alias("has_key"),
        text.safe_name(F.col("name")).alias("safe"),
        text.job_name(F.col("scenario"), F.col("run_id"), "run").alias("job_name"),
        F.array_join(text.missing_names(start=start, end=end), ",").alias("missing"),
    )


@query(
    """
    SELECT event_id, CAST((2 * event_id * 100 + 60) // 120 AS DOUBLE) / 100 AS minutes,
           greatest(1, event_id // 2) AS pending_containers
    FROM events
    """
)
def signal_math(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select(
        "event_id",
        times.minutes(F.col("event_id")).alias("minutes"),
        times.pending_containers(F.col("event_id")).alias("pending_containers"),
    )


@query(
    """
    SELECT doc_id AS pid, lang AS state, source AS wait_event_type, 'e' || doc_id % 3 AS wait_event,
           CAST(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-02-01') AS BIGINT)
             AS query_age,
           left(text, 500) AS query_excerpt
    FROM documents LEFT JOIN events ON event_id = doc_id * 11
    """
)
def active_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sessions; those without an event have no start time."""
    starts = load(spark, folder, "events").selectExpr(
        "event_id", "date_trunc('second', ts) AS query_start"
    )
    documents = load(spark, folder, "documents")
    activity = documents.join(starts, F.col("event_id") == F.col("doc_id") * 11, "left").selectExpr(
        "doc_id AS pid",
        "'main' AS datname",
        "lang AS state",
        "source AS wait_event_type",
        "concat('e', doc_id % 3) AS wait_event",
        "cast(query_start AS TIMESTAMP_NTZ) AS query_start",
        "text AS query",
    )
    return diagnostics.active_queries(activity, F.expr(_AS_OF), "main", 500)


@query(
    """
    SELECT 'app' || p_partkey % 3 AS schemaname, p_brand AS tablename, 'i' || p_partkey AS indexname,
           'CREATE INDEX ON ' || p_brand AS indexdef
    FROM part WHERE p_size % 5 > 1
    """
)
def index_inventory(spark: SparkSession, folder: str) -> DataFrame:
    indexes = load(spark, folder, "part").selectExpr(
        "CASE p_size % 5 WHEN 0 THEN 'pg_catalog' WHEN 1 THEN 'information_schema' "
        "ELSE concat('app', p_partkey % 3) END AS schemaname",
        "p_brand AS tablename",
        "concat('i', p_partkey) AS indexname",
        "concat('CREATE INDEX ON ', p_brand) AS indexdef",
    )
    return diagnostics.index_inventory(indexes)


def plan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """An order as a plan: a join over a scan of the order and, for odd orders, a deeper side.

    Some documents are lists of two plans, some are no JSON, some have text for a number.
    """
    plans = load(spark, folder, "orders").selectExpr(
        "o_orderkey",
        """concat('{"Plan":{"Node Type":"', if(o_orderkey % 3 = 0, 'Nested Loop', 'Hash Join'),
           '","Plans":[{"Node Type":"Seq Scan","Relation Name":"orders","Plan Rows":',
           if(o_orderkey % 11 = 2, '"many"', cast(o_custkey * 1000 AS STRING)), '},',
           if(o_orderkey % 2 = 1,
              concat('{"Node Type":"Sort","Plan Rows":7,"Plans":[{"Node Type":"Index Scan",',
                     '"Relation Name":"customer","Plan Rows":', o_orderkey, '}]}'),
              '{"Node Type":"Seq Scan","Relation Name":"nation","Plan Rows":25}'),
           ']}}') AS document""",
    )
    return plans.selectExpr(
        "o_orderkey AS plan_id",
        """CASE o_orderkey % 11
             WHEN 0 THEN concat('EXPLAIN ', document)
             WHEN 1 THEN concat('[', document, ', {"Plan": {"Node Type": "Result"}}, 5]')
             ELSE document END AS document""",
    )


@query(
    """
    WITH o AS (SELECT *, CASE WHEN o_orderkey % 11 <> 2 THEN o_custkey * 1000 END AS scanned
               FROM orders WHERE o_orderkey % 11 <> 0),
    n AS (
      SELECT o_orderkey AS plan_id, 0::BIGINT AS plan_no, 0::BIGINT AS node_no, 0::BIGINT AS depth,
             CASE WHEN o_orderkey % 3 = 0 THEN 'Nested Loop' ELSE 'Hash Join' END AS node_type,
             NULL AS relation, NULL::BIGINT AS plan_rows,
             greatest(scanned, CASE WHEN o_orderkey % 2 = 1 THEN 7 ELSE 25 END)
               AS max_child_rows, NULL AS problem
      FROM o
      UNION ALL SELECT o_orderkey, 0, 1, 1, 'Seq Scan', 'orders', scanned, NULL,
                       CASE WHEN scanned IS NULL THEN 'Plan Rows is not a number' END FROM o
      UNION ALL SELECT o_orderkey, 0, 2, 1, 'Sort', NULL, 7, o_orderkey, NULL FROM o
                WHERE o_orderkey % 2 = 1
      UNION ALL SELECT o_orderkey, 0, 3, 2, 'Index Scan', 'customer', o_orderkey, NULL, NULL FROM o
                WHERE o_orderkey % 2 = 1
      UNION ALL SELECT o_orderkey, 0, 2, 1, 'Seq Scan', 'nation', 25, NULL, NULL FROM o
                WHERE o_orderkey % 2 = 0
      UNION ALL SELECT o_orderkey, 1, 0, 0, 'Result', NULL, NULL, NULL, NULL FROM o
                WHERE o_orderkey % 11 = 1
      UNION ALL SELECT o_orderkey, 2, NULL, NULL, NULL, NULL, NULL, NULL, 'no plan' FROM o
                WHERE o_orderkey % 11 = 1
      UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not JSON' FROM orders
                WHERE o_orderkey % 11 = 0)
    SELECT *, coalesce(node_type = 'Seq Scan' AND plan_rows >= 100000, false) AS large_seq_scan,
           coalesce(node_type = 'Nested Loop' AND max_child_rows >= 100000, false)
             AS large_nested_loop
    FROM n
    """
)
def plan_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return plan_trees.flag_nodes(plan_trees.plan_nodes(plan_documents(spark, folder)))


def pod_rows(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").selectExpr(
        "event_id",
        "concat('jr-', user_id) AS run_id",
        "named_struct('name', if(event_id % 6 = 0, NULL, concat('pod-', event_id)), "
        "'labels', if(event_id % 2 = 0, map('run', concat('jr-', user_id)), NULL), "
        "'annotations', if(event_id % 3 = 0, map(concat('x/jr-', user_id), 'y'), "
        "cast(map() AS map<string,string>))) AS metadata",
        "named_struct('phase', elt(event_id % 4 + 1, 'Pending', 'Running', 'Failed', NULL), "
        "'conditions', if(event_id % 5 = 0, array(named_struct('type', 'PodScheduled', 'status', "
        "if(event_id % 2 = 0, 'False', 'True'), 'reason', 'Unschedulable')), NULL), "
        "'containerStatuses', if(event_id % 7 = 0, array(named_struct('state', "
        "named_struct('waiting', named_struct('reason', "
        "elt(event_id % 3 + 1, 'ErrImagePull', 'ImagePullBackOff', 'CrashLoop'))))), NULL)) "
        "AS status",
    )


@query(
    """
    SELECT event_id, coalesce('pod-' || CASE WHEN event_id % 6 <> 0 THEN event_id END, 'unknown')
             || ':' || coalesce(CASE event_id % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Running'
                                WHEN 2 THEN 'Failed' END, 'unknown') AS label,
           event_id % 4 = 0 OR event_id % 10 = 0 AS pending,
           event_id % 7 = 0 AND event_id % 3 < 2 AS image_pull,
           event_id % 2 = 0 OR event_id % 3 = 0 AS mentions_run
    FROM events
    """
)
def pod_signals(spark: SparkSession, folder: str) -> DataFrame:
    metadata, status = F.col("metadata"), F.col("status")
    return pods.pod_signals(pod_rows(spark, folder)).select(
        "event_id",
        pods.pod_label(metadata, status).alias("label"),
        "pending",
        "image_pull",
        pods.mentions_run(metadata, F.col("run_id")).alias("mentions_run"),
    )


@query(
    """
    SELECT 'jr-' || user_id AS run_id, count(*) FILTER (own) AS pod_count,
           bool_or(own AND (event_id % 4 = 0 OR event_id % 10 = 0)) AS any_pending,
           bool_or(own AND event_id % 7 = 0 AND event_id % 3 < 2) AS any_image_pull
    FROM (SELECT *, event_id % 2 = 0 OR event_id % 3 = 0 AS own FROM events) GROUP BY user_id
    """
)
def pod_run_signals(spark: SparkSession, folder: str) -> DataFrame:
    return pods.run_signals(pod_rows(spark, folder))


@query(
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'no matching pods'
           WHEN 1 THEN 'pod-' || event_id || ':Running'
           ELSE 'pod-' || event_id || ':Running, unknown:Pending' END AS summary
    FROM events
    """
)
def pod_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One pod listing per event with none, one or two pods."""
    pod = (
        "named_struct('metadata', named_struct('name', {0}), 'status', named_struct('phase', {1}))"
    )
    first = pod.format("concat('pod-', event_id)", "'Running'")
    second = pod.format("cast(NULL AS STRING)", "'Pending'")
    listings = load(spark, folder, "events").selectExpr(
        "event_id",
        f"slice(array({first}, {second}), 1, cast(event_id % 3 AS int)) AS items",
    )
    return listings.select("event_id", pods.pod_summary(F.col("items")).alias("summary"))


@query(
    """
    WITH t AS (
      SELECT l_orderkey % 20 AS run_id, l_linenumber AS stage_id,
             CASE WHEN l_orderkey % 50 <> 0 THEN CAST(l_quantity * 60000 AS BIGINT) END AS ms,
             CAST(l_quantity AS BIGINT) * 1048576 * 2 AS spilled, l_extendedprice, l_tax, l_suppkey
      FROM lineitem),
    s AS (SELECT run_id, stage_id, max(ms) AS max_ms, median(ms) AS med,
                 CAST(sum(spilled) AS BIGINT) AS spilled, count(*) FILTER (ms IS NULL) AS active,
                 CAST(sum(CAST(floor(l_extendedprice) AS BIGINT) * 1048576) AS BIGINT) AS read,
                 max(coalesce(ms, 0) + l_suppkey) - min(l_suppkey) AS elapsed,
                 count(*) FILTER (l_tax > 0.07) AS lost
          FROM t GROUP BY ALL)
    SELECT run_id, stage_id, round(max_ms / 60000, 2) AS max_task_runtime_minutes,
           round(med / 60000, 2) AS median_task_runtime_minutes,
           CAST(greatest(1, floor(max_ms / greatest(med, 1))) AS BIGINT) AS skew_ratio,
           spilled // 1048576 AS shuffle_spill_mb, active AS active_task_count,
           round(read / 1073741824, 2) AS input_gb, round(elapsed / 60000, 2) AS elapsed_minutes,
           CAST(active > 0 AS BIGINT) AS active_stage_count, lost AS executor_failures
    FROM s
    """
)
def task_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as tasks: quantity is the minutes taken and the megabytes spilled, twice."""
    tasks = load(spark, folder, "lineitem").selectExpr(
        "l_orderkey % 20 AS run_id",
        "l_linenumber AS stage_id",
        "l_suppkey AS launch_ms",
        "CASE WHEN l_orderkey % 50 <> 0 THEN l_suppkey + cast(l_quantity * 60000 AS BIGINT) END "
        "AS finish_ms",
        "cast(l_extendedprice AS BIGINT) * 1048576 AS input_bytes",
        "l_tax > 0.07 AS executor_lost",
        "cast(l_quantity AS BIGINT) * 1048576 AS memory_spilled",
        "cast(l_quantity AS BIGINT) * 1048576 AS disk_spilled",
    )
    return task_metrics.task_signals(tasks)


@query(
    """
    SELECT event_id, object_class, modified_at, days AS retention_days
    FROM (SELECT event_id, ['raw', 'processed', 'logs', 'other'][event_id % 4 + 1] AS object_class,
                 ts AS modified_at FROM events)
    JOIN (VALUES ('raw', 7), ('processed', 7), ('logs', 14)) p(object_class, days) USING (object_class)
    WHERE modified_at < TIMESTAMP '2024-01-20' - to_days(days)
    """
)
def retention_expired(spark: SparkSession, folder: str) -> DataFrame:
    objects = load(spark, folder, "events").selectExpr(
        "event_id",
        "elt(event_id % 4 + 1, 'raw', 'processed', 'logs', 'other') AS object_class",
        "ts AS modified_at",
    )
    return lifecycle.expired(objects, F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
