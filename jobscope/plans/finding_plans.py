"""Findings against expectations.

Every event stands for one diagnosed run; scenario, category and recommendations follow from
its id, so that SQL can derive the same findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators import validation
from jobscope.plans.registry import query
from jobscope.session import load
from jobscope.vocab import EXPECTED_FINDINGS, SUPPORTED

SCENARIOS = [row[0] for row in EXPECTED_FINDINGS]
CATEGORIES = [row[2] for row in EXPECTED_FINDINGS]


def _sql_text(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def _sql_list(values) -> str:
    return "[" + ", ".join(_sql_text(v) for v in values) + "]"


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """One finding per event.  Events 28 and 29 of every 30 are of scenarios nobody expects."""
    no = F.col("event_id")
    place = (no % 30).cast("int")
    names = F.array(*[F.lit(s) for s in [*SCENARIOS[:-1], "not_listed"]])
    wanted = F.array(*[F.lit(c) for c in CATEGORIES])
    category = (
        F.when(no % 4 == 0, F.get(wanted, place))
        .when(no % 4 == 1, "SHUFFLE_SPILL")
        .when(no % 4 == 3, "EXECUTOR_LOST")
    )
    recommendations = F.expr(
        """CASE event_id % 5
             WHEN 1 THEN cast(array() AS array<struct<type:string,pr_ready:boolean>>)
             WHEN 2 THEN array(named_struct('type', 'SPARK_CONFIG', 'pr_ready', true))
             WHEN 3 THEN array(NULL, named_struct('type', 'CODE', 'pr_ready', false))
             WHEN 4 THEN array(named_struct('type', 'DB', 'pr_ready', NULL),
                               named_struct('type', 'RUNBOOK', 'pr_ready', true)) END"""
    )
    return load(spark, folder, "events").select(
        F.coalesce(F.get(names, place), F.lit("not_listed")).alias("scenario"),
        no.alias("run_id"),
        F.concat(F.lit("inv-"), no).alias("investigation_id"),
        F.when(no % 4 != 2, F.struct(category.alias("category"))).alias("root_cause"),
        recommendations.alias("recommendations"),
    )


# The catalogue as SQL, and all (run, check) rows as three branches.
_EXPECTED_ROWS = ",\n  ".join(
    f"({i}, {_sql_text(s)}, {_sql_text(c)}, "
    f"{_sql_list(sorted(set(rel or ())))}::VARCHAR[], {_sql_text(kind)}, "
    f"{'NULL' if ready is None else str(ready).lower()}::BOOLEAN)"
    for i, (s, _, c, rel, kind, ready, *_rest) in enumerate(EXPECTED_FINDINGS)
)
_LAST = len(EXPECTED_FINDINGS) - 1
FINDINGS_CTE = f"""
exp(place, scenario, category, related, rec_type, ready) AS (VALUES
  {_EXPECTED_ROWS}),
act AS (
  SELECT event_id AS run_id, event_id % 30 AS place, 'inv-' || event_id AS investigation_id,
         coalesce(CASE event_id % 4
           WHEN 0 THEN (SELECT category FROM exp WHERE exp.place = event_id % 30)
           WHEN 1 THEN 'SHUFFLE_SPILL' WHEN 3 THEN 'EXECUTOR_LOST' END, 'UNKNOWN') AS got,
         CASE event_id % 5 WHEN 2 THEN ['SPARK_CONFIG'] WHEN 3 THEN ['CODE']
              WHEN 4 THEN ['DB', 'RUNBOOK'] ELSE []::VARCHAR[] END AS types,
         event_id % 5 IN (2, 4) AS any_ready
  FROM events),
paired AS (
  SELECT exp.*, run_id, investigation_id, got, types, any_ready
  FROM act JOIN exp USING (place) WHERE place < {_LAST}
  UNION ALL
  SELECT exp.*, NULL, '', 'UNKNOWN', []::VARCHAR[], false FROM exp
  WHERE place = {_LAST}
     OR NOT EXISTS (SELECT 1 FROM events WHERE event_id % 30 = exp.place)),
checks AS (
  SELECT scenario, run_id, investigation_id, 1 AS pos,
         CASE WHEN category IS NULL THEN 'no_false_positive' ELSE 'root_cause_category' END AS name,
         CASE WHEN category IS NULL THEN got = 'UNKNOWN'
              ELSE got = category OR list_contains(related, got) END AS passed,
         coalesce(category, 'UNKNOWN') AS expected, got AS actual,
         CASE WHEN category IS NULL
              THEN 'Expected no root cause (UNKNOWN) but the diagnosis returned ''' || got || ''''
              ELSE 'Expected ''' || category || '''' ||
                   CASE WHEN len(related) > 0
                        THEN ' (or [''' || array_to_string(related, ''', ''') || '''])' ELSE '' END
                   || ', got ''' || got || '''' END AS why
  FROM paired
  UNION ALL
  SELECT scenario, run_id, investigation_id, 2, 'recommendation_type',
         list_contains(types, rec_type), rec_type, t.shown,
         'Expected recommendation type ''' || rec_type || ''', got ' || t.shown
  FROM paired, LATERAL (SELECT '[' || array_to_string(
         list_transform(types, lambda x: '''' || x || ''''), ', ') || ']' AS shown) t
  WHERE rec_type IS NOT NULL
  UNION ALL
  SELECT scenario, run_id, investigation_id, 3, 'pr_ready', any_ready = ready,
         CAST(ready AS VARCHAR), CAST(any_ready AS VARCHAR),
         'Expected pr_ready=' || CASE WHEN ready THEN 'True' ELSE 'False' END ||
         ', got ' || CASE WHEN any_ready THEN 'True' ELSE 'False' END
  FROM paired WHERE ready IS NOT NULL),
outcomes AS (
  SELECT scenario, run_id, investigation_id,
         CASE WHEN run_id IS NULL THEN 'skip' WHEN bool_and(passed) THEN 'pass' ELSE 'fail' END
           AS outcome,
         CASE WHEN run_id IS NULL THEN 'SKIP: not run' WHEN bool_and(passed) THEN 'PASS: all ' || count(*) || ' check(s) passed'
              ELSE 'FAIL: ' || count(*) FILTER (NOT passed) || ' of ' || count(*) ||
                   ' check(s) failed: ' ||
                   string_agg(name, ', ' ORDER BY pos) FILTER (NOT passed) END AS summary
  FROM checks GROUP BY scenario, run_id, investigation_id)
"""


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    return validation.evaluate(validation.expected_catalog(spark), findings(spark, folder))


@query(
    f"""
    WITH {FINDINGS_CTE}
    SELECT scenario, run_id, investigation_id, pos, name, passed, expected, actual,
           CASE WHEN passed THEN '' ELSE why END AS message FROM checks
    """
)
def finding_checks(spark: SparkSession, folder: str) -> DataFrame:
    return validation.compare(validation.expected_catalog(spark), findings(spark, folder))


@query(f"WITH {FINDINGS_CTE} SELECT * FROM outcomes")
def finding_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return validation.summarise(evaluated(spark, folder)).select(
        "scenario", "run_id", "investigation_id", "outcome", "summary"
    )


@query(
    f"""
    WITH {FINDINGS_CTE}
    SELECT o AS outcome, scenario, count(run_key) AS run_count,
           CAST(sum(count(run_key)) OVER (PARTITION BY o) AS BIGINT) AS outcome_runs,
           (SELECT CAST(count(*) FILTER (outcome = 'fail') > 0 AS INTEGER) FROM outcomes) AS overall
    FROM (VALUES ('pass'), ('fail'), ('skip')) s(o)
    LEFT JOIN (SELECT *, 1 AS run_key FROM outcomes) r ON r.outcome = o
    GROUP BY o, scenario
    """
)
def suite_summary(spark: SparkSession, folder: str) -> DataFrame:
    return validation.suite_summary(validation.summarise(evaluated(spark, folder)))


CONFUSION_SQL = f"""
WITH {FINDINGS_CTE}
SELECT coalesce(category, 'UNKNOWN') AS expected, got AS actual, count(*) AS run_count
FROM paired GROUP BY ALL
"""


@query(CONFUSION_SQL)
def confusion_long(spark: SparkSession, folder: str) -> DataFrame:
    return validation.confusion(evaluated(spark, folder))


_SHOWN = ["UNKNOWN", "SHUFFLE_SPILL", "EXECUTOR_LOST", "DATA_SKEW"]


@query(
    "SELECT expected, "
    + ", ".join(
        f"CAST(coalesce(sum(run_count) FILTER (actual = '{c}'), 0) AS BIGINT) AS \"{c}\""
        for c in _SHOWN
    )
    + f" FROM ({CONFUSION_SQL}) GROUP BY expected"
)
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return validation.confusion_matrix(evaluated(spark, folder), _SHOWN)


@query(
    """
    SELECT event_id AS run_id, 'inv-' || event_id AS investigation_id, 'not_listed' AS scenario
    FROM events WHERE event_id % 30 >= 27
    """
)
def unexpected_runs(spark: SparkSession, folder: str) -> DataFrame:
    catalog = validation.expected_catalog(spark)
    return validation.unexpected_runs(catalog, findings(spark, folder)).select(
        "scenario", "run_id", "investigation_id"
    )


@query(
    "SELECT 'criterion ' || user_id % 8 AS criterion, "
    + ", ".join(
        f"avg(event_id % 4) FILTER (event_id % 2 = {i} AND event_id % 3 = {j}) "
        f"AS {lane}_{runtime}"
        for j, runtime in enumerate(("emr_ec2", "emr_serverless", "emr_eks"))
        for i, lane in enumerate(("native", "assisted"))
    )
    + " FROM events GROUP BY 1"
)
def scorecard(spark: SparkSession, folder: str) -> DataFrame:
    scores = load(spark, folder, "events").selectExpr(
        "concat('criterion ', user_id % 8) AS criterion",
        "elt(event_id % 2 + 1, 'native', 'assisted') AS lane",
        "elt(event_id % 3 + 1, 'emr_ec2', 'emr_serverless', 'emr_eks') AS runtime",
        "event_id % 4 AS score",
    )
    return validation.scorecard(scores)


@query(
    """
    WITH f AS (
      SELECT 's' || o_orderkey AS scenario, o_orderkey AS k,
             CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'C' || o_orderkey % 5 END AS category
      FROM orders),
    c AS (
      SELECT DISTINCT 's' || l_orderkey AS scenario,
             CASE WHEN l_orderkey % 11 = 0 THEN 'UNKNOWN' ELSE 'C' || l_orderkey % 5 END AS cat,
             l_orderkey % 13 <> 0 AS known
      FROM lineitem)
    SELECT f.scenario, concat_ws(',',
      CASE WHEN category IS NULL THEN 'no_category' END,
      CASE WHEN k % 17 = 0 THEN 'bad_outcome' END,
      CASE WHEN k % 4 < 2 THEN 'few_evidence' END,
      CASE WHEN k % 3 = 0 THEN 'no_recommendation' END,
      CASE WHEN c.scenario IS NOT NULL AND cat <> coalesce(category, 'UNKNOWN')
           THEN 'category_mismatch' END,
      CASE WHEN c.scenario IS NOT NULL AND NOT known THEN 'unknown_job' END) AS violations
    FROM f LEFT JOIN c ON f.scenario = c.scenario
    """
)
def catalog_lint(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as findings, ordered scenarios with line items as configured ones."""
    orders = load(spark, folder, "orders")
    expected = orders.selectExpr(
        "concat('s', o_orderkey) AS scenario",
        "CASE WHEN o_orderkey % 17 <> 0 THEN 'failed' ELSE 'odd' END AS expected_outcome",
        "CASE WHEN o_orderkey % 7 <> 0 THEN concat('C', o_orderkey % 5) END "
        "AS expected_root_cause_category",
        "array_repeat('e', cast(o_orderkey % 4 AS int)) AS expected_evidence",
        "array_repeat('r', cast(o_orderkey % 3 AS int)) AS expected_recommendations",
    )
    configs = (
        load(spark, folder, "lineitem")
        .select("l_orderkey")
        .distinct()
        .selectExpr(
            "concat('s', l_orderkey) AS scenario",
            "concat('jobs/j', l_orderkey % 13, '.py') AS job",
            "CASE WHEN l_orderkey % 11 = 0 THEN 'UNKNOWN' ELSE concat('C', l_orderkey % 5) END "
            "AS expected_root_cause_category",
        )
    )
    jobs = load(spark, folder, "customer").selectExpr(
        "concat('jobs/j', c_custkey % 12 + 1, '.py') AS job"
    )
    lint = validation.lint_catalog(expected, configs, jobs)
    return lint.withColumn("violations", F.array_join("violations", ","))


_ASKED = [
    "happy_path",
    "executor_oom",
    "image_pull_failure",
    "s3_path_missing",
    "data_skew",
    "s3_access_denied",
    "bad_input_data",
    "not_offered",
]
_RUNTIMES = ["ec2", "emr_serverless", "eks", "on_prem"]
_ALLOWED = ", ".join(
    f"('{asked}', '{s}')"
    for asked, name in zip(_RUNTIMES, ("emr_ec2", "emr_serverless", "emr_eks"))
    for s in SUPPORTED[name]
)


@query(
    f"""
    WITH r AS (
      SELECT event_id AS run_id, {_sql_list(_RUNTIMES)}[event_id % 4 + 1] AS runtime,
             {_sql_list(_ASKED)}[user_id % 8 + 1] AS scenario
      FROM events),
    m(runtime, scenario) AS (VALUES {_ALLOWED})
    SELECT run_id, runtime, scenario,
           CASE WHEN runtime = 'on_prem' THEN 'unknown runtime' ELSE 'scenario not offered' END
             AS reason
    FROM r ANTI JOIN m USING (runtime, scenario)
    """
)
def support_matrix(spark: SparkSession, folder: str) -> DataFrame:
    runtimes = ", ".join(f"'{r}'" for r in _RUNTIMES)
    scenarios = ", ".join(f"'{s}'" for s in _ASKED)
    runs = load(spark, folder, "events").selectExpr(
        "event_id AS run_id",
        f"elt(event_id % 4 + 1, {runtimes}) AS runtime",
        f"elt(user_id % 8 + 1, {scenarios}) AS scenario",
    )
    return validation.unsupported(runs)
