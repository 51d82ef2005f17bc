"""What the physical plans must and must not hold."""

from __future__ import annotations

import pathlib
import re

import pytest

from jobscope.operators import logs, runs
from jobscope.plans import QUERIES
from tests.conftest import DATA

ROOT = pathlib.Path(__file__).resolve().parents[1]

# A window or aggregate over everything, and why its input is small.
BOUNDED_SINGLE_TASK = {
    "cast_audit": "one row of partial counts per task",
    "country_rollup": "one partial count per task",
    "hot_keys": "one sketch and one partial count per task",
    "range_histogram": "one row per partition of the read",
    "raw_csv_audit": "one row of partial counts per task",
    "run_metrics": "one partial count per task",
    "salted_join": "one sketch and one partial count per task",
    "schema_diff": "one row of partial counts per task",
    "skew_ratio": "one partial minimum and maximum per task",
    "skew_report": "distinct row counts: at most sqrt(2N) for N rows",
    "staged_validation": "one row of partial counts per task",
    "suggest_bounds": "at most a million distinct values; one sketch per task and 1024 slice totals beyond",
    "suite_summary": "one row of partial counts per task",
    "synth_event_rows": "one partial count per task",
    "synth_events_profile": "one row of partial counts per task",
    "value_profile": "one row of partial counts per task",
}


def plan(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_product_and_no_unbounded_single_task(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if "SinglePartition" in text:
        assert name in BOUNDED_SINGLE_TASK


@pytest.mark.parametrize(
    "name",
    [
        "daily_rollup", "key_counts", "terminal_state", "sum_alarm", "payload_budget", "latest_run",
        "application_id", "first_application_id", "task_signals",
    ],
)
def test_counts_are_combined_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "partial_" in text and "SortAggregate" not in text


def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<l_partkey:bigint>" in plan(spark, "key_counts")
    assert "ReadSchema: struct<o_custkey:bigint>" in plan(spark, "partitioned_count")
    shuffled = plan(spark, "synth_shuffle_counts")
    assert "repeat" not in shuffled and "ReadSchema: struct<event_id:bigint>" in shuffled


@pytest.mark.parametrize("name", ["task_signals", "event_log_signals", "one_pass_summaries", "suggest_bounds"])
def test_the_source_is_read_once(spark, name):
    """In the plan that ran: other uses take the shuffled counts again."""
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan", ran)) == 1


def test_the_newest_is_sought_in_key_columns_only(spark, tmp_path):
    """The look that finds the place of the newest record reads no other column."""
    path = str(tmp_path / "runs")
    wide = "id", "'s' AS scenario", "CONCAT('s-', id) AS run_id", "'x' AS payload", "'syslog' AS file_name", "id AS line_no"
    spark.range(10).selectExpr(*wide, "CONCAT('application_1_', id) AS line").write.parquet(path)
    for newest in (runs.latest_run, logs.application_ids):
        text = newest(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
        scans = sorted(re.findall(r"ReadSchema: struct<([^>.]*)", text), key=len)
        assert len(scans) == 2 and "payload" not in scans[0] and "id:bigint" not in scans[0].split(",")
    assert "payload" in runs.latest_run(spark.read.parquet(path)).columns


def test_exchanges_of_ranked_and_grouped_counts(spark):
    """At most half of what slices for every group took (48, 14 and 9)."""
    for name, most in (("skew_report", 8), ("task_signals", 4), ("suggest_bounds", 3)):
        assert plan(spark, name).count("Exchange") <= most


def test_filters_reach_the_scan(spark):
    assert "EqualTo(c_mktsegment,BUILDING)" in plan(spark, "prefilter_join")


def test_row_rules_do_not_shuffle(spark):
    for name in ("log_signals", "run_states", "run_context", "support_matrix", "pod_signals"):
        assert "Exchange" not in plan(spark, name)


def test_a_line_is_lowered_once(spark):
    assert plan(spark, "log_signals").count("lower(") == 1


def test_findings_meet_a_broadcast_catalogue(spark):
    text = plan(spark, "finding_checks")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_library_keeps_clear_of_what_does_not_survive_scale():
    banned = r"localCheckpoint|setCheckpointDir|crossJoin|\.toPandas\(|\.collect\(\)|foreachBatch|\.rdd\b|@udf"
    for path in (ROOT / "jobscope").rglob("*.py"):
        assert not re.search(banned, path.read_text()), path
