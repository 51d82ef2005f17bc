"""Text and time rules, table-driven."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobscope.functions import text, times


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "uri, want",
    [
        ("s3n://bucket/logs", "s3://bucket/logs"),
        ("s3a://bucket/logs", "s3://bucket/logs"),
        ("s3://bucket/logs", "s3://bucket/logs"),
        ("hdfs://s3a://x", "hdfs://s3a://x"),
        ("", ""),
        (None, None),
    ],
)
def test_normalise_uri(spark, uri, want):
    assert value(spark, text.normalise_uri(F.lit(uri).cast("string"))) == want


@pytest.mark.parametrize(
    "line, file, is_log",
    [
        ("2026-01-01 00:00:00   12 logs/container_1/stderr.gz", "stderr.gz", True),
        ("stdout", "stdout", True),
        ("12\tpath/stdout-old  ", "stdout-old", True),
        ("x syslog", "syslog", False),
        ("x a/", None, False),
        ("   ", None, False),
        ("", None, False),
        (None, None, False),
    ],
)
def test_listing_line(spark, line, file, is_log):
    col = F.lit(line).cast("string")
    assert value(spark, text.listing_file(col)) == file
    assert value(spark, text.names_log_file(col, ("stderr", "stdout"))) is is_log


def test_log_prefixes(spark):
    root = F.lit("s3n://b/logs//")
    assert value(spark, text.step_log_prefix(root, F.lit("j-1"), F.lit("s-1"))) == "s3://b/logs/j-1/steps/s-1/"
    assert (
        value(spark, text.application_log_prefix(root, F.lit("j-1"), F.lit("application_1_2")))
        == "s3://b/logs/j-1/containers/application_1_2/"
    )
    assert (
        value(spark, text.job_log_prefix(root, F.lit("app"), F.lit("run")))
        == "s3://b/logs/applications/app/jobs/run/"
    )


def test_first_present(spark):
    assert value(spark, text.first_present(F.lit(None), F.lit(""), F.lit("x"), F.lit("y"))) == "x"
    assert value(spark, text.first_present(F.lit(""), F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    "uri, want",
    [("s3://b/k", True), ("s3://b/", False), ("s3://b", False), ("s3a://b/k", False), ("s3:///k", True)],
)
def test_has_object_key(spark, uri, want):
    assert value(spark, text.has_object_key(F.lit(uri))) is want


@pytest.mark.parametrize("name, want", [("a-B_9", True), ("a b", False), ("", False), ("a\n", False)])
def test_safe_name(spark, name, want):
    assert value(spark, text.safe_name(F.lit(name))) is want


def test_job_name_cuts_both_parts(spark):
    got = value(
        spark, text.job_name(F.lit("pod_pending_resource_pressure_x"), F.lit("20260101T000000Z-abc"), "run")
    )
    assert got == "run-pod-pending-resource-pressur-20260101T000000Z-a"


@pytest.mark.parametrize(
    "explicit, scenario, want, valid",
    [
        (None, "driver_oom", "client", True),
        ("", "executor_oom", "cluster", True),
        ("cluster", "driver_oom", "cluster", True),
        ("local", "driver_oom", "local", False),
        (None, None, "cluster", True),
    ],
)
def test_deploy_mode(spark, explicit, scenario, want, valid):
    mode = text.deploy_mode(F.lit(explicit).cast("string"), F.lit(scenario).cast("string"))
    assert value(spark, mode) == want
    assert value(spark, text.valid_deploy_mode(mode)) is valid


def test_window_label(spark):
    assert value(spark, text.window_label(F.lit(""), F.lit("b"))) == "(unknown start) to b"
    assert value(spark, text.window_label(F.lit("a"), F.lit(None).cast("string"))) == "a to (unknown end)"


def test_padded_id(spark):
    assert value(spark, text.padded_id("evt-", F.lit(7), 8)) == "evt-00000007"
    assert value(spark, text.padded_id("c_", F.lit(12345), 3)) == "c_12345"


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, None),
        ("", None),
        ("1767225600", "2026-01-01T00:00:00Z"),
        ("1767225600.123456", "2026-01-01T00:00:00.123456Z"),
        ("-1", "1969-12-31T23:59:59Z"),
        ("2026-01-01T00:00:00+00:00", "2026-01-01T00:00:00Z"),
        ("2026-01-01T00:00:00+02:00", "2026-01-01T00:00:00+02:00"),
    ],
)
def test_normalise_time(spark, raw, want):
    assert value(spark, times.normalise_time(F.lit(raw).cast("string"))) == want


def test_times_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert value(spark, times.normalise_time(F.lit("1767225600"))) == "2026-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_small_arithmetic(spark):
    assert value(spark, times.minutes(F.lit(100))) == 1.67
    assert value(spark, times.pending_containers(F.lit(1))) == 1
    assert value(spark, times.pending_containers(F.lit(7))) == 3
    now, then = dt.datetime(2026, 1, 1, 1), dt.datetime(2026, 1, 1)
    assert value(spark, times.age_seconds(F.lit(now), F.lit(then))) == 3600
