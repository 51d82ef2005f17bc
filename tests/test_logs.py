from __future__ import annotations

import gzip

import pytest

from jobscope.operators import logs
from jobscope.sources.files import read_logs
from jobscope.vocab import SIGNAL_RULES, UNCLASSIFIED_SENTINEL
from tests.conftest import rows

RUN_DDL = (
    "run_id string, runtime string, expected_outcome string, deploy_mode string, log_uri string, "
    "region string, cluster_id string, step_id string, application_id string, "
    "serverless_application_id string, job_run_id string, cloudwatch_log_group string, "
    "cloudwatch_log_stream_prefix string"
)
STEP = ("s3://logs/j-1/steps/s-1/", "2026-01-01 10:00:00  512 stderr.gz")
APP = ("s3://logs/j-1/containers/application_1_2/", "x container_1/stdout")
JOB = ("s3a://logs/applications/app/jobs/jr/", "x SPARK_DRIVER/job-metadata.log")
STREAM = ("group", "pre/applications/app/jobs/jr/SPARK_DRIVER/stdout")


def readiness(spark, listing=(), streams=(), **run):
    values = {
        "run_id": "r",
        "runtime": "emr_ec2",
        "expected_outcome": "failed",
        "deploy_mode": "client",
        "log_uri": "s3n://logs//",
        "region": "eu",
        "cluster_id": "j-1",
        "step_id": "s-1",
        "application_id": "application_1_2",
        "serverless_application_id": "app",
        "job_run_id": "jr",
        "cloudwatch_log_group": "group",
        "cloudwatch_log_stream_prefix": "/pre/",
        **run,
    }
    out = logs.log_readiness(
        spark.createDataFrame([tuple(values.values())], RUN_DDL),
        spark.createDataFrame(list(listing), "prefix string, line string"),
        spark.createDataFrame(list(streams), "log_group string, stream string"),
    ).collect()
    assert len(out) == 1
    return out[0]["logs"]


def test_client_run_needs_step_logs_only(spark):
    assert readiness(spark) == "waiting"
    assert readiness(spark, [APP]) == "waiting"
    assert readiness(spark, [STEP]) == "ready"


def test_failed_cluster_run_needs_both(spark):
    assert readiness(spark, [STEP], deploy_mode="cluster") == "waiting"
    assert readiness(spark, [STEP, APP], deploy_mode="cluster") == "ready"
    assert readiness(spark, [STEP, APP], deploy_mode="cluster", application_id=None) == "waiting"
    assert readiness(spark, [STEP], deploy_mode="cluster", expected_outcome="success") == "ready"


@pytest.mark.parametrize(
    "run",
    [
        {"expected_outcome": "running"},
        {"runtime": "emr_eks"},
        {"step_id": ""},
        {"log_uri": None},
        {"runtime": "emr_serverless", "job_run_id": ""},
    ],
)
def test_not_checked(spark, run):
    assert readiness(spark, [STEP], [STREAM], **run) == "not_checked"


def test_serverless_takes_either_source(spark):
    assert readiness(spark, [STEP], runtime="serverless") == "waiting"
    assert readiness(spark, [JOB], runtime="serverless") == "ready"
    assert readiness(spark, [], [STREAM], runtime="serverless") == "ready"
    assert readiness(spark, [], [("other", STREAM[1])], runtime="serverless") == "waiting"
    assert readiness(spark, [JOB], runtime="serverless", log_uri="") == "waiting"


def test_wrong_files_do_not_count(spark):
    listing = [(STEP[0], "x notes.txt"), (STEP[0], ""), (STEP[0], "stderr/")]
    assert readiness(spark, listing) == "waiting"


def test_every_phrase_gives_its_category(spark):
    lines = spark.createDataFrame(
        [(i, f"ERR {p.upper()}!") for i, (_, p) in enumerate(SIGNAL_RULES)], "i int, line string"
    )
    got = sorted((r["i"], r["category"]) for r in logs.scan_signals(lines).collect())
    assert got == [(i, c) for i, (c, _) in enumerate(SIGNAL_RULES)]


@pytest.mark.parametrize(
    "phrases",
    [
        ["disk", "disk full", "full", "k f", "DISK FULL on /tmp", "ll"],
        ["a.b", "a+b", "[a", "a|b", "(", "\\d", "é à"],
        ["aa", "aaa", "ab", "ba"],
    ],
)
def test_overlapping_phrases_are_all_found(spark, phrases):
    rules = [(f"C{i % 3}", p) for i, p in enumerate(phrases)] + [("AGAIN", phrases[0])]
    texts = [None, "", "Disk Full on /TMP", "diskfull disk", "[A.B|a+b(\\D", "É À", "aaab baaa", *phrases]
    lines = spark.createDataFrame(list(enumerate(texts)), "i int, line string")
    got = sorted(tuple(r) for r in logs.scan_signals(lines, rules).select("i", "category", "phrase").collect())
    assert got == sorted((i, c, p) for i, t in enumerate(texts) if t for c, p in rules if p.lower() in t.lower())


def test_empty_phrases_are_refused(spark):
    with pytest.raises(ValueError):
        logs.scan_signals(spark.createDataFrame([("a",)], "line string"), [("X", "")])


def test_lines_without_a_phrase(spark):
    lines = spark.createDataFrame(
        [(UNCLASSIFIED_SENTINEL,), ("fine",), ("",), (None,)], "line string"
    )
    assert logs.scan_signals(lines).count() == 0


def test_application_id_by_file_then_line(spark, tmp_path):
    first, second = "application_1_10", "application_2_20"
    for run, files in {
        "a": {"syslog": [second], "stderr.gz": ["boot", f"x {first} {second}", second]},
        "b": {"stdout": ["nothing"], "controller": [f"id={second}"], "trace.txt": [first]},
        "c": {"stdout": ["none at all"]},
    }.items():
        (tmp_path / run).mkdir()
        for name, lines in files.items():
            text = "\n".join(lines) + "\n"
            path = tmp_path / run / name
            path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    lines = read_logs(spark, str(tmp_path)).selectExpr(
        "*", "regexp_extract(file_path, '/([abc])/[^/]+$', 1) AS run_id"
    )
    assert rows(logs.application_ids(lines)) == [("a", first), ("b", second)]


def test_line_order_across_splits_of_one_file(spark, tmp_path):
    path = tmp_path / "stdout"
    path.write_text("".join(f"line application_1_{i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_logs(spark, str(path)).selectExpr("*", "'r' AS run_id")
        assert lines.rdd.getNumPartitions() > 4
        assert rows(logs.application_ids(lines)) == [("r", "application_1_0")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_of_one_name_go_by_path(spark, tmp_path):
    for folder, number in (("z", 1), ("a", 2), ("m", 3)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "stderr").write_text(f"x\nup application_1_{number}\n")
    for parts in ("1m", "1"):
        spark.conf.set("spark.sql.files.openCostInBytes", parts)
        try:
            lines = read_logs(spark, str(tmp_path)).selectExpr("*", "'r' AS run_id")
            assert rows(logs.application_ids(lines)) == [("r", "application_1_2")]
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_runs_without_logs(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    lines = spark.createDataFrame([("a",), ("a",)], "run_id string")
    assert rows(logs.runs_without_logs(runs, lines, "run_id")) == [("b",)]
