from __future__ import annotations

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobscope.operators import runs
from jobscope.vocab import RUN_STATES, SIGNAL_FIELDS
from tests.conftest import rows

CONTEXT_DDL = (
    "run_id string, scenario string, runtime string, region string, cluster_id string, "
    "step_id string, application_id string, serverless_application_id string, "
    "virtual_cluster_id string, job_run_id string, attempt string, eks_cluster_name string, "
    "namespace string, deploy_mode string, raw_state string, job_state string, "
    "time_window struct<start:string,end:string>, diagnostic_signals map<string,string>, "
    "started_at string, created_at string, ended_at string, updated_at string, "
    "expected_outcome string"
)


def context(spark, **values):
    names = [c.strip().split()[0] for c in CONTEXT_DDL.replace("start:string,", "").replace(
        "map<string,string>", "map").split(", ")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], CONTEXT_DDL)


def request(spark, **values):
    row = runs.build_request(context(spark, run_id="r", **values), "acct")
    return json.loads(row.select(F.to_json("request")).first()[0])


def test_every_state_of_every_runtime(spark):
    cases = [(r, s, v) for r, states in RUN_STATES.items() for s, v in states.items()]
    df = spark.createDataFrame(
        [(r, s, None, v) for r, s, v in cases],
        "runtime string, raw_state string, job_state string, want string",
    )
    assert runs.with_run_state(df).where("job_state <> want").count() == 0


@pytest.mark.parametrize(
    "runtime, raw, known, want",
    [
        ("emr_ec2", "CANCEL_PENDING", None, "running"),
        ("eks", "CANCEL_PENDING", None, "failed"),
        ("emr_ec2", "SUCCESS", "running", "running"),
        ("emr_ec2", "SUCCESS", None, "unknown"),
        (None, "COMPLETED", None, "completed"),
        ("other", "COMPLETED", "x", "x"),
        ("emr_ec2", None, None, "unknown"),
    ],
)
def test_state_lookup(spark, runtime, raw, known, want):
    df = context(spark, runtime=runtime, raw_state=raw, job_state=known)
    assert runs.with_run_state(df).first()["job_state"] == want



def window(spark, **values):
    as_of = F.expr("TIMESTAMP_NTZ '2026-01-02 00:00:00'")
    row = runs.build_context(context(spark, **values), as_of).first()
    return tuple(row["time_window"])


def test_window_prefers_live_times(spark):
    live = {
        "started_at": "2026-01-01T01:00:00+00:00",
        "created_at": "1767225600",
        "ended_at": "1767225600.5",
        "updated_at": "2026-01-01T05:00:00Z",
        "time_window": ("w0", "w1"),
    }
    assert window(spark, **live) == ("2026-01-01T01:00:00Z", "2026-01-01T00:00:00.500000Z")
    assert window(spark, runtime="emr_eks", **live)[0] == "2026-01-01T00:00:00Z"
    live["ended_at"] = ""
    assert window(spark, **live)[1] == "w1"
    assert window(spark, runtime="emr_serverless", **live)[1] == "2026-01-01T05:00:00Z"


def test_window_defaults(spark):
    assert window(spark) == ("2026-01-01T23:30:00Z", "2026-01-02T00:00:00Z")
    assert window(spark, time_window=("", None)) == ("2026-01-01T23:30:00Z", "2026-01-02T00:00:00Z")


def test_context_defaults(spark):
    row = runs.build_context(context(spark), F.expr("TIMESTAMP_NTZ '2026-01-02 00:00:00'")).first()
    assert (row["scenario"], row["runtime"]) == ("happy_path", "emr_ec2")
    assert (row["expected_outcome"], row["deploy_mode"]) == ("success", "unknown")


def test_known_signals_only(spark):
    got = request(
        spark,
        diagnostic_signals={
            "active_stage_count": "1",
            "skew_ratio": "12",
            "root_cause_hint": "x",
            "log_signal": "y",
        },
    )
    assert got["diagnostic_signals"] == {"active_stage_count": "1", "skew_ratio": "12"}
    assert len(SIGNAL_FIELDS) == 16


@pytest.mark.parametrize("signals", [None, {}, {"log_signal": "x"}])
def test_no_known_signals(spark, signals):
    assert "diagnostic_signals" not in request(spark, diagnostic_signals=signals)


def test_cluster_request(spark):
    got = request(spark, step_id="", application_id=None, cluster_id="j-1", region="eu")
    assert got == {
        "account_id": "acct",
        "cluster_id": "j-1",
        "deploy_mode": "unknown",
        "job_state": "unknown",
        "region": "eu",
    }


def test_serverless_request(spark):
    got = request(
        spark,
        runtime="serverless",
        serverless_application_id="app",
        job_run_id="jr",
        attempt="2",
        cluster_id="j-1",
        step_id="s-1",
        job_state="failed",
    )
    assert got["target"] == {"serverless_application_id": "app", "job_run_id": "jr", "attempt": 2}
    assert got["runtime"] == "emr_serverless"
    assert not {"cluster_id", "step_id", "deploy_mode"} & set(got)


def test_eks_request(spark):
    got = request(
        spark,
        runtime="emr_eks",
        virtual_cluster_id="vc",
        job_run_id="jr",
        eks_cluster_name="",
        namespace="ns",
        attempt="1",
    )
    assert got["target"] == {"virtual_cluster_id": "vc", "job_run_id": "jr", "namespace": "ns"}


def test_latest_run_ignores_exports(spark):
    df = spark.createDataFrame(
        [
            ("a", "a-20260101T000000Z", "f1.json"),
            ("a", "a-20260103T000000Z", "f3-exported.json"),
            ("a", "a-20260102T000000Z", "f2.json"),
            ("b", "b-20250101T000000Z", "g.json"),
        ],
        "scenario string, run_id string, file string",
    )
    got = runs.latest_run(df, exported=F.col("file").endswith("-exported.json"))
    assert [r[2] for r in rows(got)] == ["f2.json", "g.json"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "long-scenario-name", "é", None]),
            st.one_of(st.none(), st.text("ab-\x00é\U0001f600", max_size=20)),
            st.booleans(),
        ),
        min_size=1,
        max_size=20,
    )
)
def test_latest_run_for_any_ids(spark, drawn):
    records = [(s, (s or "") + i if own and i is not None else i) for s, i, own in drawn]
    want = {}
    for s, i in records:
        best = want.get(s)
        want[s] = i if best is None or (i is not None and i.encode() > best.encode()) else best
    df = spark.createDataFrame(records, "scenario string, run_id string")
    assert dict(map(tuple, runs.latest_run(df).collect())) == want


def test_terminal_state(spark):
    t0 = dt.datetime(2026, 1, 1)

    def at(run, runtime, state, seconds):
        return (run, runtime, state, t0, t0 + dt.timedelta(seconds=seconds))

    history = spark.createDataFrame(
        [
            at("ok", "emr_ec2", "RUNNING", 0),
            at("ok", "emr_ec2", "COMPLETED", 30),
            at("ok", "emr_ec2", "FAILED", 40),
            at("late", "emr_ec2", "COMPLETED", 600),
            at("other", "emr_ec2", "SUCCESS", 10),
            at("sls", "serverless", "SUCCESS", 10),
            at("eks", "emr_eks", "INTERRUPTED", 10),
        ],
        "run_id string, runtime string, state string, submitted_at timestamp_ntz, ts timestamp_ntz",
    )
    got = {r["run_id"]: r["final_state"] for r in runs.terminal_state(history).collect()}
    assert got == {
        "ok": "COMPLETED",
        "late": "TIMEOUT",
        "other": "TIMEOUT",
        "sls": "SUCCESS",
        "eks": "TIMEOUT",
    }
