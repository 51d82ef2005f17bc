"""Alarms over tables and streams, stream quarantine, run tracker."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobscope.operators import alarms
from jobscope.operators.logs import log_entries
from jobscope.operators.quality import quarantine
from jobscope.operators.runs import terminal_state
from jobscope.sources.files import stream_folder, stream_parquet
from jobscope.streaming.alarms import stream_idle_alarm, stream_sum_alarm
from jobscope.streaming.quarantine import stream_quarantine
from jobscope.streaming.readiness import stream_log_readiness
from jobscope.streaming.run_tracker import run_slots, terminal_states
from jobscope.streaming.sink import drain, drain_to, start_files
from tests.conftest import rows

T0 = dt.datetime(2026, 1, 1, 12, 0)
METRIC = "k string, ts timestamp, v double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def metrics(spark, points, ddl=METRIC):
    return spark.createDataFrame(points, ddl)


def idle_minutes(df):
    return sorted((r["k"], (r["period_start"] - T0).seconds // 60) for r in df.collect())


def test_sum_alarm_threshold(spark):
    df = metrics(spark, [("a", at(0), 1.0), ("a", at(4), 1.0), ("a", at(5), 0.0), ("b", at(0), 0.5)])
    got = rows(alarms.sum_alarm(df, "ts", "v", ["k"]))
    assert got == [
        (T0, "a", 2.0, True),
        (T0, "b", 0.5, False),
        (at(5), "a", 0.0, False),
    ]


def test_three_periods_in_a_row(spark):
    df = metrics(spark, [("a", at(m), 1.0) for m in (0, 5, 10, 15)])
    assert idle_minutes(alarms.idle_alarm(df, "ts", "v", ["k"])) == [("a", 10), ("a", 15)]


def test_a_missing_period_breaks_the_streak(spark):
    df = metrics(spark, [("a", at(m), 1.0) for m in (0, 5, 15, 20, 25)])
    assert idle_minutes(alarms.idle_alarm(df, "ts", "v", ["k"])) == [("a", 25)]


def test_a_period_below_the_mean_breaks_the_streak(spark):
    df = metrics(spark, [("a", at(0), 1.0), ("a", at(5), 1.0), ("a", at(6), 0.0), ("a", at(10), 1.0)])
    assert idle_minutes(alarms.idle_alarm(df, "ts", "v", ["k"])) == []


def test_keys_do_not_mix(spark):
    df = metrics(spark, [("a", at(0), 1.0), ("b", at(5), 1.0), ("a", at(10), 1.0)])
    assert idle_minutes(alarms.idle_alarm(df, "ts", "v", ["k"])) == []


def test_other_periods(spark):
    df = metrics(spark, [("a", at(m), 1.0) for m in (0, 1)])
    got = alarms.idle_alarm(df, "ts", "v", ["k"], period_minutes=1, periods=2)
    assert idle_minutes(got) == [("a", 1)]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.integers(0, 59), st.sampled_from([0.0, 1.0, 2.0])),
        min_size=1,
        max_size=60,
    )
)
def test_idle_alarm_against_brute_force(spark, points):
    df = metrics(spark, [(k, at(m), v) for k, m, v in points])
    periods = {}
    for k, m, v in points:
        periods.setdefault((k, m // 5), []).append(v)
    hot = {p for p, vs in periods.items() if sum(vs) / len(vs) >= 1}
    want = sorted((k, 5 * p) for k, p in hot if {(k, p - 1), (k, p - 2)} <= hot)
    assert idle_minutes(alarms.idle_alarm(df, "ts", "v", ["k"])) == want


class Feed:
    """A folder of Parquet files a stream reads, one batch of files per drain."""

    def __init__(self, spark, folder, ddl):
        self.spark, self.ddl = spark, ddl
        self.source, self.out = f"{folder}/source", f"{folder}/out"
        spark.createDataFrame([], ddl).write.parquet(self.source)

    def add(self, points):
        self.spark.createDataFrame(points, self.ddl).coalesce(1).write.mode("append").parquet(self.source)

    def stream(self):
        return stream_folder(self.spark, self.source, self.spark.read.parquet(self.source).schema)

    def drain(self, plan):
        stream = plan(self.stream())
        path = drain_to(stream, self.out)
        return self.spark.read.schema(stream.schema).parquet(path)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path), METRIC)


def test_stream_drops_late_rows(feed):
    def plan(s):
        return stream_sum_alarm(s, "ts", "v", ["k"])

    feed.add([("a", at(0), 1.0), ("a", at(60), 1.0)])
    assert rows(feed.drain(plan)) == [(T0, "a", 1.0, True)]  # minute 60 is still open
    feed.add([("a", at(1), 5.0), ("a", at(55), 2.0), ("a", at(120), 1.0)])
    got = rows(feed.drain(plan))
    assert got == [(T0, "a", 1.0, True), (at(55), "a", 2.0, True), (at(60), "a", 1.0, True)]


def test_stream_idle_equals_batch_across_restarts(feed, spark):
    points = [("a", at(m), 1.0) for m in range(0, 60, 5) if m != 25]
    feed.add(points[:4])
    feed.drain(lambda s: stream_idle_alarm(s, "ts", "v", ["k"]))
    feed.add(points[4:])
    feed.drain(lambda s: stream_idle_alarm(s, "ts", "v", ["k"]))
    feed.add([("z", at(600), 0.0)])
    got = feed.drain(lambda s: stream_idle_alarm(s, "ts", "v", ["k"]))
    assert idle_minutes(got) == idle_minutes(
        alarms.idle_alarm(metrics(spark, points), "ts", "v", ["k"])
    )


def test_stream_quarantine_stores_each_record_once(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "id int, amount string")
    out, checkpoint = str(tmp_path / "q"), str(tmp_path / "c")

    def run():
        rules = {"amount": F.col("amount").try_cast("double").isNull()}
        stream_quarantine(feed.stream(), rules, out, checkpoint).awaitTermination()

    feed.add([(1, "1.5"), (2, "x")])
    run()
    run()  # nothing new: nothing is written again
    feed.add([(3, None), (4, "2")])
    run()
    ddl = "id int, amount string, reasons array<string>, is_bad boolean"
    stored = spark.read.schema(ddl).parquet(out)
    got = sorted((r["id"], r["is_bad"], list(r["reasons"])) for r in stored.collect())
    assert got == [(1, False, []), (2, True, ["amount"]), (3, True, ["amount"]), (4, False, [])]
    everything = quarantine(spark.read.parquet(feed.source), {"a": F.col("amount").isNull()})
    assert stored.count() == everything.count()


HISTORY = "run_id string, runtime string, state string, submitted_at timestamp, ts timestamp"


def track(spark, folder, feed):
    slots = run_slots(feed.stream(), watermark="0 seconds")
    closed = stream_folder(spark, drain_to(slots, f"{folder}/slots"), slots.schema)
    states = terminal_states(closed, timeout_s=600)
    out = spark.read.schema(states.schema).parquet(drain_to(states, f"{folder}/states"))
    return {r["run_id"]: r["final_state"] for r in out.collect()}


def test_run_tracker(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), HISTORY)

    def state(run, name, minute, runtime="emr_ec2"):
        return (run, runtime, name, T0, at(minute))

    feed.add(
        [
            state("done", "RUNNING", 0),
            state("done", "FAILED", 3),
            state("done", "COMPLETED", 2),
            state("slow", "RUNNING", 0),
            state("eks", "INTERRUPTED", 1, "emr_eks"),
            state("clock", "RUNNING", 8),
        ]
    )
    assert track(spark, tmp_path, feed) == {}  # nothing later is known: nothing is certain
    feed.add([state("slow", "COMPLETED", 11), state("clock", "RUNNING", 30)])
    first = track(spark, tmp_path, feed)
    assert first["done"] == "COMPLETED"
    feed.add([state("done", "FAILED", 45), state("clock", "RUNNING", 60)])
    last = track(spark, tmp_path, feed)
    assert last == {
        "done": "COMPLETED",
        "slow": "TIMEOUT",
        "eks": "TIMEOUT",
        "clock": "TIMEOUT",
    }


def test_reported_runs_leave_no_state_after_the_retention(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), HISTORY)
    held = []
    for minute in (0, 30, 60 * 24 * 8, 60 * 24 * 8 + 60):
        names = ("a", "b", "c") if minute == 0 else (f"clock{minute}",)
        feed.add([(n, "emr_ec2", "COMPLETED", T0, at(minute)) for n in names])
        slots = run_slots(feed.stream(), watermark="0 seconds")
        closed = stream_folder(spark, drain_to(slots, f"{tmp_path}/slots"), slots.schema)
        query = start_files(terminal_states(closed, timeout_s=600), f"{tmp_path}/out", f"{tmp_path}/c")
        query.awaitTermination()
        held.append(max((p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:]), default=0))
    assert max(held) >= 3 and held[-1] <= 2


def test_no_submission_time_means_no_deadline(spark, tmp_path):
    rows = [
        ("ends", "emr_ec2", "COMPLETED", None, at(500)),
        ("runs", "emr_ec2", "RUNNING", None, at(1)),
        ("clock", "emr_ec2", "RUNNING", at(900), at(900)),
        ("later", "emr_ec2", "RUNNING", at(960), at(960)),
    ]
    feed = Feed(spark, str(tmp_path), HISTORY)
    feed.add(rows)
    track(spark, tmp_path, feed)
    feed.add([("later", "emr_ec2", "RUNNING", at(960), at(990))])
    assert track(spark, tmp_path, feed)["ends"] == "COMPLETED"
    batch = terminal_state(spark.createDataFrame(rows, HISTORY), timeout_s=600)
    got = {r["run_id"]: (r["final_state"], r["deadline"]) for r in batch.collect()}
    assert got["ends"] == ("COMPLETED", None) and got["runs"] == ("UNKNOWN", None)
    assert got["clock"][0] == "TIMEOUT"


@pytest.mark.parametrize("buckets", [1, 3, 1_000])
def test_runs_share_state_rows(spark, tmp_path, buckets):
    """State rows are bounded by the buckets; what a run reports doesn't depend on its neighbours."""
    feed = Feed(spark, str(tmp_path), HISTORY)
    day = 60 * 24
    parts = [
        [(f"r{i}", "emr_ec2", ("COMPLETED", "RUNNING", "FAILED")[i % 3], T0 if i % 4 else None, at(i % 20)) for i in range(60)]
        + [(None, "emr_ec2", "FAILED", T0, at(1))],
        [("r0", "emr_ec2", "FAILED", None, at(31)), ("r3", "emr_ec2", "FAILED", T0, at(32)), ("clock", "emr_ec2", "RUNNING", None, at(50))],
        [("clock", "emr_ec2", "RUNNING", None, at(9 * day)), ("clock", "emr_ec2", "RUNNING", None, at(9 * day + 30))],
        [("r3", "emr_ec2", "FAILED", None, at(9 * day + 31)), ("clock", "emr_ec2", "RUNNING", None, at(9 * day + 60))],
        [("clock", "emr_ec2", "RUNNING", None, at(9 * day + 90))],
    ]
    held = []
    for part in parts:
        feed.add(part)
        slots = run_slots(feed.stream(), watermark="0 seconds")
        closed = stream_folder(spark, drain_to(slots, f"{tmp_path}/slots"), slots.schema)
        states = terminal_states(closed, timeout_s=600, buckets=buckets)
        query = start_files(states, f"{tmp_path}/out", f"{tmp_path}/c")
        query.awaitTermination()
        held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) <= buckets
    got = [(r["run_id"], r["final_state"]) for r in spark.read.schema(states.schema).parquet(f"{tmp_path}/out").collect()]
    want = [(None, "FAILED"), ("r3", "FAILED")]  # r3 again, long after it was forgotten
    for i in range(60):
        ends, sent = i % 3 != 1, i % 4 > 0
        name = ("COMPLETED", "", "FAILED")[i % 3]
        if sent:
            want.append((f"r{i}", name if ends and i % 20 < 10 else "TIMEOUT"))
        elif ends:
            want.append((f"r{i}", name))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_deadline_at_the_watermark_is_certain(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), HISTORY)
    feed.add([("a", "emr_ec2", "RUNNING", T0, T0), ("clock", "emr_ec2", "RUNNING", at(90), at(10))])
    track(spark, tmp_path, feed)
    feed.add([("clock", "emr_ec2", "RUNNING", at(90), at(20))])
    assert track(spark, tmp_path, feed) == {"a": "TIMEOUT"}


def test_single_file_and_folder_tables_stream(spark):
    stream = stream_parquet(spark, "/root/testdata/sf0.001", "events")
    assert stream.isStreaming and "event_id" in stream.columns


def readiness_rows(spark, tmp_path, runs, entries, until):
    """What the stream reports, and the batch answer on what counts for each run."""
    at = dt.datetime(2026, 1, 1)
    run_ddl = (
        "run_id string, submitted_at timestamp, runtime string, expected_outcome string, deploy_mode string, log_uri string, "
        "region string, cluster_id string, step_id string, application_id string, serverless_application_id string, "
        "job_run_id string, cloudwatch_log_group string, cloudwatch_log_stream_prefix string"
    )
    made = [
        (r, None if m is None else at + dt.timedelta(minutes=m), "emr_ec2", "failed", "cluster", "s3://l", "r", "j", f"s-{r}", f"a-{r}", None, None, None, None)
        for r, m in runs
    ]
    prefix = {"step": "s3://l/j/steps/s-{}/", "app": "s3://l/j/containers/a-{}/", "note": "s3://l/j/steps/s-{}/"}
    name = {"step": "controller.gz", "app": "stdout", "note": "notes.txt"}
    listed = [
        (prefix[kind].format(r), f"2026-01-01 00:00:00 1 x/{name[kind]}", None if m is None else at + dt.timedelta(minutes=m)) for r, kind, m in entries
    ]
    end = [("end", until)], [("s3://l/j/steps/s-none/", "2026-01-01 00:00:00 1 x/controller.gz", at + dt.timedelta(minutes=until))]
    made += [(r, at + dt.timedelta(minutes=m), "emr_eks", *[None] * 11) for r, m in end[0]]
    spark.createDataFrame(made, run_ddl).write.parquet(str(tmp_path / "runs"))
    listing_ddl = "prefix string, line string, seen_at timestamp"
    spark.createDataFrame(listed + end[1], listing_ddl).write.parquet(str(tmp_path / "files"))

    def streamed(name):
        path = str(tmp_path / name)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    none = streamed("files").where("false").selectExpr("'g' AS log_group", "prefix AS stream", "seen_at")
    entries = log_entries(streamed("files"), none, ["seen_at"])
    got = drain(spark, stream_log_readiness(streamed("runs"), entries), "readiness")
    return {r["run_id"]: r["logs"] for r in got.collect()}


def test_streamed_readiness(spark, tmp_path):
    runs = [("both", 0), ("late", 0), ("early", 20), ("alone", 5), ("half", 5), ("edge", 10), ("open", 170), (None, 3), ("untimed", None), ("note", 4)]
    entries = [
        ("both", "step", 3), ("both", "app", 30), ("both", "app", 30), ("late", "step", 10), ("late", "app", 31), ("early", "step", 19),
        ("early", "app", 25), ("half", "step", 6), ("edge", "step", 10), ("edge", "app", 40), ("open", "step", 171), ("open", "app", 171),
        ("note", "note", 5), ("note", "app", 6), ("both", "step", None),
    ]
    got = readiness_rows(spark, tmp_path, runs, entries, until=200)
    assert got == {
        "both": "ready", "late": "waiting", "early": "waiting", "alone": "waiting", "half": "waiting", "edge": "ready", "note": "waiting",
    }
