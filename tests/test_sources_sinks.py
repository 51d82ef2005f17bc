from __future__ import annotations

import json
import os
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from jobscope import jobs
from jobscope.operators import rollups, task_metrics
from jobscope.plans import QUERIES
from jobscope.session import literal_rows, scratch, scratch_space, shared_folder
from jobscope.sinks import files as sinks
from jobscope.sources import files, generators, jdbc
from jobscope.vocab import COUNTRIES, EVENT_TYPES
from tests.conftest import rows


def test_child_path():
    assert sinks.child_path("s3://b/out///", "/a/", "", "b") == "s3://b/out/a/b"


def test_event_csv_keeps_rows_with_bad_amounts(spark, tmp_path):
    (tmp_path / "e.csv").write_text(
        "event_id,customer_id,event_type,amount,event_ts,country\n"
        "evt-1,c-1,view,1.5,2026-01-01T23:30:00Z,AU\n"
        "evt-2,c-1,view,oops,2026-01-02T00:30:00+01,AU\n"
        "evt-3,c-2,cart,,bad,US\n"
    )
    events = rollups.with_event_date(files.read_events_csv(spark, str(tmp_path)))
    got = [(r["amount"], str(r["event_date"])) for r in events.orderBy("event_id").collect()]
    assert got == [(1.5, "2026-01-01"), (None, "2026-01-01"), (None, "None")]


@pytest.mark.parametrize(
    "read, error",
    [
        (lambda s: files.read_parquet(s, "/no/such/folder"), "PATH_NOT_FOUND"),
        (lambda s: files.read_lines(s, "/no/such/folder"), "PATH_NOT_FOUND"),
        (lambda s: files.read_table(s, "missing", "no_such_db"), "TABLE_OR_VIEW_NOT_FOUND"),
    ],
)
def test_missing_sources(spark, read, error):
    with pytest.raises(AnalysisException) as caught:
        read(spark).count()
    assert caught.value.getCondition() == error


def test_catalog_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.range(3).write.mode("overwrite").saveAsTable("shop.items")
    assert files.read_table(spark, "items", "shop").count() == 3
    spark.sql("DROP TABLE shop.items")
    spark.sql("DROP DATABASE shop")


def test_one_document_per_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": i, "tags": {"a": "b"}}, indent=2))
    docs = files.read_docs(spark, str(tmp_path), "id int, tags map<string,string>", one_per_file=True)
    assert sorted(r["id"] for r in docs.collect()) == [0, 1, 2]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(5)
    assert sinks.write_once(df, path) == path
    with pytest.raises(AnalysisException) as caught:
        sinks.write_once(df, path)
    assert caught.value.getCondition() == "PATH_ALREADY_EXISTS"
    sinks.write_once(spark.range(2), path, "overwrite")
    assert spark.read.parquet(path).count() == 2
    other = sinks.write_once(df, path + "2", "new_run_prefix", run_id="20260101T000000Z")
    assert other.endswith("out2/run_id=20260101T000000Z")
    with pytest.raises(ValueError):
        sinks.write_once(df, path, "ignore")


def test_hot_partition_value_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        df = spark.range(300_000).selectExpr("id", "IF(id % 3 > 0, 'hot', 'cold') AS part")
        sinks.write_partitioned(df, str(tmp_path / "out"), "part")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    hot = [f for f in os.listdir(tmp_path / "out" / "part=hot") if f.endswith(".parquet")]
    assert len(hot) > 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300_000
    sinks.write_partitioned(df, str(tmp_path / "one"), "part", files=1)
    assert len([f for f in os.listdir(tmp_path / "one" / "part=hot") if f.endswith(".parquet")]) == 1


def test_stage_and_validate(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "1.5"), (3, None)], "id int, amount string")
    stored, counts = sinks.stage_and_validate(
        df, str(tmp_path), {"not_double": F.col("amount").try_cast("double").isNull()}
    )
    assert stored.count() == 3 and rows(counts) == [("not_double", 2)]
    assert (tmp_path / "_staging").is_dir()


def test_run_metrics_of_empty_output(spark):
    got = sinks.run_metrics(spark, "r", spark.range(4), {"x": spark.range(0)}).first()
    assert (got["input_rows"], got["x_rows"]) == (4, 0)
    assert got["metrics"] == '{"input_rows":4,"run_id":"r","x_rows":0}'


def test_summarise_job(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = generators.synth_events(spark.range(1, 1001), 1000)
    events.write.option("header", True).csv(source)
    metrics = jobs.summarise_events(spark, source, out, "r1", files=1).first()
    daily = spark.read.parquet(out + "/daily_country")
    assert metrics["input_rows"] == 1000 == daily.agg(F.sum("event_count")).first()[0]
    assert metrics["daily_country_rows"] == daily.count()
    assert metrics["event_type_rows"] == 4
    assert set(daily.columns) == {
        "run_id", "event_date", "country", "event_count", "unique_customers", "net_amount",
        "average_amount", "processed_at",
    }
    by_type = spark.read.parquet(out + "/event_type_summary")
    assert by_type.where("event_type = 'view'").first()["net_amount"] == 0.0


def test_generator_jobs(spark, tmp_path):
    ratio = jobs.count_skewed(spark, str(tmp_path / "a"), "r").first()
    assert ratio["skew_ratio"] == 100
    load = jobs.count_shuffled(spark, str(tmp_path / "b"), "r")
    assert load.agg(F.sum("row_count"), F.sum("key_count")).first() == (50_000, 64)
    sides = jobs.count_joined(spark, str(tmp_path / "c"), "r")
    assert {r["joined_rows"] for r in sides.collect()} == {200_000} and sides.count() == 100
    assert jobs.count_hotspot(spark, str(tmp_path / "d"), "r").count() == 7
    assert spark.read.json(str(tmp_path / "d")).agg(F.max("row_count")).first()[0] == 240_000


def test_generated_events(spark):
    n = 20_000
    events = generators.synth_events(spark.range(1, n + 1), n).cache()
    share = {r["event_type"]: r["count"] / n for r in events.groupBy("event_type").count().collect()}
    for kind, want in zip(EVENT_TYPES, (0.52, 0.25, 0.20, 0.03)):
        assert share[kind] == pytest.approx(want, abs=0.02)
    span = {
        r["event_type"]: (r["lo"], r["hi"])
        for r in events.groupBy("event_type").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi")).collect()
    }
    assert span["view"] == (0.0, 0.0)
    assert 10 <= span["cart"][0] and span["cart"][1] <= 250
    assert 15 <= span["purchase"][0] and span["purchase"][1] <= 500
    assert -200 <= span["refund"][0] and span["refund"][1] <= -5
    assert {r[0] for r in events.select("country").distinct().collect()} == set(COUNTRIES)
    assert events.agg(F.min("event_ts")).first()[0] >= "2026-01-01T00:00:00Z"
    assert events.agg(F.max("event_ts")).first()[0] <= "2026-01-15T00:00:00Z"
    assert events.agg(F.max("customer_id")).first()[0] <= "cust-002500"
    events.unpersist()


def test_generated_events_do_not_depend_on_partitioning(spark):
    ids = spark.range(1, 500)
    one = generators.synth_events(ids.coalesce(1), 500)
    many = generators.synth_events(ids.repartition(13), 500)
    assert rows(one) == rows(many)
    assert rows(generators.synth_events(ids, 500, seed=1)) != rows(one)


def test_event_log(spark, tmp_path):
    def task(stage, task_id, launch, finish, spill):
        return {
            "Event": "SparkListenerTaskEnd",
            "Stage ID": stage,
            "Task Info": {"Task ID": task_id, "Launch Time": launch, "Finish Time": finish},
            "Task Metrics": {"Memory Bytes Spilled": spill, "Disk Bytes Spilled": 0},
        }

    mb = 2**20
    log = [{"Event": "SparkListenerLogStart"}, {"Event": "SparkListenerTaskEnd", "Stage ID": 9}]
    lost = {**task(1, 5, 1_000, 61_000, 0), "Task End Reason": {"Reason": "ExecutorLostFailure"}}
    lost["Task Metrics"]["Input Metrics"] = {"Bytes Read": 3 * 2**30}
    log.append(lost)
    log += [task(0, 1, 0, 60_000, mb), task(0, 2, 0, 120_000, mb), task(0, 3, 0, 720_000, 2 * mb)]
    started = {**task(1, 4, 5, 0, None), "Event": "SparkListenerTaskStart"}
    begun = {**task(0, 3, 0, 0, None), "Event": "SparkListenerTaskStart"}
    # A rolled log: the start of task 3 is in another file than its end.
    (tmp_path / "eventlog_v2_app-1").mkdir()
    for n, part in enumerate([[begun, *log[:3]], [*log[3:], started]], 1):
        path = tmp_path / "eventlog_v2_app-1" / f"events_{n}_app-1"
        path.write_text("\n".join(map(json.dumps, part)))
    got = {
        r["stage_id"]: r for r in task_metrics.task_signals(files.read_event_log(spark, str(tmp_path))).collect()
    }
    assert tuple(got[0])[:2] == ("app-1", 0)
    assert got[0]["max_task_runtime_minutes"] == 12.0
    assert got[0]["median_task_runtime_minutes"] == 2.0
    assert (got[0]["skew_ratio"], got[0]["shuffle_spill_mb"]) == (6, 4)
    assert (got[0]["active_stage_count"], got[0]["executor_failures"], got[0]["elapsed_minutes"]) == (0, 0, 12.0)
    assert (got[1]["active_task_count"], got[1]["max_task_runtime_minutes"]) == (1, 1.0)
    assert (got[1]["active_stage_count"], got[1]["executor_failures"], got[1]["input_gb"]) == (1, 1, 3.0)
    assert got[1]["elapsed_minutes"] == 1.02


def test_stage_without_finished_tasks(spark):
    df = spark.createDataFrame(
        [("a", 1, 5, None, 0, 0), ("a", 2, 5, 65_005, 1, 1)],
        "run_id string, stage_id int, launch_ms long, finish_ms long, memory_spilled long, disk_spilled long",
    )
    got = {r["stage_id"]: r for r in task_metrics.task_signals(df).collect()}
    assert got[1]["median_task_runtime_minutes"] is None and got[1]["skew_ratio"] == 1
    assert got[2]["median_task_runtime_minutes"] == 1.08


def test_jdbc_options():
    options = jdbc.jdbc_options("jdbc:x", query="SELECT 1;", fetchsize=1, props={"user": "u"})
    assert options == {"url": "jdbc:x", "dbtable": "(SELECT 1) source", "fetchsize": "1", "user": "u"}
    assert jdbc.partition_options("id", 1, 100, 4) == {
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "100", "numPartitions": "4",
    }
    for bad in ({}, {"query": "q", "table": "t"}, {"table": "t", "fetchsize": 0}):
        with pytest.raises(ValueError):
            jdbc.jdbc_options("jdbc:x", **bad)
    with pytest.raises(ValueError):
        jdbc.partition_options("id", 5, 1, 4)


def test_scratch_is_below_the_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert re.match(re.escape(shared_folder(spark)) + r"/scratch-[0-9a-f]+/x-[0-9a-f]+$", scratch(spark, "x"))
    assert scratch(spark, "x") != scratch(spark, "x")


@pytest.mark.parametrize("name", ["csv_roundtrip", "docs_roundtrip", "stream_quarantine", "event_log_signals"])
def test_a_run_leaves_nothing_behind(spark, name):
    before = set(os.listdir(shared_folder(spark)))
    with scratch_space(spark) as path:
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert os.listdir(path)
    assert set(os.listdir(shared_folder(spark))) == before



def test_literal_rows_are_broadcast(spark):
    small = literal_rows(spark, [("a", ["x"]), ("b", None)], "k string, v array<string>")
    assert rows(small) == [("a", ["x"]), ("b", None)]
    big = spark.range(100).selectExpr("cast(id AS STRING) AS k")
    assert "BroadcastHashJoin" in big.join(small, "k")._jdf.queryExecution().toString()
    assert literal_rows(spark, [], "k string").count() == 0


def test_packed_event_logs(spark, tmp_path):
    """A rolled log whose parts are packed belongs to one run; the query's own log is stored packed."""
    import gzip

    for n, kind in ((1, "Start"), (2, "End")):
        info = {"Task ID": 3, "Launch Time": 0, "Finish Time": 60_000 * (n - 1)}
        event = {"Event": f"SparkListenerTask{kind}", "Stage ID": 0, "Task Info": info}
        (tmp_path / f"events_{n}_app-1.gz").write_bytes(gzip.compress(json.dumps(event).encode()))
    (got,) = files.read_event_log(spark, str(tmp_path)).collect()
    assert (got["run_id"], got["task_id"], got["finish_ms"]) == ("app-1", 3, 60_000)
    with scratch_space(spark) as path:
        QUERIES["event_log_signals"](spark, "/root/testdata/sf0.01").collect()
        local = path.removeprefix("file:")
        (log,) = [f"{local}/{f}" for f in os.listdir(local) if f.startswith("event-log")]
        parts = [f for f in os.listdir(log) if f.startswith("part")]
        assert parts and all(f.endswith(".lz4") for f in parts)
        chars = spark.read.text(log).selectExpr("sum(length(value) + 1)").first()[0]
        assert 3 * sum(os.path.getsize(f"{log}/{f}") for f in parts) < chars
