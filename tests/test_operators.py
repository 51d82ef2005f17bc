"""Joins, pods, plan trees, diagnostics, retention, medians, guarded functions."""

from __future__ import annotations

import datetime as dt
import json
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobscope.functions.medians import grouped_median
from jobscope.operators import diagnostics, joins, lifecycle, plan_trees, pods, rollups, udfs
from jobscope.sources.generators import synth_range
from tests.conftest import rows


def test_join_volume_equals_the_join(spark):
    left = synth_range(spark, 300, "IF(id % 3 = 0, 1, id % 20) AS k")
    right = synth_range(spark, 50, "id % 15 AS k")
    real = left.join(right, "k").groupBy("k").agg(F.count(F.lit(1)).alias("joined_rows"))
    assert rows(joins.join_volume(left, right, "k")) == rows(real)


def test_prefilter_drops_nothing_it_should_keep(spark):
    fact = synth_range(spark, 100, "id % 10 AS k", "id")
    dim = synth_range(spark, 20, "id % 10 AS k", "id AS d")
    kept = joins.prefilter(fact, dim, "k", F.col("d") < 3)
    assert {r["k"] for r in kept.collect()} == {0, 1, 2} and kept.count() == 30
    assert joins.prefilter_join(fact, dim, "k", F.col("d").isin(0, 10)).count() == 20


def test_missing_indexes(spark):
    keys = spark.createDataFrame(
        [("orders", "customer_id"), ("orders", "Id"), ("items", "order_id"), ("items", "order_id")],
        "tablename string, column_name string",
    )
    indexes = spark.createDataFrame(
        [
            ("orders", 'CREATE UNIQUE INDEX pk ON public.orders USING btree ("id")'),
            ("items", "CREATE INDEX i ON public.items USING btree (sku, order_id)"),
        ],
        "tablename string, indexdef string",
    )
    assert rows(joins.missing_indexes(keys, indexes)) == [
        ("items", "order_id"),
        ("orders", "customer_id"),
    ]


def pod(spark, metadata=None, status=None):
    doc = {"metadata": metadata or {}, "status": status or {}}
    return spark.createDataFrame([(json.dumps(doc),)], "j string").select(
        F.from_json("j", pods.POD_DDL).alias("p")
    ).select("p.*")


@pytest.mark.parametrize(
    "status, pending, image",
    [
        ({"phase": "Pending"}, True, False),
        ({"phase": "Running"}, False, False),
        ({}, False, False),
        ({"conditions": [{"type": "PodScheduled", "status": "FALSE", "reason": "Unschedulable"}]}, True, False),
        ({"conditions": [{"type": "PodScheduled", "status": "False", "reason": "Other"}]}, False, False),
        ({"conditions": [{"type": "Ready", "status": "False", "reason": "Unschedulable"}]}, False, False),
        ({"containerStatuses": [{"state": {}}, {"state": {"waiting": {"reason": "ErrImagePull"}}}]}, False, True),
        ({"containerStatuses": [{"state": {"waiting": {"reason": "CrashLoopBackOff"}}}]}, False, False),
    ],
)
def test_pod_signals(spark, status, pending, image):
    row = pods.pod_signals(pod(spark, status=status)).first()
    assert (row["pending"], row["image_pull"]) == (pending, image)


@pytest.mark.parametrize(
    "metadata, want",
    [
        ({"name": "driver-jr-1"}, True),
        ({"name": "x", "labels": {"run": "jr-1"}}, True),
        ({"name": "x", "labels": {"jr-1": "y"}}, True),
        ({"name": "x", "annotations": {"a": "see jr-1 there"}}, True),
        ({"name": "x", "labels": {"run": "jr-2"}}, False),
        ({}, False),
    ],
)
def test_pod_mentions_run(spark, metadata, want):
    df = pod(spark, metadata)
    assert df.select(pods.mentions_run(F.col("metadata"), F.lit("jr-1"))).first()[0] is want


def test_pod_summary(spark):
    def summary(*docs):
        df = spark.createDataFrame([(json.dumps({"items": list(docs)}),)], "j string")
        item = f"items array<struct<{pods.POD_DDL}>>".replace("metadata struct", "metadata:struct").replace("status struct<phase", "status:struct<phase")
        listing = df.select(F.from_json("j", item).alias("l"))
        return listing.select(pods.pod_summary(F.col("l.items"))).first()[0]

    assert summary() == "no matching pods"
    assert (
        summary({"metadata": {"name": "a"}, "status": {"phase": "Running"}}, {"metadata": {}, "status": {}})
        == "a:Running, unknown:unknown"
    )


SCAN = {"Node Type": "Seq Scan", "Relation Name": "meter_readings", "Plan Rows": 7_300_111}
PLAN = {
    "Plan": {
        "Node Type": "Aggregate",
        "Plans": [
            {
                "Node Type": "Nested Loop",
                "Plan Rows": 12,
                "Plans": [
                    {"Node Type": "Bitmap Heap Scan", "Relation Name": "tariffs", "Plan Rows": 40},
                    {"Node Type": "Materialize", "Plan Rows": 7_300_111, "Plans": [SCAN]},
                ],
            }
        ],
    }
}
CLEAN = {"Plan": {"Node Type": "Hash Join", "Plans": [{"Node Type": "Index Scan", "Relation Name": "t", "Plan Rows": 10}]}}


def nodes(spark, *documents):
    df = spark.createDataFrame(list(enumerate(documents)), "plan_id int, document string")
    return plan_trees.flag_nodes(plan_trees.plan_nodes(df)).orderBy("plan_id", "plan_no", "node_no").collect()


def test_bad_plan(spark):
    got = nodes(spark, json.dumps(PLAN))
    assert [(r["depth"], r["node_type"], r["relation"], r["plan_rows"]) for r in got] == [
        (0, "Aggregate", None, None),
        (1, "Nested Loop", None, 12),
        (2, "Bitmap Heap Scan", "tariffs", 40),
        (2, "Materialize", None, 7_300_111),
        (3, "Seq Scan", "meter_readings", 7_300_111),
    ]
    assert [r["large_nested_loop"] for r in got] == [False, True, False, False, False]
    assert [r["large_seq_scan"] for r in got] == [False, False, False, False, True]
    assert {r["problem"] for r in got} == {None}


def test_no_plan_of_a_list_is_lost(spark):
    got = nodes(spark, json.dumps([CLEAN, {"Plan": SCAN}, {"Plan": []}, 3]))
    assert [(r["plan_no"], r["node_type"], r["problem"]) for r in got] == [
        (0, "Hash Join", None),
        (0, "Index Scan", None),
        (1, "Seq Scan", None),
        (2, None, "no plan"),
        (3, None, "no plan"),
    ]


def test_what_is_no_plan_gives_a_reason(spark):
    got = nodes(spark, "{not json", "[]", "7", '{"Plan": null}', None, "", "[" * 200_000)
    assert [r["problem"] for r in got[:6]] == ["not JSON", "no plan", "no plan", "no plan", "no document", "not JSON"]
    assert len(got) == 7 and got[6]["problem"] in ("not JSON", "nested too deep")
    assert not any(r["large_seq_scan"] or r["large_nested_loop"] for r in got)


def test_odd_values_do_not_end_the_job(spark):
    odd = ["many", True, [1], {}, 1e400, 10**30, 2.5, "12"]
    got = nodes(spark, *[json.dumps({"Plan": {"Node Type": 5, "Plan Rows": v, "Plans": ["x", SCAN]}}) for v in odd])
    roots = [r for r in got if r["depth"] == 0]
    assert [r["plan_rows"] for r in roots] == [None] * 6 + [2, None]
    assert all("Node Type is not text" in r["problem"] and "Plans holds" in r["problem"] for r in roots)
    assert [r["node_type"] for r in got if r["depth"] == 1] == ["Seq Scan"] * 8


def test_many_nodes_leave_in_pieces(spark):
    flat = json.dumps({"Plan": {"Node Type": "Append", "Plans": [SCAN] * 25_000}})
    assert len(nodes(spark, flat, flat)) == 50_002


def test_plan_of_any_depth(spark):
    tree = {"Node Type": "Leaf"}
    for _ in range(300):
        tree = {"Node Type": "Limit", "Plans": [tree]}
    got = nodes(spark, json.dumps({"Plan": tree}))
    assert len(got) == 301 and got[-1]["depth"] == 300 and got[-1]["node_type"] == "Leaf"


def test_active_queries(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame(
        [
            (1, "main", "active", None, None, t, "q" * 2000),
            (2, "main", "idle", None, None, None, None),
            (3, "other", "active", None, None, t, "x"),
            (4, "main", "active", "Lock", "tuple", t - dt.timedelta(minutes=1), "slow"),
        ],
        "pid int, datname string, state string, wait_event_type string, wait_event string, "
        "query_start timestamp_ntz, query string",
    )
    got = diagnostics.active_queries(df, F.lit(t + dt.timedelta(seconds=30)).cast("timestamp_ntz"), "main")
    assert [(r["pid"], r["query_age"]) for r in got.collect()] == [(4, 90), (1, 30), (2, None)]
    assert len(got.collect()[1]["query_excerpt"]) == 1000


def test_index_inventory(spark):
    df = spark.createDataFrame(
        [("pg_catalog", "a", "a", ""), ("s", "t", "b", ""), ("s", "t", "a", ""), ("information_schema", "x", "x", "")],
        "schemaname string, tablename string, indexname string, indexdef string",
    )
    assert [r["indexname"] for r in diagnostics.index_inventory(df).collect()] == ["a", "b"]


def test_retention(spark):
    t = dt.datetime(2026, 1, 20)
    df = spark.createDataFrame(
        [
            ("raw", t - dt.timedelta(days=7)),
            ("raw", t - dt.timedelta(days=7, seconds=1)),
            ("logs", t - dt.timedelta(days=14)),
            ("logs", t - dt.timedelta(days=15)),
            ("other", t - dt.timedelta(days=900)),
            (None, t - dt.timedelta(days=900)),
        ],
        "object_class string, modified_at timestamp_ntz",
    )
    as_of = F.lit(t).cast("timestamp_ntz")
    assert [r[0] for r in rows(lifecycle.expired(df, as_of))] == ["logs", "raw"]
    assert lifecycle.expired(df, as_of, {"other": 1}).count() == 1


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-9, 9)), min_size=1, max_size=60))
def test_grouped_median(spark, pairs):
    df = spark.createDataFrame(pairs, "g int, v int")
    want = {g: float(statistics.median(v for h, v in pairs if h == g)) for g, _ in pairs}
    assert dict(rows(grouped_median(df, ["g"], "v", "m"))) == want


def test_guarded_function(spark):
    half = udfs.guarded(lambda s: int(s) // 2, "bigint")
    df = spark.createDataFrame([("10",), ("x",), (None,)], "s string")
    got = [tuple(r["r"]) for r in df.coalesce(1).select(half("s").alias("r")).collect()]
    assert got[0] == (5, None)
    assert got[1][0] is None and got[1][1].startswith("ValueError: invalid literal")
    assert got[2][0] is None and got[2][1].startswith("TypeError")


def test_profile_counts_only_listed_values(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("z", "y")], "c string, d string")
    assert rows(rollups.profile(df, {"c": ["a", "b"], "d": ["y"]})) == [
        ("c", "a", 2),
        ("c", "b", 0),
        ("d", "y", 1),
    ]


def test_stamp(spark):
    row = rollups.stamp(spark.range(1), "r", F.current_timestamp()).first()
    assert row["run_id"] == "r" and row["processed_at"] is not None


def test_approximate_customers(spark):
    df = synth_range(
        spark, 1000, "date'2026-01-01' AS event_date", "'AU' AS country", "id AS customer_id", "1.0D AS amount"
    )
    assert rollups.daily(df, approximate=True).first()["unique_customers"] == pytest.approx(1000, rel=0.1)
