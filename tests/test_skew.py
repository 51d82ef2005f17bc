from __future__ import annotations

import statistics
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobscope.operators import skew
from jobscope.operators.slices import running_counts
from jobscope.sources.generators import synth_range, synth_skewed
from tests.conftest import rows


def test_generated_skew(spark):
    counts = skew.key_counts(synth_skewed(spark), "customer_key")
    got = dict(rows(counts))
    assert got.pop("hot_customer") == 100_000
    assert got == {f"cold_customer_{i:03d}": 1_000 for i in range(1, 24)}
    assert rows(skew.skew_ratio(counts)) == [(100_000, 1_000, 100)]


def test_long_running_skew(spark):
    df = synth_skewed(spark, 24, 200_000, 2_000)
    assert sorted(r[1] for r in rows(skew.key_counts(df, "customer_key"))) == [2_000] * 23 + [200_000]
    assert df.where("source_partition = 3").agg(F.min("row_id"), F.max("row_id")).first() == (0, 1999)


def test_skew_ratio_is_at_least_one(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 2)], "k string, row_count bigint")
    assert skew.skew_ratio(counts).first()["skew_ratio"] == 1


def test_report_flags_the_hot_key_only(spark):
    report = {r["customer_key"]: r for r in skew.report(synth_skewed(spark), "customer_key").collect()}
    assert [k for k, r in report.items() if r["is_hot"]] == ["hot_customer"]
    hot = report["hot_customer"]
    assert hot["key_rank"] == 1 and hot["ratio_to_median"] == 100.0
    assert hot["share"] == pytest.approx(100_000 / 123_000)
    assert {r["key_rank"] for k, r in report.items() if k != "hot_customer"} == {2}


def test_hot_keys_are_bounded(spark):
    df = synth_range(spark, 1000, "id % 100 AS k")
    assert skew.hot_keys(df, "k", 0.01).count() == 100
    assert skew.hot_keys(df, "k", 0.011).count() == 0
    with pytest.raises(ValueError):
        skew.hot_keys(df, "k", 0)


def test_salted_count_equals_plain_count(spark):
    df = synth_skewed(spark, 5, 5_000, 50)
    plain = skew.key_counts(df, "customer_key")
    assert rows(skew.salted_count(df, "customer_key", ["row_id"], 7)) == rows(plain)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = synth_range(
        spark,
        3000,
        "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 11 = 0 THEN NULL ELSE id % 500 END AS k",
        "id AS l",
    )
    right = synth_range(spark, 600, "id % 300 AS k", "id AS r")
    salted = skew.salted_join(left, right, "k", ["l"], rows_per_task=300, min_share=0.1, how=how)
    plain = left.join(right, "k", how)
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=40),
    st.lists(st.one_of(st.none(), st.integers(0, 6)), max_size=15),
    st.sampled_from(["inner", "left"]),
    st.sampled_from([0.05, 0.3, 1.0]),
)
def test_salted_join_for_any_keys(spark, lefts, rights, how, share):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(lefts)], "k int, l int")
    right = spark.createDataFrame([(k, i) for i, k in enumerate(rights)], "k int, r int")
    salted = skew.salted_join(left, right, "k", ["l"], rows_per_task=4, min_share=share, how=how)
    assert rows(salted) == rows(left.join(right, "k", how))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 12), min_size=1, max_size=80))
def test_report_against_brute_force(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    counts = Counter(keys)
    sizes = sorted(set(counts.values()), reverse=True)
    median = statistics.median(counts.values())
    want = [
        (k, n, n / len(keys), n / median, sizes.index(n) + 1, n / median >= 2)
        for k, n in counts.items()
    ]
    assert rows(skew.report(df, "k", 2)) == sorted(want, key=lambda r: tuple(map(str, r)))


def test_salted_join_spreads_only_hot_keys(spark):
    left = synth_range(spark, 3000, "IF(id % 3 = 0, 1, id) AS k", "id AS l")
    right = synth_range(spark, 3000, "id AS k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.salted_join(left, right, "k", ["l"])._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(k" in plan and "_salt" in plan  # joined on (key, salt)


def test_salts_follow_the_size_of_the_hot_key(spark):
    def salts(n):
        df = synth_range(spark, n, "IF(id % 2 = 0, -1, id) AS k")
        return {r["k"]: r["salts"] for r in skew.key_salts(df, "k", rows_per_task=100).collect()}

    assert salts(2_000) == {-1: 10} and salts(4_000) == {-1: 20}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-50, 50)), min_size=1, max_size=120),
    st.sampled_from([2, 7, 1000]),
)
def test_running_counts_in_slices(spark, points, per_slice):
    """However small the slices, values stand where sorting the group puts them."""
    counts = Counter(points)
    rows_ = [(g, v, n) for (g, v), n in counts.items()]
    df = spark.createDataFrame(rows_, "g string, v int, n long")
    got = running_counts(df, "v", "n", ["g"], per_slice=per_slice, most=16)
    want = []
    for g, v, n in rows_:
        mine = [(w, m) for h, w, m in rows_ if h == g]
        smaller = [m for w, m in mine if w < v]
        want.append((g, v, n, sum(smaller), len(smaller), sum(m for _, m in mine), len(mine)))
    assert rows(got) == sorted(want, key=lambda r: tuple(map(str, r)))
    alone = running_counts(df.where("g = 'a'"), "v", "n", per_slice=per_slice, most=16)
    assert rows(alone) == [r for r in sorted(want, key=lambda r: tuple(map(str, r))) if r[0] == "a"]


def test_partitioned_count(spark):
    df = synth_range(spark, 50_000, "CAST(id % 64 AS STRING) AS shuffle_key")
    counts = skew.partitioned_count(df, "shuffle_key", 8)
    sizes = sorted(r["row_count"] for r in counts.collect())
    assert sizes == [781] * 48 + [782] * 16
    assert counts.rdd.getNumPartitions() == 8


def test_partition_load_is_where_spark_puts_the_rows(spark):
    df = synth_range(spark, 5_000, "CAST(id % 37 AS STRING) AS k")
    real = (
        df.repartition(6, "k")
        .groupBy(F.spark_partition_id().cast("int").alias("partition_id"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("k").alias("key_count"))
    )
    assert rows(skew.partition_load(df, "k", 6)) == rows(real)
