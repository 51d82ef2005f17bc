"""Stored distinct counts, frequent keys, Bloom joins and subtotals against plain counts."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobscope.operators import distincts, joins, rollups, skew
from jobscope.sources.generators import synth_range
from tests.conftest import rows


def day_events(spark, n, customers):
    return synth_range(
        spark, n, "date_add(DATE'2026-01-01', CAST(id % 5 AS INT)) AS event_date", "IF(id % 3 = 0, 'AU', NULL) AS country",
        f"IF(id % 11 = 0, NULL, CONCAT('c', pmod(xxhash64(id), {customers}))) AS customer_id",
    )


def test_merged_days_are_close_and_events_exact(spark, tmp_path):
    events = day_events(spark, 200_000, 50_000)
    path = str(tmp_path / "days")
    distincts.store_days(distincts.day_sketches(events), path)
    since, until = dt.date(2026, 1, 2), dt.date(2026, 1, 4)
    kept = events.where(F.col("event_date").between(F.lit(since), F.lit(until)))
    exact = {r[0]: r[1:] for r in kept.groupBy("country").agg(F.count("*"), F.count_distinct("customer_id")).collect()}
    got = {r[0]: r[1:] for r in distincts.merge_days(distincts.stored_days(spark, path), since=since, until=until).collect()}
    assert got.keys() == exact.keys() == {"AU", None}
    for country, (n, customers) in exact.items():
        assert got[country][0] == n
        assert abs(got[country][1] - customers) <= 4 * distincts.relative_error() * customers
    everything = distincts.merge_days(distincts.stored_days(spark, path), []).first()
    assert everything[0] == 200_000 and abs(everything[1] - 50_000) < 0.04 * 50_000


def test_a_stored_day_is_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "days")
    first = day_events(spark, 1_000, 100)
    distincts.store_days(distincts.day_sketches(first), path)
    again = first.where("event_date = DATE'2026-01-03'").limit(7)
    distincts.store_days(distincts.day_sketches(again), path)
    stored = distincts.stored_days(spark, path).groupBy("event_date").agg(F.sum("event_count")).collect()
    assert {r[0].day: r[1] for r in stored} == {1: 200, 2: 200, 3: 7, 4: 200, 5: 200}
    plan = distincts.merge_days(distincts.stored_days(spark, path), since=dt.date(2026, 1, 4))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_no_days(spark):
    none = distincts.day_sketches(day_events(spark, 0, 1))
    assert distincts.merge_days(none).collect() == []


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.sampled_from(["a", "b", "c", None, ""]), st.integers(1, 400)), max_size=6),
    st.integers(0, 3_000),
    st.sampled_from([0.01, 0.05, 0.3, 1.0, 0.000001]),
)
def test_hot_keys_are_exact(spark, hot, cold, share):
    keys = [k for k, n in hot for _ in range(n)] + [f"k{i}" for i in range(cold)]
    df = spark.createDataFrame([(k, 1) for k in keys], "k string, _item int")
    counts = Counter(keys)
    want = sorted(((k, n) for k, n in counts.items() if n >= share * len(keys)), key=lambda r: tuple(map(str, r)))
    assert rows(skew.hot_keys(df, "k", share)) == want


def test_hot_keys_of_other_types(spark):
    df = synth_range(spark, 1_000, "IF(id % 2 = 0, CAST('NaN' AS DOUBLE), id) AS d", "IF(id % 4 = 0, X'00', X'01') AS b")
    assert [r["row_count"] for r in skew.hot_keys(df, "d", 0.1).collect()] == [500]
    assert sorted(r["row_count"] for r in skew.hot_keys(df, "b", 0.1).collect()) == [250, 750]


def test_only_candidates_are_shuffled(spark):
    df = synth_range(spark, 100_000, "IF(id % 3 = 0, -1, id) AS k")
    plan = skew.hot_keys(df, "k", 0.1)._jdf.queryExecution().executedPlan().toString()
    [counted] = plan.split("hashpartitioning(k")[1:]
    assert counted.index("partial_count") < counted.index("LeftSemi") < counted.index("Range")


@pytest.mark.parametrize("broadcast_keys,most_words", [(0, 1 << 21), (10**6, 1 << 21), (0, 1)])
def test_bloom_join_is_the_join(spark, broadcast_keys, most_words):
    fact = synth_range(spark, 20_000, "IF(id % 9 = 0, NULL, id % 5000) AS k", "id AS _at", "id AS _set")
    dim = synth_range(spark, 3_000, "IF(id % 7 = 0, NULL, id * 3) AS k", "id AS d").unionByName(
        spark.createDataFrame([(3, 99), (3, 98)], "k long, d long")
    )
    got = joins.bloom_join(fact, dim, "k", F.col("d") % 2 == 0, broadcast_keys, most_words)
    want = fact.join(dim.where("d % 2 = 0"), "k")
    assert rows(got) == rows(want) and got.columns == want.columns


def test_bloom_filter_lets_few_others_pass(spark):
    keys = synth_range(spark, 50_000, "id * 2 AS k")
    words = 50_000 * joins.BITS_PER_KEY // 64
    sieve = joins.bloom_words(keys, "k", words)
    assert sieve.count() <= words
    probes = synth_range(spark, 100_000, "id AS k")
    bits = joins._bits(F.col("k"))
    passed = probes.join(sieve, joins._word(F.col("k"), words) == F.col("_word")).where(F.col("_set").bitwiseAND(bits) == bits)
    even, odd = passed.agg(F.count_if(F.col("k") % 2 == 0), F.count_if(F.col("k") % 2 == 1)).first()
    assert even == 50_000 and odd < 0.03 * 50_000


def test_facts_are_cut_before_the_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = synth_range(spark, 1_000, "id AS k", "id AS v")
        dim = synth_range(spark, 200, "id AS k", "id AS d")
        plan = joins.bloom_join(fact, dim, "k", F.col("d") >= 0, 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    facts = plan.split("SortMergeJoin")[1].split("Exchange hashpartitioning(k")[1]
    assert facts.index("BroadcastHashJoin") < facts.index("Range")


def test_bloom_join_of_empty_sides(spark):
    fact = synth_range(spark, 10, "id AS k")
    dim = synth_range(spark, 10, "id AS k", "id AS d")
    assert joins.bloom_join(fact, dim, "k", F.col("d") < 0, 0).collect() == []
    assert joins.bloom_join(fact.limit(0), dim, "k", F.col("d") >= 0, 0).collect() == []


@pytest.mark.parametrize("most_words", [joins.MOST_WORDS, 10])
def test_bloom_split_parts_are_the_rows(spark, most_words):
    fact = synth_range(spark, 20_000, "IF(id % 9 = 0, NULL, id % 5000) AS k", "id AS _at", "id AS `_set`", "id AS `a.b`")
    keys = synth_range(spark, 1_000, "IF(id % 7 = 0, NULL, id * 3) AS k", "id AS d")
    may, clear = joins.bloom_split(fact, keys, "k", most_words)
    assert may.columns == clear.columns == fact.columns
    assert rows(may.unionByName(clear)) == rows(fact)
    assert clear.join(keys, "k", "left_semi").isEmpty()
    assert rows(may.join(keys, "k", "left_semi")) == rows(fact.join(keys, "k", "left_semi"))
    assert rows(clear.unionByName(may.join(keys, "k", "left_anti"))) == rows(fact.join(keys, "k", "left_anti"))
    assert may.count() < 5_000 if most_words > 10 else clear.isEmpty()


def test_bloom_split_of_empty_sides(spark):
    fact = synth_range(spark, 10, "id AS k")
    may, clear = joins.bloom_split(fact, fact.limit(0), "k")
    assert may.isEmpty() and clear.count() == 10
    may, clear = joins.bloom_split(fact.limit(0), fact, "k")
    assert may.isEmpty() and clear.isEmpty()


def test_subtotals_tell_totals_from_null(spark):
    events = day_events(spark, 600, 50).withColumn("amount", F.expr("IF(event_date = DATE'2026-01-02', NULL, 0.1)"))
    plain = events.collect()
    want = Counter()
    for r in plain:
        for level, key in ((0, (r["event_date"], r["country"])), (1, (r["event_date"], None)), (2, (None, None))):
            want[(*key, level)] += 1
    got = rollups.subtotals(events).collect()
    assert {(r["event_date"], r["country"], r["level"]): r["event_count"] for r in got} == want
    top = next(r for r in got if r["level"] == 2)
    assert top["unique_customers"] == len({r["customer_id"] for r in plain} - {None}) and top["net_amount"] == 48.0
    assert rollups.subtotals(events.limit(0)).where("level < 2").collect() == []
