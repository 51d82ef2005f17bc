"""Mixing: targets by the contract, totals kept, no document more than twice, reruns agree."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobscope.llm import mixing
from jobscope.llm.common import stored
from jobscope.llm.queries import QUERIES
from jobscope.session import load
from tests.conftest import DATA


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), share * sum(sizes.values())
    while open_:
        rate = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * rate >= most * sizes[s]}
        if not above:
            return target | {s: weight[s] * rate for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= above
    return target


def check(documents, rows):
    """documents: (doc_id, text, source); rows: of the query."""
    sizes, largest = Counter(), Counter()
    for _, text, source in documents:
        sizes[source] += words(text)
        largest[source] = max(largest[source], words(text))
    target = plain_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, words(t)) for i, t, _ in documents)
    sources = defaultdict(set)
    for i, _, s in documents:
        sources[i].add(s)
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        fits = [s for s in sources[r["doc_id"]] if sizes[s] == r["source_size"] and abs(target[s] - r["target"]) < 1e-6 * (1 + target[s])]
        assert fits
        taken[fits[0]] += r["taken"]
    return {s: (taken[s], target[s], largest[s]) for s in sizes}


def test_whole_table(spark):
    documents = [tuple(r) for r in load(spark, f"{DATA}/sf0.01", "documents").select("doc_id", "text", "source").collect()]
    rows = QUERIES["op8_source_mixing"](spark, f"{DATA}/sf0.01").collect()
    for got, target, largest in check(documents, rows).values():
        assert abs(got - target) <= largest
    again = QUERIES["op8_source_mixing"](spark, f"{DATA}/sf0.01").collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_many_rounds_stay_balanced(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 60)), "s%d" % min(int(rng.integers(0, 12)), 4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.per_row(mixing.mix(df, flight_rows=50)).withColumn("taken", F.col("size") * F.col("copies"))
    for got, target, largest in check(rows, mixed.collect()).values():
        assert abs(got - target) <= largest


def test_odd_rows_and_repeats(spark):
    rows = [(None, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "one two", None), (5, "w " * 60_000, "é"), (6, "a b", "~"), (7, "", "0")]
    rows += [(8, "same words here", "x")] * 25_000
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, source string, size int, key int")
    mixed = stored(mixing.mix(df), "mix")
    got = mixing.per_row(mixed).withColumn("taken", F.col("size") * F.col("copies")).collect()
    for got_, target, largest in check(rows, got).values():
        assert abs(got_ - target) <= largest
    repeated = mixing.repeat(df, mixed)
    assert repeated.columns == df.columns
    want = Counter()
    for r in got:
        want[r["doc_id"]] += int(r["copies"])
    assert Counter(r["doc_id"] for r in repeated.collect()) == +want
    assert mixing.mix(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_flight_keeps_both_totals(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(0, 500, 400).astype(float)
    chance = np.full(400, rng.random())
    left = mixing.flight(chance, size, seed, False)
    open_ = (left != 0) & (left != 1)
    assert open_.sum() <= 2
    assert abs(left.sum() - chance.sum()) < 1e-4 and abs((left * size).sum() - (chance * size).sum()) < 1e-2
    landed = mixing.flight(chance, size, seed, True)
    assert set(landed.tolist()) <= {0.0, 1.0}
    assert abs((landed * size).sum() - (chance * size).sum()) <= 1000


def test_chances_are_kept_on_average():
    size = np.array([5.0, 9.0, 2.0, 7.0, 7.0, 1.0])
    chance = np.array([0.3, 0.3, 0.3, 0.3, 0.3, 0.3])
    mean = np.mean([mixing.flight(chance, size, s, True) for s in range(6000)], axis=0)
    assert np.abs(mean - chance).max() < 0.03


def test_columns_of_any_type(spark):
    """Rows are told apart by all their columns, maps and structs too, and repeated ones are mixed in blocks."""
    rows = [(i % 3, "some words here", "a", {"x": {1: "y"}}, (i % 2, {"k": 1})) for i in range(60)]
    kind = "doc_id long, text string, source string, m map<string,map<int,string>>, s struct<a:int,b:map<string,int>>"
    docs = spark.createDataFrame(rows, kind)
    mixed = stored(mixing.mix(docs), "mix")
    assert mixed.count() == 6 and mixed.agg({"rows": "sum"}).first()[0] == 60
    out = mixing.repeat(docs, mixed).collect()
    assert len(out) == mixed.agg({"copies": "sum"}).first()[0] and {str(r) for r in out} <= {str(r) for r in docs.collect()}
