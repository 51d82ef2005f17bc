"""Hard negatives against all scores, and the residue arithmetic against whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobscope.llm import hard_negatives
from jobscope.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connect, difference

SCHEMA = "vec_id long, label int, embedding array<double>, id string, score int, rank string"
LONG = 2**63 - 1


def test_sql(spark):
    con = connect(f"{DATA}/sf0.01")
    name = "op12_hard_negatives"
    assert difference(QUERIES[name](spark, f"{DATA}/sf0.01"), con, ORACLES[name]) is None


@pytest.mark.parametrize("size", [1, 300, 2**31, 2**61, 10**40, 10**300])
@pytest.mark.parametrize("dims", [0, 1, 5, 700])
def test_scores_are_exact(size, dims):
    rng = np.random.default_rng(dims)
    made = [[int(size * x) for x in row] for row in rng.uniform(-1, 1, (9, dims))]
    made[0] = [size] * dims
    whole = np.array(made, np.int64 if size < 2**62 else object).reshape(9, dims)
    want = [[max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(u, v)))) for v in made] for u in made]
    assert hard_negatives.scores(whole, whole).tolist() == want
    assert hard_negatives.scores(-whole, whole)[0, 0] == max(-LONG - 1, -dims * size * size)


def test_partial_sums_stay_exact():
    for dims in (1, 64, 768, 5000):
        width, primes = hard_negatives.moduli(dims, dims * 256 * 256)
        assert width * (max(primes) // 2) ** 2 < 2**24 and math.prod(primes) > 2 * dims * 256 * 256


def plain(rows, positives=5, negatives=5, scale=256):
    fit = {
        (i, label, tuple(v))
        for i, label, v, *_ in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    whole = [(i, label, [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, label, v in fit]
    out = []
    for i, label, v in whole:
        if i % 10:
            continue
        met = sorted(
            (-max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(u, v)))), j, other)
            for j, other, u in whole
            if j != i and len(u) == len(v)
        )
        for p, j, _ in [m for m in met if m[2] == label][:positives]:
            fits = [m for m in met if m[2] != label and -80 * p <= -100 * m[0] <= -100 * p][:negatives]
            out += [(i, j, n + 1, m[1], -p, -m[0]) for n, m in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("row_block,anchor_block", [(4096, 8192), (16, 3), (3, 100)])
def test_blocks_ties_and_copies(spark, row_block, anchor_block):
    rng = np.random.default_rng(4)
    base = np.round(rng.standard_normal((70, 6)) * 3) / 4
    rows = [(i, i % 4 if i % 3 else 0, base[i // 2].tolist(), "x", i, None) for i in range(140)]
    rows += [rows[7], (21, 1, rows[21][2], None, None, "again")]  # a copy, and one in other columns' clothes
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    for merged in ("false", "true"):  # cells of a block have to meet in whatever partition
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
        got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, row_block=row_block, anchor_block=anchor_block)
        found = sorted(map(tuple, got.collect()))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert found == want and len(want) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.9]), (2, 2, [1.0, 0.8]), (3, 2, [0.9, 1.0]), (4, 3, [1.0, 0.9]), (5, None, [1.0, 0.9]),
        (6, 2, None), (7, 2, [nan, 1.0]), (8, 2, [1.0, None]), (9, 2, [inf, 1.0]), (None, 2, [1.0, 0.9]), (10, 3, [0.0, 0.0]),
        (11, 3, [0.0, 0.0]), (12, 1, [0.0, 0.0]), (20, 5, [1.0]), (21, 5, [2.0]), (22, 6, [1.9]), (30, 5, []), (31, 5, []),
        (32, 6, []), (40, 7, [-1.0, 0.0, 0.0]), (41, 7, [1.0, 0.0, 0.0]), (42, 8, [1.0, 0.0, 0.0]), (50, 1, [3e300, 1.0, 2.0, 1.0]),
        (51, 1, [3e300, 1.0, 2.0, 1.0]), (52, 2, [2.9e300, 1.0, 2.0, 1.0]), (0, 1, [1.0, 1.0]), (0, 2, [0.9, 0.9]),
    ]
    rows = [(*v, "c", 1, None) for v in vectors]
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (4096, 2):
        got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, row_block=block, anchor_block=block)
        assert sorted(map(tuple, got.collect())) == plain(rows)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(df.where("label = 1"), F.col("vec_id") % 10 == 0).collect() == []


def test_labels_of_any_type(spark):
    rows = [(0, "a", [1.0, 1.0]), (1, "a", [1.0, 1.0]), (2, "a ", [1.0, 0.875]), (3, "b", [0.875, 0.875])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    got = hard_negatives.mine(df, F.col("vec_id") == 0, scale=8)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 2, 128, 120), (0, 1, 2, 3, 128, 112)]
