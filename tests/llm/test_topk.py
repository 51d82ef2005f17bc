"""Top-k against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobscope.llm import topk
from jobscope.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connect, difference

SCHEMA = "vec_id long, embedding array<float>, vector int, id string"


def plain(rows, asks, k, scale):
    fit = {
        (i, tuple(v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    whole = [(i, [math.floor(x * scale) for x in v]) for i, v in fit]
    out = []
    for q in {i for i, _ in whole if asks(i)}:
        scores = {
            (-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(u, v)))), i)
            for j, u in whole
            if j == q
            for i, v in whole
            if i != q and len(u) == len(v)
        }
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_sql(spark):
    con = connect(f"{DATA}/sf0.01")
    assert difference(QUERIES["op3_exact_top_k"](spark, f"{DATA}/sf0.01"), con, ORACLES["op3_exact_top_k"]) is None


@pytest.mark.parametrize("row_block,query_block", [(8192, 1024), (16, 4), (3, 100)])
def test_blocks_ties_and_copies(spark, row_block, query_block):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.standard_normal((90, 7)) * 2) / 4
    rows = [(i, vectors[i // 3].tolist(), i, "x") for i in range(90)] + [(5, vectors[1].tolist(), 0, "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 4, scale=8.0, row_block=row_block, query_block=query_block)
    assert found(got) == plain(rows, lambda i: i % 10 == 0, 4, 8.0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -2.0]), (10, [1.0, 1.0]), (20, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (30, [inf, 0.0]),
        (None, [5.0, 5.0]), (40, [1.0]), (41, [2.0]), (50, []), (51, []), (60, [3e37, 1.0]), (7, [3e37, -1.0]), (60, [3e37, 1.0]),
    ]
    rows = [(*r, 0, None) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *m) for i, v, *m in rows]
    for blocks in (8192, 2):
        got = topk.top_k(df, F.col("vec_id") % 10 == 0, 3, scale=256.0, row_block=blocks, query_block=blocks)
        assert found(got) == plain(rows, lambda i: i % 10 == 0, 3, 256)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 3).collect() == []
