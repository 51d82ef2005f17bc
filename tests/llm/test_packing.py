"""Packing: exact ids, gapless places, few sequences."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobscope.llm import binpacking, packing
from jobscope.llm.common import stored
from jobscope.llm.queries import QUERIES, vocabulary
from jobscope.session import load
from tests.conftest import DATA


def cut(ids, capacity=1024):
    first = len(ids) % capacity or capacity
    edges = [0, *range(first, len(ids), capacity), len(ids)]
    return [ids[a:b] for a, b in zip(edges, edges[1:])]


def check_places(rows, capacity=1024):
    """Sequences are filled from 0 without gaps; gives their number."""
    inside = defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside)


def test_whole_table(spark):
    rows = QUERIES["op2_best_fit_packing"](spark, f"{DATA}/sf0.001").collect()
    exact = Tokenizer.from_file(vocabulary()[0])
    want, total = [], 0
    for d in load(spark, f"{DATA}/sf0.001", "documents").collect():
        ids = exact.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        start = 0
        for k, part in enumerate(cut(ids)):
            want.append((d["doc_id"], k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            start += len(part)
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got) == sorted(want)
    assert check_places(rows) <= -(-total // 1024) * 1.01 + 2


def test_odd_rows_and_real_sequences(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x y"), (4, "word " * 5000), (5, "a <|endoftext|> b"), (6, "\x00éあ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("z"), "piece": F.lit(0)})
    pieces = packing.pieces(df, *vocabulary())
    placed = stored(packing.pack(pieces), "placed")
    exact = Tokenizer.from_file(vocabulary()[0])
    want = Counter()
    for i, t in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [2]
        want.update((i, k, tuple(p)) for k, p in enumerate(cut(ids)))
    found = placed.collect()
    check_places(found)
    assert Counter((r["doc_id"], r["piece"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in found) == want
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(placed).collect()}
    for r in found:
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert packing.pack(packing.pieces(df.limit(0), *vocabulary())).collect() == []


def test_a_length_shared_by_all_is_sliced(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 50)
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(300).cast("long").alias("length"))
    assert check_places(packing.pack(df).collect()) == 234


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_histogram_is_packed_whole(lengths):
    runs = binpacking.pack_histogram(Counter(lengths), 64)
    held = Counter()
    for run in runs:
        assert sum(run.items) <= 64 and run.bins > 0
        for item in run.items:
            held[item] += run.bins
    assert held == Counter(lengths)


@pytest.mark.parametrize("low,high,n,slack", [(1, 1024, 20_000, 1.02), (200, 420, 50_000, 1.01), (300, 700, 20_000, 1.01)])
def test_few_bins(low, high, n, slack):
    lengths = np.random.default_rng(0).integers(low, high, n).tolist()
    bins = sum(r.bins for r in binpacking.pack_histogram(Counter(lengths), 1024))
    assert bins <= slack * max(sum(lengths) / 1024, sum(x > 512 for x in lengths)) + 1


def least_bins(counts, capacity=1024):
    """The LP bound for few lengths, from its dual: the best of all prices by which no filling is worth over 1.

    A dual optimum lies where as many fillings as there are lengths are worth exactly 1.
    """
    lengths = sorted(counts)
    fillings = [f for f in product(*[range(capacity // n + 1) for n in lengths]) if sum(map(int.__mul__, f, lengths)) <= capacity]
    fillings = [f for f in fillings if sum(map(int.__mul__, f, lengths)) + lengths[0] > capacity]
    every, need = np.array(fillings, float), np.array([counts[n] for n in lengths], float)
    limits = np.vstack((every, -np.eye(len(lengths))))
    bound = np.append(np.ones(len(every)), np.zeros(len(lengths)))
    best = 0.0
    for chosen in map(list, combinations(range(len(limits)), len(lengths))):
        if abs(np.linalg.det(limits[chosen])) > 1e-9:
            prices = np.linalg.solve(limits[chosen], bound[chosen])
            if (limits @ prices <= bound + 1e-9).all():
                best = max(best, float(need @ prices))
    return best


@pytest.mark.parametrize(
    "counts",
    [
        {400: 100_000, 300: 100_000},
        {300: 90_000, 410: 50_000},
        {361: 40_000, 487: 50_000, 569: 60_000},
        {270: 70_000, 390: 90_000, 450: 40_000},
        {330: 30_000, 334: 50_000, 364: 20_000, 566: 40_000},
        {290: 40_000, 380: 60_000, 422: 50_000, 440: 30_000, 600: 20_000},
    ],
)
def test_few_lengths_reach_the_bound(counts):
    runs = binpacking.pack_histogram(counts, 1024)
    held = Counter()
    for run in runs:
        assert sum(run.items) <= 1024
        for item in run.items:
            held[item] += run.bins
    assert held == counts
    assert sum(r.bins for r in runs) <= least_bins(counts) + len(counts)


def test_few_heavy_lengths_among_many():
    """Two lengths without a full filling hold most ids, and all others stand there once."""
    counts = {n: 1 for n in range(1, 1025)} | {400: 100_000, 300: 100_000}
    assert sum(r.bins for r in binpacking.pack_histogram(counts, 1024)) <= 75_000 + 1024


def test_fast_and_exact_ids_agree():
    path, ranks = vocabulary()
    fast, exact = packing.ByteTokenizer(path, ranks), Tokenizer.from_file(path)
    for text in ["", "a  b\n\n c", "I'll won't", "日本語 текст ñ", "\u0000​\U0001f600", "x" * 5000, "<|endoftext|>1"]:
        assert fast.ids(text) == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\r\n", "\u3000"])
def test_very_long_white_space(space):
    """The ids are the library's, whatever the run; the rank library would end the worker."""
    json_path, ranks_path = vocabulary()
    encoder = packing.ByteTokenizer(json_path, ranks_path, packing.special_strings(json_path))
    for text in (space * 2_000_000, f"a{space * 1_200_000}b", f"{space * 99_999}x" * 12):
        assert encoder.ids(text) == encoder.exact(text)


def test_the_slower_library_is_loaded_only_when_needed():
    json_path, ranks_path = vocabulary()
    special = packing.special_strings(json_path)
    encoder = packing.ByteTokenizer(json_path, ranks_path, special)
    assert encoder.ids("plain text") and encoder.library is None
    assert encoder.ids(f"a {special[0]}")[-1] == 50256 and encoder.library is not None


def test_a_panic_goes_to_the_other_library(monkeypatch):
    class PanicException(BaseException):
        pass

    class Failing:
        def encode_ordinary(self, text):
            raise PanicException("overflow")

    json_path, ranks_path = vocabulary()
    encoder = packing.ByteTokenizer(json_path, ranks_path)
    encoder.ranks = Failing()
    assert encoder.ids("some text") == encoder.exact("some text")
