"""Ranked search against scores of all documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from jobscope.llm import lexical_search
from jobscope.llm.queries import ORACLES, QUERIES
from jobscope.session import load
from tests.conftest import DATA
from tests.oracle import connect, difference

DOCS = "doc_id long, text string, id string, score int, terms array<int>"
ITEMS = "item_id long, text string, doc_id int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counted = [(d, Counter(words(t))) for d, t, *_ in docs]
    held = [(d, c) for d, c in counted if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t) for i, t, *_ in items if t is not None}:
        found = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(words(text))
                if c[t]
            )
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, n + 1, d, -s) for n, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sql(spark):
    con = connect(f"{DATA}/sf0.01")
    name = "op13_lexical_search"
    assert difference(QUERIES[name](spark, f"{DATA}/sf0.01"), con, ORACLES[name]) is None


@pytest.mark.parametrize("block_terms,bucket,first", [(200_000, 2048, 1024), (5, 7, 3), (40, 50, 1)])
def test_blocks_buckets_and_ties(spark, monkeypatch, block_terms, bucket, first):
    monkeypatch.setattr(lexical_search, "BUCKET", bucket)
    monkeypatch.setattr(lexical_search, "FIRST_VECTORS", first)
    rng = np.random.default_rng(6)
    vocabulary = np.array([f"Wört{i}" if i % 3 else f"w{i}x" for i in range(60)])
    share = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 90), p=share / share.sum())) for _ in range(150)]
    docs = [(i, texts[i // 2], "x", i, [1]) for i in range(300)] + [(7, texts[3], None, None, None)] * 3
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 12))), 0) for i in range(12)] + [(3, "w0x w3x", 1)]
    df, asked = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = lexical_search.search(df, asked, block_terms=block_terms)
    assert found(got) == plain(docs, items)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "... \n\t"), (4, "Alpha beta"), (5, "alpha ALPHA ÄLPHA"), (None, "beta gamma"), (6, "beta\0gamma_delta"),
        (7, "gamma " * 400_000), (8, "x" * 3_000_000), (9, "alpha"), (9, "alpha"), (10, "10 20 beta10"), (11, "ĀLPHA  zeta"),
    ]
    docs = [(*d, None, 0, None) for d in docs]
    items = [(1, "alpha BETA"), (2, None), (3, ""), (4, "!"), (None, "gamma"), (5, "missing"), (6, "10"), (1, "alpha BETA"), (7, " zeta älpha Älpha")]
    items = [(*i, 1) for i in items]
    df, asked = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert found(lexical_search.search(df, asked)) == plain(docs, items)
    assert lexical_search.search(df.limit(0), asked).collect() == []
    assert lexical_search.search(df, asked.limit(0)).collect() == []
    assert lexical_search.search(df.where("doc_id <= 3"), asked).collect() == []


def test_terms_of_long_texts(monkeypatch):
    text = ("Añb,c " * 1000 + "\n" + "d" * 500).encode()
    whole = [t for part in lexical_search.terms(text) for t in part]
    monkeypatch.setattr(lexical_search, "_CHUNK", 64)
    parts = list(lexical_search.terms(text))
    assert [t for part in parts for t in part] == whole == [w.encode() for w in words(text.decode())]
    assert len(parts) > 50


def test_bounds_save_exact_scores(spark):
    """Far fewer vectors are scored in whole numbers than there are pairs."""
    docs, asked = load(spark, f"{DATA}/sf0.01", "documents"), load(spark, f"{DATA}/sf0.01", "benchmark")
    [(ids, terms)] = lexical_search.item_blocks(asked)
    items = lexical_search.Items(terms)
    rows = [Counter(t for part in lexical_search.terms((r[0] or "").encode()) for t in part) for r in docs.select("text").collect()]
    df = Counter(t for c in rows for t in c if t in items.vocabulary)
    w = lexical_search.weights(len(rows), np.array([df[t] for t in items.vocabulary]))
    vectors = []
    for i, c in enumerate(rows):
        kept = sorted((items.vocabulary[t], n) for t, n in c.items() if t in items.vocabulary)
        term = np.array([t for t, _ in kept], np.int32)
        tf = np.array([n for _, n in kept], np.int64)
        impact = w[term] * (10**9 * tf // (1000 * tf + 8 * 100))
        vectors.append((math.sqrt(float((impact.astype(float) ** 2).sum())), i, term, impact))
    vectors.sort(key=lambda v: -v[0])
    search = lexical_search.Search(items, 10)
    for at in range(0, len(vectors), 100):
        part = vectors[at : at + 100]
        search.add(
            np.array([v[1] for v in part]),
            np.zeros(len(part), np.int64),
            np.array([v[0] for v in part]),
            np.array([len(v[2]) for v in part]),
            np.concatenate([v[2] for v in part]),
            np.concatenate([v[3] for v in part]),
        )
    assert search.rescored < 0.35 * len(ids) * len(vectors)
