"""Toxicity and language: held-out accuracy, plain versions of the features, odd rows."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np

from jobscope.llm import language, toxicity
from jobscope.llm.queries import QUERIES
from tests.conftest import DATA

SF = f"{DATA}/sf0.1"


def outside(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_held_out(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    known = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall()
    total = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert len(rows) == total
    assert all(r["held_out"] == outside(i) and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    unseen = [(rows[i]["predicted"], toxic) for i, toxic in known if outside(i)]
    assert sum(p == t for p, t in unseen) >= 0.99 * len(unseen)
    caught = [p for p, t in unseen if t == 1]
    assert sum(caught) >= 0.92 * len(caught)  # one label in twenty is wrong there


def test_language_held_out(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, SF).collect()}
    known = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL").fetchall()
    assert all(r["held_out"] == outside(i) and 0 <= r["score"] <= 1 for i, r in rows.items())
    unseen = [rows[i]["lang_pred"] == name for i, name in known if outside(i)]
    assert sum(unseen) >= 0.98 * len(unseen)


def labelled(spark):
    rows = [(i, f"good day number {i}" if i % 2 else f"you rotten fool {i}", "en", 0.5, 1, 2) for i in range(200)]
    rows += [(None, "rotten fool", None, None, None, None), (500, None, "en", 0.0, 0, 0), (501, "", "en", 0.0, 0, 0)]
    rows += [(502, "rotten fool " * 30_000, "en", 0.0, 0, 0), (502, "rotten fool", "en", 0.0, 0, 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, toxic int, index int")
    marks = [(i, 1 - i % 2) for i in range(200)] + [(0, 0), (None, 1), (1, None), (502, 1), (900, 1)]
    return documents, spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_odd_rows(spark):
    documents, labels = labelled(spark)
    model = toxicity.fit(documents, labels)
    got = toxicity.score(documents, model, to="_s").collect()
    assert len(got) == 205 and set(documents.columns) < set(got[0].asDict())
    for r in got:
        assert 0 <= r["_s"] <= 1
        assert (r["_s"] >= 0.5) == ("rotten" in (r["text"] or ""))
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r["_s"] for r in toxicity.score(documents, toxicity.fit(documents, none), to="_s").collect()} <= {0.0, 8.75651076269652e-27}
    assert toxicity.score(documents.limit(0), model).collect() == []


def test_features_are_all_ngrams():
    """A long text counted in stretches has the n-grams a plain loop has."""
    text = "Ab é" * 50_000
    index, value = toxicity._features(text, (3, 4), 18)
    low = text.lower()
    plain = Counter(low[i : i + n] for n in (3, 4) for i in range(len(low) - n + 1))
    assert len(index) == len(plain)
    assert np.allclose(sorted(value), sorted(np.sqrt(c / sum(plain.values())) for c in plain.values()), atol=1e-6)


def plain_grams(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    out = Counter()
    for w in words:
        out.update(w)
        padded = f" {w} "
        out.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return out


def as_text(code):
    chars = []
    while code:
        chars.append(chr(code & 0x1FFFFF))
        code >>= 21
    return "".join(reversed(chars))


def test_grams():
    for text in ["", " 12 .", "a", "One two, ONE éa x1y", "word " * 100_000 + "z", "日本 ñ\x00b"]:
        gram, count = language.grams(text)
        assert dict(zip(map(as_text, gram.tolist()), count.tolist())) == plain_grams(text)


def test_out_of_place_distance():
    profiles = language.Profiles({n: language.ranked(*language.grams(t), 10) for n, t in [("b", "abba abba baab"), ("a", "xyz xyz zzz")]}, 10)
    for text in ["abba", "zzz x", "q", "abba zzz"]:
        own = [as_text(g) for g in language.ranked(*language.grams(text), 10).tolist()]
        distance = {}
        for name, source in [("a", "xyz xyz zzz"), ("b", "abba abba baab")]:
            there = [as_text(g) for g in language.ranked(*language.grams(source), 10).tolist()]
            distance[name] = sum(abs(there.index(g) - i) if g in there else 10 for i, g in enumerate(own))
        best = min(distance, key=lambda n: (distance[n], n))
        assert profiles.classify(text) == (best, 1 - distance[best] / (10 * len(own)))


def test_language_odd_rows(spark):
    rows = [(i, "der die das und " * 4, "de", 1) for i in range(30)] + [(100 + i, "the of and with " * 4, "en", 1) for i in range(30)]
    rows += [(None, "the and", "xx", 1), (201, None, "de", 1), (202, "", None, 1), (203, "12 !!", "de", 1), (204, "with the of " * 90_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    profiles = language.fit(df)
    assert profiles.names == ["de", "en"]
    got = {r["doc_id"]: r["language"] for r in language.identify(df, profiles).collect()}
    assert (got[0]["lang_pred"], got[101]["lang_pred"], got[None]["lang_pred"], got[204]["lang_pred"]) == ("de", "en", "en", "en")
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (201, 202, 203))
    bare = language.fit(df.limit(0))
    assert {r["language"]["lang_pred"] for r in language.identify(df, bare).collect()} == {"und"}
    assert language.identify(df.limit(0), profiles).collect() == []


def test_sample_bounds_hold(spark):
    rows = [(i, f"aa{'b' * (i % 3)} ", "de") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(df, sample_per_language=20).names == ["de"]
    labels = df.selectExpr("doc_id", "CAST(doc_id % 3 = 2 AS INT) AS toxic")
    assert toxicity.fit(df, labels, sample_per_class=10).weights.any()
    same = df.selectExpr("doc_id", "'equal' AS text")
    assert toxicity.fit(same, labels).scores(["equal", ""]) == [0.0, 0.0] or not toxicity.fit(same, labels).weights.any()
