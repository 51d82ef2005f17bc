"""The pipeline: its stages against plain versions, and what each does to rows it must not lose."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from jobscope.llm.common import stored
from jobscope.session import load
from tests.conftest import DATA
from tests.llm.test_packing import check_places

SF = f"{DATA}/sf0.01"


def plain_survivors(texts):
    """The smallest id of each group that shares 0.8 of its distinct five-word shingles, link by link."""
    sets, holders = {}, defaultdict(set)
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        for s in sets[i]:
            holders[s].add(i)
    group = {i: i for i in texts}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, mine in sets.items():
        shared = Counter(j for s in mine for j in holders[s] if j > i)
        for j, n in shared.items():
            if 10 * n >= 8 * (len(mine) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {i for i in texts if top(i) == i}


def test_stages(spark):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        counts.append(len(rows))
        old = {r["doc_id"]: r for r in before.collect()}
        if name != "best-fit packing":
            assert docs.columns == columns
            assert all(tuple(r) == tuple(old[r["doc_id"]]) for r in rows)
        if name == "toxicity":
            toxic = {r["doc_id"] for r in load(spark, SF, "labels").where("toxic = 1").collect()}
            assert toxic and len(toxic & {r["doc_id"] for r in rows}) <= 0.03 * len(toxic)
            clean = {r["doc_id"] for r in load(spark, SF, "labels").where("toxic = 0").collect()}
            assert len(clean & {r["doc_id"] for r in rows}) >= 0.99 * len(clean)
        if name == "language ID":
            assert {i for i, r in old.items() if any(c.isalpha() for c in r["text"] or "")} == {r["doc_id"] for r in rows}
        if name == "SimHash near-dedup":
            want = plain_survivors({i: r["text"] for i, r in old.items()})
            assert Counter(r["doc_id"] for r in rows) == Counter(want)
        if name == "mixing sources":
            assert max(Counter(r["doc_id"] for r in rows).values()) == 2
        if name == "best-fit packing":
            # repeated documents are packed as often as they stand there
            assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in before.collect())
            assert check_places(rows) <= 1.01 * sum(r["length"] for r in rows) / 1024 + 2
    assert counts[0] < load(spark, SF, "documents").count() and all(counts)


def test_odd_rows(spark):
    rows = [(None, "some words here", None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, "a few words", "en", "a", 1)] * 2
    rows += [(5, "other words " * 40_000, "en", None, 1), (6, "1 2 3", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS score", "'k' AS lang_pred", "2 AS key")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        out = stage(spark, docs, SF)
        ids = {r["doc_id"] for r in out.collect()}
        if name != "best-fit packing":
            assert out.columns == docs.columns
        if name in ("toxicity", "SimHash near-dedup"):
            assert {None, 4, 5, 6} <= ids
        if name == "best-fit packing":
            assert ids == {None, 2, 3, 4, 5, 6}


def test_language_stage_rejects_by_distance(spark):
    """Letter noise and unknown scripts go, every clean document stays, held out or not."""
    docs = load(spark, SF, "documents")
    draw = random.Random(3)
    noise = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n)) for n in (200, 1000, 5000)]
    noise += ["это текст на другом языке " * 30, "日本語"]
    rows = [(10_000_000 + i, t) for i, t in enumerate(noise)] + [(20_000_000, "the and of")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_no_language(spark, both, SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} | {20_000_000}


def test_language_stage_without_languages(spark):
    docs = load(spark, SF, "documents").limit(20).selectExpr("* EXCEPT (lang)", "CAST(NULL AS string) AS lang")
    more = spark.createDataFrame([(10_000_000, "1 2 3")], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    kept = corpus_pipeline.drop_no_language(spark, stored(both, "no-language"), SF)
    assert kept.count() == 20 and kept.where("doc_id = 10000000").isEmpty()


def test_toxicity_stage_keeps_what_it_cannot_tell_apart(spark, tmp_path):
    docs = spark.createDataFrame([(i, "same words") for i in range(40)] + [(99, None)], "doc_id long, text string")
    for toxic in ("1", "0", "IF(doc_id % 4 = 0, 0, 1)"):
        folder = str(tmp_path / toxic[:2].strip())
        docs.selectExpr("doc_id", "1 AS quality", f"{toxic} AS toxic").write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == 41


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Repeated rows and ids that stand for several texts; maps and clashing names are carried along."""
    texts = {c: " ".join(f"{c}{k}" for k in range(40)) for c in "tuvw"}
    rows = [(1, "t"), (2, "t"), (2, "v"), (3, "u"), (3, "u"), (5, "w"), (5, "w"), (6, "w"), (None, "t"), (None, "t")]
    made = [(i, texts[c], {"b": [1], c: [2]}, n) for n, (i, c) in enumerate(rows) if i != 3]
    made += [(3, texts["u"], {"b": [1]}, 0)] * 2
    docs = spark.createDataFrame(made, "doc_id long, text string, row map<string,array<int>>, row_key int")
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    left = Counter((r["doc_id"], r["text"][0]) for r in out.collect())
    assert left == {(1, "t"): 1, (2, "v"): 1, (3, "u"): 1, (5, "w"): 1, (None, "t"): 2}
    again = Counter(str(r) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(5), SF).collect())
    assert again == Counter(str(r) for r in out.collect())
