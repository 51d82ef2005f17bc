"""SimHash against a plain version: words, shingles, votes, all pairs and reachability."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from jobscope.llm import simhash
from jobscope.llm.queries import QUERIES
from jobscope.session import load
from tests.conftest import DATA


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum((2 * v > len(shingles)) << bit for bit, v in enumerate(votes))


def plain_components(prints, max_bits=3):
    """prints: (id, fingerprint) pairs; gives the smallest id reachable per row."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= max_bits:
                parent[top(a)] = top(b)
    least = {}
    for key, p in prints:
        if key is not None:
            least[top(p)] = min(key, least.get(top(p), key))
    return [(key, f"{p:016x}", least.get(top(p))) for key, p in prints]


def got(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


@pytest.mark.parametrize(
    "text", [None, "", " \t\n", "one", "One TWO", "a b c", "a b c d a b c d", "É Ü\x0b\x1c x\x85y z", "long " * 50_000]
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_whole_table(spark):
    rows = load(spark, f"{DATA}/sf0.001", "documents").select("doc_id", "text").collect()
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    assert got(QUERIES["op1_simhash_near_dedup"](spark, f"{DATA}/sf0.001")) == sorted(want, key=str)


def test_odd_rows(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (9, None), (8, ""), (7, " "), (None, "q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "'x' AS print")
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert got(simhash.near_duplicates(df)) == sorted(want, key=str)
    assert sorted(map(tuple, simhash.duplicates(df).collect())) == [(3,), (8,), (9,)]
    assert got(simhash.near_duplicates(df.limit(0))) == []


@pytest.mark.parametrize("max_bits,node_rows", [(3, 200_000), (3, 5), (1, 10), (5, 20)])
def test_links_reach_what_all_pairs_reach(spark, max_bits, node_rows):
    """Also with nodes so small that the index has several levels."""
    draw = random.Random(1)
    prints = set()
    for centre in [draw.getrandbits(64) for _ in range(6)] + [0]:
        for _ in range(40):
            p = centre
            for _ in range(draw.randrange(0, 7)):
                p ^= 1 << draw.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "print long"), max_bits, node_rows).collect()
    place = {s[0]: i for i, s in enumerate(signed)}
    label = list(range(len(prints)))
    for a, b in links:
        assert (prints[place[a]] ^ prints[place[b]]).bit_count() <= 64
        old, new = sorted((label[place[a]], label[place[b]]), reverse=True)
        label = [new if x == old else x for x in label]
    want = plain_components([(i, p) for i, p in enumerate(prints)], max_bits)
    assert label == [w[2] for w in want]


def shingle_set(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_copies(texts):
    """Ids that are not the smallest of their group, groups joined by pairs that share 0.8; and those pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    pairs = []
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                pairs.append((a, b))
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return {i for i, g in group.items() if g != i}, pairs


def test_duplicates_share_most_shingles(spark):
    """Recall and precision against all pairs, with copies on both sides of the limit."""
    draw = random.Random(5)
    texts = {}
    for family in range(120):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([40, 150, 400]))]
        for share in (0, draw.uniform(0.005, 0.03), draw.uniform(0.02, 0.08)):
            copy = [w if draw.random() >= share else f"w{draw.randrange(3000)}" for w in base]
            texts[len(texts)] = " ".join(copy)
    want, pairs = plain_copies(texts)
    got = {r[0] for r in simhash.duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(pairs) > 60
    assert len(got & want) >= 0.97 * len(want)
    assert got <= want
    # the links of three bits over three-word shingles would not do
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert sum((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in pairs) < 0.6 * len(pairs)


def test_a_large_group_of_copies(spark):
    """Links out of a node are fewer than its texts, yet the group stays whole."""
    draw = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(600):
        copy = list(base)
        copy[draw.randrange(200)] = f"x{i}"
        texts.append((i, " ".join(copy)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r[0] for r in simhash.duplicates(df).collect()} == set(range(1, 600))
    links, _ = simhash.copy_links(df, simhash.copy_prints(df))
    assert 599 <= links.count() == links.distinct().count() < 600 * 599 // 4


def reached(links, n):
    group = list(range(n))
    for a, b in links:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = [new if g == old else g for g in group]
    return group


def test_long_fingerprints_meet_once_and_none_is_left_out(spark):
    """The tree inside the nodes against all pairs; links that failed don't hide others."""
    draw = np.random.default_rng(7)
    centres = draw.integers(0, 1 << 63, (5, simhash.WORDS), np.int64).view(np.uint64)
    prints = np.repeat(centres, 30, axis=0)
    for row in prints:
        for bit in draw.integers(0, 256, draw.integers(0, 50)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    layout = simhash.Layout.of(len(prints))
    assert (layout.bits, layout.tables) == (14, 97) and simhash.Layout.of(10**9).bits == 20
    patterns = layout.patterns(prints)
    want = {
        (a, b)
        for a in range(150)
        for b in range(a + 1, 150)
        if np.bitwise_count(prints[a] ^ prints[b]).sum() <= simhash.FAR_BITS and (patterns[a] == patterns[b]).any()
    }
    rows = [(i, *map(int, prints[i].view(np.int64))) for i in range(150)]
    texts = spark.createDataFrame(rows, "key long, " + ", ".join(f"w{k} long" for k in range(simhash.WORDS)))
    spread = simhash._spread(texts, layout)
    held = spread.selectExpr("*", "key AS component", "unhex('0100000000000000') AS shingles")
    joined = {tuple(r) for r in simhash._resolved(held, layout).collect()}
    few = simhash._candidates(spread, layout).collect()
    forest = {(r.a, r.b) for r in few if r.a is not None}
    assert forest <= want and joined <= want and len(forest) < len(want) and any(r.a is None for r in few)
    assert reached(forest, 150) == reached(joined, 150) == reached(want, 150)
    # each pair is looked at in one node only
    rows_ = spread.orderBy("node").toArrow()
    starts = np.flatnonzero(simhash.new_run([rows_.column("node").to_numpy()]))
    node = simhash._Node(rows_, starts, layout)
    met = [tuple(sorted(p)) for x, y in node.pairs() for p in zip(node.keys[x].tolist(), node.keys[y].tolist())]
    assert len(met) == len(set(met)) and set(met) == want


def test_no_cap_before_the_shingles_are_compared(spark):
    """A copy further away by bits than many texts that fail the check is found all the same."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        copy = list(base)
        for at in draw.sample(range(60), 1 if i % 3 == 0 else draw.choice([2, 3, 4, 5])):
            copy[at] = f"x{draw.randrange(4)}"
        texts.append((i, " ".join(copy)))
    want, _ = plain_copies(dict(texts))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r[0] for r in simhash.duplicates(df).collect()} == want


def test_only_what_is_still_apart_meets_again(spark, monkeypatch):
    """Groups that their forests have joined already send no shingles to the second round."""
    draw = random.Random(9)
    texts = []
    for group in "ab":
        base = [f"{group}{i}" for i in range(200)]
        for i in range(100):
            copy = list(base)
            copy[draw.randrange(200)] = f"{group}x{i}"
            texts.append((len(texts), " ".join(copy)))
    moved = []
    resolved = simhash._resolved
    monkeypatch.setattr(simhash, "_resolved", lambda spread, layout: moved.append(spread.count()) or resolved(spread, layout))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r[0] for r in simhash.duplicates(df).collect()} == set(range(200)) - {0, 100}
    assert moved == [0]


def test_pieces_of_several_components(spark):
    beyond = spark.createDataFrame([(1, 7, 7), (1, 7, 8), (1, 9, 9), (1, 9, 3), (2, 7, 8), (2, 7, 5)], "node long, piece long, key long")
    groups = spark.createDataFrame([(7, 2), (8, 2), (2, 2)], "node long, component long")
    got = sorted(map(tuple, simhash._still_apart(beyond, groups).collect()))
    assert got == [(1, 3, 3), (1, 9, 9), (2, 5, 5), (2, 8, 2)]


def test_texts_move_once_for_a_family_of_tables(spark):
    """A family's tables share the bits that name its node, and families miss no more than independent tables."""
    layout = simhash.Layout.of(100)
    assert layout.families < layout.tables / 3
    draw = np.random.default_rng(3)
    prints = draw.integers(0, 1 << 63, (100, simhash.WORDS), np.int64).view(np.uint64)
    rows = [(i, *map(int, prints[i].view(np.int64))) for i in range(100)]
    texts = spark.createDataFrame(rows, "key long, " + ", ".join(f"w{k} long" for k in range(simhash.WORDS)))
    assert simhash._spread(texts, layout).count() == 100 * layout.families
    many = draw.integers(0, 1 << 63, (20_000, simhash.WORDS), np.int64).view(np.uint64)
    flips = np.packbits(draw.random((20_000, 256)) > simhash.SAME_BIT, axis=1).view(np.uint64)
    apart = (layout.patterns(many) != layout.patterns(many ^ flips)).all(axis=1)
    assert apart.sum() <= 12  # as many tables on their own as ``tables`` says: about 28
    nodes, other = layout.nodes(many), layout.nodes(many ^ flips)
    patterns, changed = layout.patterns(many), layout.patterns(many ^ flips)
    met = (patterns == changed).reshape(len(many), layout.families, simhash.FAMILY).any(axis=2)
    assert (nodes == other)[met].all()
    with_large = simhash.Layout.of(10**9)
    assert with_large.shared == with_large.bits - simhash.OWN_BITS and with_large.families < with_large.tables / 3


def test_a_group_of_copies_gives_few_candidate_rows(spark):
    """A text is named as often as families have it at most, not as often as tables."""
    draw = random.Random(10)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        copy = list(base)
        for at in draw.sample(range(150), draw.randrange(1, 12)):
            copy[at] = f"x{i}"
        texts.append((i, " ".join(copy)))
    prints = simhash.copy_prints(spark.createDataFrame(texts, "doc_id long, text string")).select("key", *simhash._WORDS)
    layout = simhash.Layout.of(400)
    found = simhash._candidates(simhash._spread(prints, layout), layout)
    assert 399 <= found.count() < 20 * 400


def test_rows_that_stay_are_not_shuffled(spark):
    """The whole rows meet the names of those that go only behind a filter."""
    draw = random.Random(11)
    texts = [(i, " ".join(f"w{draw.randrange(9_999)}" for _ in range(20))) for i in range(300)]
    df = spark.createDataFrame(texts + [(300 + i, t) for i, t in texts[:30]], "doc_id long, text string")
    kept = simhash.one_of_each(df)
    assert sorted(map(tuple, kept.collect())) == texts
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "_set" in plan and plan.count("LeftAnti") == 1
