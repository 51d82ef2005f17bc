"""Near-duplicates by SimHash: a Gray-order hierarchical index finds fingerprints a few bits apart.

Texts that share most of their shingles differ in more bits than such an index can bridge;
:func:`duplicates` finds them by long fingerprints in many tables and checks their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import (
    bounded_batches,
    cached,
    components,
    expand,
    new_run,
    numbers,
    release,
    row_key,
    stored,
    unite,
    whole_runs,
)
from jobscope.operators.joins import bloom_split

SHINGLE = 3
SEED = 42
MAX_BITS = 3

# Near copies share at least 4 of 5 of all their five-word shingles.
COPY_SHINGLE = 5
COPY_SHARE = (4, 5)
# Long fingerprints: words of 64 bits, and how far apart those of two near copies are at most.
# At a share of 0.8 a bit differs with probability 0.15: 39 of 256 bits, standard deviation 6.
WORDS = 4
FAR_BITS = 60
# The bits of a long fingerprint that two texts agree on to meet in a table: at least ``NODE_BITS``,
# more where over ``NODE_TEXTS`` texts would agree on average.  There are as many tables as two texts
# with ``SAME_BIT`` as the chance of an equal bit, which is that at a share of 0.8, need to meet but for
# ``MISSED``.  The ``FAMILY`` tables of a family differ in ``OWN_BITS`` bits each and share the others,
# which name the node a text is moved to: once for a family, not for every table.
NODE_BITS = 14
NODE_TEXTS = 1_000
SAME_BIT = 0.85
MISSED = 0.00003
FAMILY = 8
OWN_BITS = 8

_BITS = 64
# Fingerprints in one node that a task takes whole; larger nodes are split one level deeper.
NODE_ROWS = 200_000
_LEAF = 8  # children of a node inside a task
_PAIRS = 1 << 20  # pairs compared at once
_SHINGLES = 1 << 15  # shingles counted at once
_ROWS = 200_000  # rows of the sorted stream taken at once
_LONG_ROWS = 50_000  # the same where a row has a long fingerprint
_SET_ROWS = 4_000  # and where it has the shingles too


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; counted in bytes, 255 hashes at a time."""
    padded = np.zeros(-(-len(hashes) // 255) * 255, "<u8")
    padded[: len(hashes)] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 255, 8), axis=2, bitorder="little")
    return bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def _words(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes, so A-Z and ASCII white space only."""
    return text.encode().lower().split() if text else []


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text as a signed number; 0 for a text without words."""
    words = _words(text)
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    stops = ends[min(shingle, len(words)) - 1 :] - 1
    starts = np.concatenate(([0], ends[: total - 1]))
    ones = np.zeros(_BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _SHINGLES):
        part = zip(starts[at : at + _SHINGLES].tolist(), stops[at : at + _SHINGLES].tolist())
        hashes = np.array([digest(joined[i:j], seed) for i, j in part], "<u8")
        ones += _ones(hashes)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id and ``fingerprint`` (bigint, 64 bits).  Nothing is shuffled."""
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64())], names=[id_column, "fingerprint"])

    kind = documents.schema[id_column].dataType.simpleString()
    chosen = documents.select(F.col(id_column), F.col(text_column))
    return chosen.mapInArrow(run, f"`{id_column}` {kind}, fingerprint bigint")


def gray_rank(code: Column) -> Column:
    """Where a 64-bit word stands in Gray order (as unsigned bits of a bigint)."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _rotated(word: Column, width: int, by: int) -> Column:
    """The lowest ``width`` bits turned left by ``by``; the bits above stay."""
    if by == 0:
        return word
    if width == _BITS:
        return F.shiftleft(word, by).bitwiseOR(F.shiftrightunsigned(word, _BITS - by))
    mask = F.lit((1 << width) - 1)
    low = word.bitwiseAND(mask)
    turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, width - by)).bitwiseAND(mask)
    return word.bitwiseAND(F.lit(~((1 << width) - 1))).bitwiseOR(turned)


def _tops(level: DataFrame, pieces: int, width: int, top: int) -> DataFrame:
    """Each fingerprint under ``pieces`` nodes one level down.

    The ``width`` open bits are cut into pieces; one of them is turned to the front in each copy
    and becomes part of the node's pattern, whose bits are the leading ``top`` bits of the word
    and so of its Gray rank.  Two words at most ``pieces - 1`` bits apart agree on a piece.
    """
    size = width // pieces
    words = F.array(*[_rotated(F.col("word"), width, size * i) for i in range(pieces)])
    copies = level.select("print", "path", F.posexplode(words).alias("turn", "word"))
    rank = gray_rank(F.col("word"))
    return copies.select(
        "print",
        "word",
        (F.col("path") * pieces + F.col("turn")).alias("path"),
        rank.alias("rank"),
        F.shiftrightunsigned(rank, _BITS - top).alias("node"),
    )


def _set_bits(words: np.ndarray) -> np.ndarray:
    """How many bits are set in each word, or in each row of words."""
    counts = np.bitwise_count(words)
    return counts if counts.ndim == 1 else counts.sum(axis=1, dtype=np.int64)


def _near(prints: np.ndarray, starts: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs at most ``max_bits`` apart within runs of Gray-ordered fingerprints.

    A fingerprint is a 64-bit word or a row of such words.
    Above the fingerprints stands a tree: a node covers up to ``_LEAF`` neighbours in Gray order
    and keeps the pattern of the bits all below it share.  Two nodes are compared on the bits
    both share; since patterns only grow downwards, differences add up on the way down and a
    pair of nodes beyond ``max_bits`` takes everything below it out of the search.
    """
    lows, highs = [prints], [prints]  # per level: AND and OR of what is below; equal bits are shared
    lengths = np.diff(np.append(starts, len(prints)))
    levels = [(starts, lengths)]
    while lengths.max(initial=0) > 1:
        counts = -(-lengths // _LEAF)
        owner, within = expand(counts)
        begin = levels[-1][0][owner] + within * _LEAF
        lows.append(np.bitwise_and.reduceat(lows[-1], begin, axis=0))
        highs.append(np.bitwise_or.reduceat(highs[-1], begin, axis=0))
        lengths = counts
        levels.append((np.cumsum(counts) - counts, counts))
    spans = []  # per level above 0: first child and number of children of each node
    for (first, below), (_, above) in zip(levels, levels[1:]):
        owner, within = expand(above)
        spans.append((first[owner] + within * _LEAF, np.minimum(_LEAF, below[owner] - within * _LEAF)))

    roots = np.arange(len(starts))
    todo = [(len(levels) - 1, roots, roots)]
    while todo and spans:
        level, a, b = todo.pop()
        if level == 0:
            yield a, b
            continue
        first, children = spans[level - 1]
        step = max(1, _PAIRS * len(prints) // (_LEAF**2 * prints.size))
        if len(a) > step:
            todo += [(level, a[i : i + step], b[i : i + step]) for i in range(0, len(a), step)]
            continue
        pair, k = expand(children[a] * children[b])
        x = first[a][pair] + k // children[b][pair]
        y = first[b][pair] + k % children[b][pair]
        # a node meets itself once, and a fingerprint never
        keep = (a != b)[pair] | ((x < y) if level == 1 else (x <= y))
        x, y = x[keep], y[keep]
        lo, hi = lows[level - 1], highs[level - 1]
        shared = ~(lo[x] ^ hi[x]) & ~(lo[y] ^ hi[y])
        close = _set_bits((lo[x] ^ lo[y]) & shared) <= max_bits
        if close.any():
            todo.append((level - 1, x[close], y[close]))


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """``a``-``b`` links that connect all distinct ``print`` values at most ``max_bits`` apart.

    The top of the index is laid out over the cluster: the 64 bits are cut into more pieces than
    ``max_bits``, and a node at the top is the pattern of one whole piece, so that two
    fingerprints within ``max_bits`` stand under at least one common node.  A node with more than
    ``node_rows`` fingerprints gets the same step on the bits still open, until it is small or
    too few bits are open.  Inside a node fingerprints are sorted by Gray rank and compared down
    the tree of :func:`_near`.

    Each node gives a spanning forest of the links below it, not all pairs: what is reachable
    stays the same and no group yields more links than members.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits is 0 to 7")
    pieces = next(p for p in (2, 4, 8) if p > max_bits)
    open_bits, every = _BITS, None
    level = prints.select("print", F.col("print").alias("word"), F.lit(0).cast("bigint").alias("path"))
    while True:
        closed = _BITS - open_bits + open_bits // pieces
        level = _tops(level, pieces, open_bits, closed)
        open_bits = _BITS - closed
        large = None
        if open_bits % pieces == 0 and open_bits // pieces > 4:
            size = level.groupBy("path", "node").agg(F.count("*").alias("n"))
            large = stored(size.where(F.col("n") > node_rows).select("path", "node"), "large-nodes")
            large = None if large.isEmpty() else large
        small = level if large is None else level.join(large, ["path", "node"], "left_anti")
        small = small.select(F.lit(open_bits).alias("depth"), "path", "node", "rank", "print")
        every = small if every is None else every.unionByName(small)
        if large is None:
            break
        level = level.join(large, ["path", "node"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["depth", "path", "node"], _ROWS):
            words = numbers(table.column("print")).view(np.uint64)
            label = np.arange(len(words))
            for a, b in _near(words, starts, max_bits):
                unite(label, a, b)
            linked = np.flatnonzero(label != np.arange(len(words)))
            signed = words.view(np.int64)
            yield pa.record_batch([signed[label[linked]], signed[linked]], names=["a", "b"])

    by_node = every.repartition("depth", "path", "node")
    return by_node.sortWithinPartitions("depth", "path", "node", "rank").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """Per document its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is named after the smallest id reachable over links of at most ``max_bits``
    differing bits.  Documents without words (NULL, empty, white space) have fingerprint zero and
    link like any other; repeated rows give repeated rows; a document without id is returned
    and passes links on, but a group made of such documents only has a NULL component.
    """
    prints = stored(fingerprints(documents, id_column, text_column), "fingerprints")
    known = stored(
        prints.groupBy(F.col("fingerprint").alias("print")).agg(F.min(id_column).alias("smallest")), "prints"
    )
    found = components(near_links(known.select("print"), max_bits))
    member = known.join(found, known["print"] == found["node"], "left").select(
        "print", "smallest", F.coalesce("component", "print").alias("component")
    )
    least = member.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = stored(member.join(least, "component").select("print", "component_id"), "named-prints")
    return prints.join(named, prints["fingerprint"] == named["print"]).select(
        F.col(id_column),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def copy_shingles(text: str | None) -> tuple[int, np.ndarray]:
    """A number for the text's words, 0 without words, and the sorted distinct hashes of its shingles."""
    words = _words(text)
    if not words:
        return 0, np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[min(COPY_SHINGLE, len(words)) - 1 :] - 1).tolist()
    starts = [0, *ends[: len(stops) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), "<u8", len(stops))
    return int(np.uint64(digest(joined, SEED + 1)).view(np.int64)), np.unique(hashes)


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles in ``WORDS`` words, each by other bits of the hashes."""
    out = np.zeros(WORDS, "<u8")
    for k in range(WORDS):
        mixed = hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones = _ones(mixed ^ (mixed >> np.uint64(31)))
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _blocks(prints: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of long fingerprints as bits, and where each stands."""
    for at in range(0, len(prints), 2_000):
        part = np.ascontiguousarray(prints[at : at + 2_000])
        yield slice(at, at + len(part)), np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")


@dataclass(frozen=True)
class Layout:
    """How many bits two texts share in a table, and how many tables it took if all were independent."""

    bits: int
    tables: int

    @staticmethod
    def of(texts: int) -> Layout:
        bits = max(NODE_BITS, math.ceil(math.log2(max(1, texts) / NODE_TEXTS)))
        return Layout(bits, math.ceil(math.log(MISSED) / math.log1p(-(SAME_BIT**bits))))

    @property
    def shared(self) -> int:
        """The bits that name a node: those that all tables of a family share."""
        return self.bits - OWN_BITS

    @property
    def families(self) -> int:
        """As many as miss no more pairs than ``tables`` independent tables."""
        met = SAME_BIT**self.shared * (1 - (1 - SAME_BIT**OWN_BITS) ** FAMILY)
        return math.ceil(self.tables * math.log1p(-(SAME_BIT**self.bits)) / math.log1p(-met))

    def places(self) -> np.ndarray:
        """Per family and table the places of its bits in a long fingerprint, the shared ones first."""

        def draw() -> np.ndarray:
            numbers_ = np.random.default_rng(SEED)
            made = np.zeros((self.families, FAMILY, self.bits), np.int64)
            for family in made:
                drawn = numbers_.choice(WORDS * _BITS, self.shared + FAMILY * OWN_BITS, replace=False)
                family[:, : self.shared] = drawn[: self.shared]
                family[:, self.shared :] = drawn[self.shared :].reshape(FAMILY, OWN_BITS)
            return made

        return cached(f"simhash-places {self}", draw)

    def nodes(self, prints: np.ndarray) -> np.ndarray:
        """The node of each fingerprint in every family."""
        weight = 1 << np.arange(self.shared)
        out = np.zeros((len(prints), self.families), np.int64)
        places = self.places()[:, 0, : self.shared]
        for at, bits in _blocks(prints):
            out[at] = bits[:, places] @ weight
        return out + (np.arange(self.families) << self.shared)

    def own(self, prints: np.ndarray, family: np.ndarray) -> np.ndarray:
        """The bits that each fingerprint does not share in the tables of its family, as numbers."""
        weight = 1 << np.arange(OWN_BITS)
        out = np.zeros((len(prints), FAMILY), np.int64)
        places = self.places()[:, :, self.shared :].reshape(self.families, -1)
        for at, bits in _blocks(prints):
            taken = np.take_along_axis(bits, places[family[at]], axis=1)
            out[at] = taken.reshape(-1, FAMILY, OWN_BITS) @ weight
        return out

    def patterns(self, prints: np.ndarray, tables: int | None = None) -> np.ndarray:
        """The bits of each fingerprint in every table, or the first ``tables``, as a number."""
        places = self.places().reshape(-1, self.bits)[:tables]
        weight = 1 << np.arange(self.bits)
        out = np.zeros((len(prints), len(places)), np.int32)
        for at, bits in _blocks(prints):
            out[at] = bits[:, places] @ weight
        return out


_WORDS = [f"w{k}" for k in range(WORDS)]


def _long_prints(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([numbers(rows.column(w)).view(np.uint64) for w in _WORDS], axis=1)


def _gray_order(prints: np.ndarray, node: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The order by node, then by Gray rank of all bits of a fingerprint, then by key."""
    ranks, odd = [], np.zeros(len(prints), np.uint64)
    for k in range(prints.shape[1]):
        rank = prints[:, k].copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        # an odd number of bits set so far turns the order of the bits that follow
        rank ^= np.uint64(0) - odd
        odd = rank & np.uint64(1)
        ranks.append(rank)
    return np.lexsort((keys, *reversed(ranks), node))


def _spread(texts: DataFrame, layout: Layout) -> DataFrame:
    """A row for each family of tables a text stands in: ``node`` there, and all its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                node = layout.nodes(_long_prints(part))
                again = pa.array(np.repeat(np.arange(part.num_rows), layout.families))
                yield pa.record_batch(
                    [pa.array(node.ravel()), *part.take(again).columns], names=["node", *part.schema.names]
                )

    return texts.mapInArrow(run, "node bigint, " + ", ".join(f"{c} bigint" for c in texts.columns))


def _forest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the links form a spanning forest of least total distance."""
    order = np.argsort(far, kind="stable")
    places, ends = np.unique(np.concatenate((a[order], b[order])), return_inverse=True)
    x, y = ends[: len(order)], ends[len(order) :]
    label = np.arange(len(places))
    kept: list[np.ndarray] = []
    edges = np.append(np.flatnonzero(new_run([far[order]])), len(order))
    for begin, end in zip(edges, edges[1:]):
        level = np.arange(begin, end)
        while True:
            while not np.array_equal(up := label[label], label):
                label = up
            p, q = label[x[level]], label[y[level]]
            apart = p != q
            if not apart.any():
                break
            level, p, q = level[apart], p[apart], q[apart]
            # each root takes one link to a smaller root, so no circle closes
            top, first = np.unique(np.maximum(p, q), return_index=True)
            label[top] = np.minimum(p, q)[first]
            kept.append(order[level[first]])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _first_met(x: np.ndarray, y: np.ndarray, table: np.ndarray, prints: np.ndarray, layout: Layout) -> np.ndarray:
    """Which pairs meet in no table before theirs, so that each pair counts in one node only."""
    first = np.ones(len(x), bool)
    if not len(x):
        return first
    ends, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    patterns = layout.patterns(prints[ends], int(table.max()))
    i, j = at[: len(x)], at[len(x) :]
    left = np.arange(len(x))
    for k in range(int(table.max())):
        left = left[table[left] > k]
        met = patterns[i[left], k] == patterns[j[left], k]
        first[left[met]] = False
        left = left[~met]
        if not len(left):
            break
    return first


class _Node:
    """Texts of whole nodes, by Gray rank of their long fingerprints inside a node."""

    def __init__(self, rows: pa.Table, starts: np.ndarray, layout: Layout) -> None:
        node, keys, prints = numbers(rows.column("node")), numbers(rows.column("key")), _long_prints(rows)
        self.order = _gray_order(prints, node, keys)
        self.node, self.keys, self.prints = node, keys[self.order], prints[self.order]
        self.starts, self.layout = starts, layout

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all pairs at most ``FAR_BITS`` apart that meet in no table before.

        The tables of a family are gone through one by one: each cuts the node by its own bits.
        """
        family = self.node >> self.layout.shared
        own = self.layout.own(self.prints, family)
        run = np.zeros(len(self.node), np.int64)
        run[self.starts] = 1 << OWN_BITS
        run = np.cumsum(run)
        for table in range(FAMILY):
            part = run + own[:, table]
            order = np.argsort(part, kind="stable")  # Gray order stays
            starts = np.flatnonzero(new_run([part[order]]))
            for i, j in _near(self.prints[order], starts, FAR_BITS):
                x, y = order[i], order[j]
                first = _first_met(x, y, family[x] * FAMILY + table, self.prints, self.layout)
                yield x[first], y[first]

    def far(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _set_bits(self.prints[x] ^ self.prints[y])


def _candidates(spread: DataFrame, layout: Layout) -> DataFrame:
    """``node``, ``a`` and ``b``: a spanning forest of each node's pairs, shortest links first.

    Texts of pairs beyond the forest are given too, by rows without ``a`` and ``b``: their ``key``, and
    as ``piece`` the text that names the tree of the forest they stand in.  No pair joins two trees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_runs(batches, ["node"], _LONG_ROWS):
            held = _Node(rows, starts, layout)
            a, b, far = (np.zeros(0, np.int64) for _ in range(3))
            more = np.zeros(len(held.keys), bool)

            def thinned() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                keep = np.zeros(len(a), bool)
                keep[_forest(a, b, far)] = True
                more[a[~keep]] = more[b[~keep]] = True
                return a[keep], b[keep], far[keep]

            for x, y in held.pairs():
                a, b, far = np.concatenate((a, x)), np.concatenate((b, y)), np.concatenate((far, held.far(x, y)))
                if len(a) > 2 * _ROWS:
                    a, b, far = thinned()
            a, b, far = thinned()
            p, q = held.keys[a], held.keys[b]
            tree = np.arange(len(held.keys))
            unite(tree, a, b)
            open_ = np.flatnonzero(more)
            no, none = pa.nulls(len(a), pa.int64()), pa.nulls(len(open_), pa.int64())
            names = ["node", "a", "b", "piece", "key"]
            yield pa.record_batch([held.node[a], np.minimum(p, q), np.maximum(p, q), no, no], names=names)
            yield pa.record_batch([held.node[open_], none, none, held.keys[tree[open_]], held.keys[open_]], names=names)
            del rows, held, a, b, far
            release()

    by_node = spread.repartition("node").sortWithinPartitions("node")
    return by_node.mapInArrow(run, "node bigint, a bigint, b bigint, piece bigint, key bigint")


def _resolved(spread: DataFrame, layout: Layout) -> DataFrame:
    """``a``-``b`` links between texts of different ``component`` that share enough ``shingles``.

    Every pair of a node whose texts are not joined yet is compared where it meets, nearest first
    in each block of pairs; a link that passes joins its components there, so at most one link
    less than a node has components leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_runs(batches, ["node"], _SET_ROWS):
            held = _Node(rows, starts, layout)
            sets = rows.column("shingles")
            _, group = np.unique(numbers(rows.column("component"))[held.order], return_inverse=True)
            label = np.arange(group.max(initial=-1) + 1)
            links: list[tuple[int, int]] = []
            for x, y in held.pairs():
                unite(label, label[:0], label[:0])
                apart = label[group[x]] != label[group[y]]
                x, y = x[apart], y[apart]
                near_first = np.argsort(held.far(x, y), kind="stable")
                for i, j in zip(x[near_first].tolist(), y[near_first].tolist()):
                    ends = group[i], group[j]
                    while label[ends[0]] != ends[0] or label[ends[1]] != ends[1]:
                        ends = label[ends[0]], label[ends[1]]
                    if ends[0] == ends[1]:
                        continue
                    if _share_enough(sets[int(held.order[i])].as_py(), sets[int(held.order[j])].as_py()):
                        label[max(ends)] = min(ends)
                        links.append((held.keys[i], held.keys[j]))
            made = np.array(links, np.int64).reshape(-1, 2)
            yield pa.record_batch([made.min(axis=1), made.max(axis=1)], names=["a", "b"])
            del rows, held, sets
            release()

    by_node = spread.repartition("node").sortWithinPartitions("node")
    return by_node.mapInArrow(run, "a bigint, b bigint")


def _share_enough(a: bytes, b: bytes) -> bool:
    """Whether two sets of hashes share ``COPY_SHARE`` of all they hold; both are sorted."""
    many, of = COPY_SHARE
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if of * min(len(x), len(y)) < many * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return of * both >= many * (len(x) + len(y) - both)


def _compared(links: DataFrame, held: DataFrame) -> DataFrame:
    """The links whose texts share enough; ``held`` has the shingles of every ``key``."""

    @F.arrow_udf("boolean")
    def enough(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([_share_enough(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.bool_())

    left = held.select(F.col("key").alias("a"), F.col("shingles").alias("of_a"))
    right = held.select(F.col("key").alias("b"), F.col("shingles").alias("of_b"))
    return links.join(left, "a").join(right, "b").where(enough("of_a", "of_b")).select("a", "b")


def _shingles_of(documents: DataFrame, keys: DataFrame, text_column: str) -> DataFrame:
    """``key`` and ``shingles``, the sorted hashes of its text, for every one of ``keys``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [copy_shingles(t.as_py())[1].tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["key", "shingles"])

    @F.arrow_udf("bigint")
    def key(texts: pa.Array) -> pa.Array:
        made = [xxhash.xxh64_intdigest(b" ".join(w), SEED + 1) if (w := _words(t.as_py())) else 0 for t in texts]
        return pa.array(np.array(made, np.uint64).view(np.int64))

    texts = documents.select(key(F.col(text_column)).alias("key"), F.col(text_column).alias("text"))
    texts, _ = bloom_split(texts, keys, "key")
    texts = texts.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return texts.mapInArrow(sets, "key bigint, shingles binary")


def _still_apart(beyond: DataFrame, groups: DataFrame) -> DataFrame:
    """``node``, ``key`` and ``component`` of the texts of those pieces that hold texts of several components."""
    member = groups.select(F.col("node").alias("key"), "component")
    named = beyond.join(member, "key", "left").withColumn("component", F.coalesce("component", "key"))
    spans = named.groupBy("node", "piece").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return named.join(spans.where("low <> high"), ["node", "piece"], "left_semi").select("node", "key", "component")


def copy_links(documents: DataFrame, prints: DataFrame, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links ``a``-``b`` between ``key`` values of ``prints``, and ``node``, ``component`` of what they join.

    Candidates come from tables over the long fingerprints, and the shingles of every candidate
    are compared, so no link joins texts that share less.  First a spanning forest of each node is
    compared, which joins most groups of copies by few links.  Texts of pairs beyond the forest
    meet again, with their shingles, where the tree they stand in still holds texts of several
    groups: there every pair that is not joined yet is compared.  No pair that could join two
    groups is left out, no node gives all its pairs, and shingles move for what is open only.
    """
    layout = Layout.of(prints.count())
    texts = prints.where("key <> 0").select("key", *_WORDS)
    found = stored(_candidates(_spread(texts, layout), layout), "copy-candidates")
    forest = found.where("a IS NOT NULL").select("a", "b")
    ends = forest.select(F.col("a").alias("key")).union(forest.select(F.col("b").alias("key")))
    linked = stored(ends.distinct(), "copy-keys")
    held = stored(_shingles_of(documents, linked, text_column), "copy-shingles")
    links = stored(_compared(forest, held), "copy-links")
    groups = components(links)
    beyond = found.where("a IS NULL").select("node", "piece", "key")
    if beyond.isEmpty():
        return links, groups
    again = stored(_still_apart(beyond, groups), "copy-open")
    spread = again.join(texts, "key").join(held, "key")
    more = stored(_resolved(spread, layout), "copy-links")
    if more.isEmpty():
        return links, groups
    # The groups found so far are stars already; only what joins them is new.
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return links.unionByName(more).distinct(), components(stars.unionByName(more))


def copy_prints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its id, ``row_key``, the ``key`` of its words and its long fingerprint; nothing is shuffled."""
    bounded_batches(documents.sparkSession)
    names = [f"w{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints = np.zeros(batch.num_rows, np.int64), np.zeros((WORDS, batch.num_rows), np.uint64)
            for i, text in enumerate(batch.column(1)):
                keys[i], hashes = copy_shingles(text.as_py())
                prints[:, i] = long_fingerprint(hashes)
            columns = [batch.column(0), batch.column(2), keys, *prints.view(np.int64)]
            yield pa.record_batch(columns, names=[id_column, "row_key", "key", *names])

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, row_key bigint, key bigint, " + ", ".join(f"{n} bigint" for n in names)
    chosen = documents.select(F.col(id_column), F.col(text_column), row_key(documents).alias("row_key"))
    return chosen.mapInArrow(run, schema)


def _grouped(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per document its id, ``row_key``, the ``component`` of its words and the smallest id of that, ``component_id``."""
    prints = stored(copy_prints(documents, id_column, text_column), "copy-prints")
    words = [F.min(w).alias(w) for w in _WORDS]
    known = stored(prints.groupBy("key").agg(F.min(id_column).alias("smallest"), *words), "copy-texts")
    _, found = copy_links(documents, known.drop("smallest"), text_column)
    member = known.join(found, known["key"] == found["node"], "left").select(
        "key", "smallest", F.coalesce("component", "key").alias("component")
    )
    least = member.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = stored(member.join(least, "component").select("key", "component", "component_id"), "named-copies")
    return prints.join(named, "key").select(F.col(id_column), "row_key", "component", "component_id")


def duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids that are not the smallest of their group of near copies; NULL ids are nobody's duplicate.

    Near copies have the same words or share at least 0.8 of their distinct five-word shingles;
    documents without words are copies of each other.
    """
    rows = _grouped(documents, id_column, text_column)
    return rows.where(F.col(id_column) != F.col("component_id")).select(id_column).distinct()


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near copies, as :func:`duplicates` has them: that with the smallest id.

    Of several rows with that id the one with the smallest hash of all its columns stays, and of a
    row that repeats one.  Rows are told apart by id and hash, so an id with two texts loses
    neither text.  Rows without id all stay.
    """
    told = [id_column, "row_key"]
    rows = stored(_grouped(documents, id_column, text_column).where(F.col(id_column).isNotNull()), "copy-rows")
    counted = rows.groupBy(*told, "component", "component_id").agg(F.count("*").alias("n"))
    first = counted.where(F.col(id_column) == F.col("component_id"))
    first = first.groupBy("component").agg(F.min("row_key").alias("first"))
    marked = counted.join(first, "component").withColumn(
        "stays", (F.col(id_column) == F.col("component_id")) & (F.col("row_key") == F.col("first"))
    )
    # Rows that stay and stand once are most of the table; only the others are named.
    others = stored(marked.where("NOT stays OR n > 1").select(*told, "stays"), "copy-others")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    keyed = documents.select(F.col(id_column), row_key(documents).alias("row_key"), F.struct(*columns).alias("row"))
    # Whole rows move only where they may be named.
    may, clear = bloom_split(keyed, others, "row_key")
    kept = clear.unionByName(may.join(others, told, "left_anti")).select("row.*")
    repeated = others.where("stays").drop("stays")
    if repeated.isEmpty():
        return kept
    once = may.join(repeated, told, "left_semi").groupBy(*told).agg(F.first("row").alias("row"))
    return kept.unionByName(once.select("row.*"))
