"""Ranked lexical search over impact vectors in buckets of similar length.

A document's vector holds, for every term some item asks for, the impact this term adds to a
score; an item's score is the sum of the impacts of its terms, the inner product with a vector of
ones.  Vectors are ordered by length and cut into buckets.  Within a task a bucket is skipped for
an item when Cauchy-Schwarz, or the largest impact of each coordinate, shows that nothing in it
reaches the item's tenth best score so far.  Inside a bucket a few coordinates of an item are
added up; bounds on the others drop most vectors, and the survivors are scored again in whole
numbers.  All bounds are from above, so the answer is exact.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope.llm.common import bounded_batches, expand, latest, numbers, stored

# What is no part of a term; only A-Z are lower-cased.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes(
    0x20 if c in _SEPARATORS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)
)
_CHUNK = 1 << 20  # bytes of a text whose terms are held at once

# Distinct terms of one block of items: the block is broadcast, and items beyond it make further
# blocks, each with a pass of its own.
BLOCK_TERMS = 200_000
# The longest vectors, scored first for cutoffs to start with.
FIRST_VECTORS = 1_024
# Vectors of a bucket, and coordinates an item adds up there before bounds are drawn.
BUCKET = 2_048
FOCUS = 6
_ROUNDING = 1 + 1e-9  # bounds are doubles; they may only be too high


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of bounded length."""
    folded = text.translate(_FOLD)
    if len(folded) <= _CHUNK:
        yield folded.split()
        return
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + _CHUNK)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class Items:
    """A block of items: their terms as numbers of a common vocabulary."""

    def __init__(self, words: list[list[bytes]]) -> None:
        self.vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for w in words for t in w))}
        self.terms = [np.array(sorted(self.vocabulary[t] for t in w), np.int32) for w in words]
        self.flat = np.concatenate([np.zeros(0, np.int32), *self.terms])
        self.sizes = np.array([len(t) for t in self.terms], np.int64)


def _distinct_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    kind = items.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                known: set[bytes] = set()
                for part in terms(text):
                    known.update(part)
                found.append(sorted(known))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["id", "terms"])

    asked = items.where(F.col(text_column).isNotNull()).select(F.col(id_column), F.col(text_column).cast("binary"))
    return asked.distinct().mapInArrow(run, f"id {kind}, terms array<binary>")


def item_blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text", most: int = BLOCK_TERMS) -> Iterator[tuple[list, list]]:
    """The ids and the terms of items in blocks of at most ``most`` terms; only an item larger than that exceeds it."""
    ids, words, held = [], [], 0
    for row in _distinct_terms(items, id_column, text_column).toLocalIterator():
        if not row["terms"]:
            continue
        if held and held + len(row["terms"]) > most:
            yield ids, words
            ids, words, held = [], [], 0
        ids.append(row["id"])
        words.append([bytes(t) for t in row["terms"]])
        held += len(row["terms"])
    if ids:
        yield ids, words


def _counted(documents: DataFrame, id_column: str, text_column: str, shipped, version: str) -> DataFrame:
    """Every document's number of terms ``n``, and the counts of those that some item asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = latest("search items", version, lambda: Items(shipped.value)).vocabulary
        for batch in batches:
            total, sizes, which, times = [], [], [], []
            for text in batch.column(1):
                n, found = 0, Counter()
                for part in terms(text.as_py() or b""):
                    n += len(part)
                    found.update(filter(vocabulary.__contains__, part))
                total.append(n)
                sizes.append(len(found))
                numbered = sorted((vocabulary[t], c) for t, c in found.items())
                which.extend(t for t, _ in numbered)
                times.extend(c for _, c in numbered)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(which, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                names=["id", "n", "terms", "times"],
            )

    chosen = documents.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("binary").alias("text"))
    return chosen.mapInArrow(run, "id bigint, n bigint, terms array<int>, times array<bigint>")


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    """A term's weight by the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in holding.tolist()], np.int64)


def _impacts(counted: DataFrame, weight, documents: int, all_terms: int) -> DataFrame:
    """The vectors: per document its terms, their impacts, and the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weight.value
        for batch in batches:
            which, times = batch.column(2), batch.column(3)
            sizes = numbers(which.value_lengths()).astype(np.int64)
            term, tf = numbers(which.flatten()), numbers(times.flatten())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            n = numbers(batch.column(1))
            m = 10 + (90 * n * documents) // all_terms
            impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
            squares = np.bincount(owner, impact.astype(np.float64) ** 2, len(sizes))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(np.sqrt(squares)),
                    pa.ListArray.from_arrays(offsets, pa.array(term)),
                    pa.ListArray.from_arrays(offsets, pa.array(impact)),
                ],
                names=["id", "length", "terms", "impacts"],
            )

    return counted.where(F.size("terms") > 0).mapInArrow(run, "id bigint, length double, terms array<int>, impacts array<bigint>")


class Search:
    """The best documents of every item among the vectors seen, longest vectors first."""

    def __init__(self, items: Items, k: int, floors: np.ndarray | None = None) -> None:
        self.items, self.k = items, k
        self.floors = np.ones(len(items.sizes), np.int64) if floors is None else floors.copy()
        # per item: scores, ids and whether an id is missing, best first
        empty = np.zeros(0, np.int64)
        self.best = [(empty, empty, empty) for _ in items.sizes]
        self.starts = np.cumsum(items.sizes) - items.sizes
        self.rescored = 0

    def add(self, ids: np.ndarray, missing: np.ndarray, length: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """One bucket: ``term`` and ``impact`` hold the vectors one after another, by term."""
        items = self.items
        reach = np.sqrt(items.sizes) * length.max(initial=0) * _ROUNDING >= self.floors
        if not reach.any():
            return
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(term, kind="stable")
        posted, value = owner[order], impact[order].astype(np.float64)
        counts = np.bincount(term, minlength=len(items.vocabulary))
        ends = np.cumsum(counts)
        present = np.flatnonzero(counts)
        highest = np.zeros(len(counts), np.int64)
        highest[present] = np.maximum.reduceat(impact[order], ends[present] - counts[present])
        reach &= np.add.reduceat(highest[items.flat], self.starts) >= self.floors
        squares = length * length * _ROUNDING
        begins = np.cumsum(sizes) - sizes
        asked = np.zeros(len(counts), bool)
        for i in np.flatnonzero(reach).tolist():
            mine = items.terms[i]
            mine = mine[np.argsort(-highest[mine], kind="stable")]
            mine = mine[highest[mine] > 0]
            # every vector that reaches the floor has one of the first coordinates: the others'
            # largest impacts together stay below it
            after = np.append(np.cumsum(highest[mine][::-1])[::-1], 0)
            focus = min(len(mine), max(FOCUS, int(np.argmax(after < self.floors[i]))))
            of, within = expand(counts[mine[:focus]])
            at = (ends - counts)[mine[:focus]][of] + within
            known = np.bincount(posted[at], value[at], len(sizes))
            used = np.bincount(posted[at], value[at] ** 2, len(sizes))
            rest = np.sqrt((len(mine) - focus) * np.maximum(squares - used, 0))
            bound = (known + np.minimum(rest, after[focus])) * _ROUNDING
            alive = np.flatnonzero((known > 0) & (bound >= self.floors[i]))
            if len(alive):
                self.rescored += len(alive)
                asked[mine] = True
                of, within = expand(sizes[alive])
                at = begins[alive][of] + within
                exact = np.zeros(len(alive), np.int64)
                np.add.at(exact, of, np.where(asked[term[at]], impact[at], 0))
                asked[mine] = False
                keep = exact >= self.floors[i]
                self._merge(i, exact[keep], ids[alive][keep], missing[alive][keep])

    def _merge(self, i: int, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        score, ids, missing = (np.concatenate(pair) for pair in zip(self.best[i], (score, ids, missing)))
        top = np.lexsort((ids, missing, -score))[: self.k]
        self.best[i] = (score[top], ids[top], missing[top])
        if len(top) == self.k:
            self.floors[i] = max(self.floors[i], score[top[-1]])

    def add_batch(self, batch: pa.RecordBatch) -> None:
        for at in range(0, batch.num_rows, BUCKET):
            part = batch.slice(at, BUCKET)
            self.add(
                numbers(part.column(0).fill_null(0)),
                numbers(part.column(0).is_null()).astype(np.int64),
                numbers(part.column(1)),
                numbers(part.column(2).value_lengths()).astype(np.int64),
                numbers(part.column(2).flatten()),
                numbers(part.column(3).flatten()),
            )

    def answer(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.best)), [len(b[0]) for b in self.best])
        score, ids, missing = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*self.best))
        return pa.record_batch(
            [pa.array(item.astype(np.int32)), pa.array(ids, mask=missing.astype(bool)), pa.array(score)],
            names=["item", "doc", "score"],
        )


def _searched(vectors: DataFrame, shipped, version: str, k: int, floors: np.ndarray | None) -> DataFrame:
    """The best of each task, at most k for an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(latest("search items", version, lambda: Items(shipped.value)), k, floors)
        for batch in batches:
            search.add_batch(batch)
        yield search.answer()

    return vectors.mapInArrow(run, "item int, doc bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(documents: DataFrame, ids: list, words: list, k: int, id_column: str, text_column: str) -> DataFrame:
    spark = documents.sparkSession
    shipped, version = spark.sparkContext.broadcast(words), uuid.uuid4().hex
    counted = stored(_counted(documents, id_column, text_column, shipped, version), "terms")
    n, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(Items(words).vocabulary), np.int64)
    for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        holding[row["t"]] = row["count"]
    weight = spark.sparkContext.broadcast(weights(n, holding))
    vectors = stored(_impacts(counted, weight, n, total), "vectors")
    longest = vectors.orderBy(F.desc("length")).limit(FIRST_VECTORS)
    floors = np.ones(len(ids), np.int64)
    for row in _ranked(_searched(longest, shipped, version, k, None), k).where(F.col("rank") == k).toLocalIterator():
        floors[row["item"]] = row["score"]
    # equal lengths, as of copies, are split by the salt
    salted = vectors.withColumn("salt", F.xxhash64("id", F.monotonically_increasing_id()))
    ordered = salted.repartitionByRange(F.desc("length"), "salt").sortWithinPartitions(F.desc("length")).drop("salt")
    found = _ranked(_searched(ordered, shipped, version, k, floors), k)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": _id_array(ids)}))
    return found.join(names, "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def _id_array(ids: list) -> pa.Array:
    return pa.array(ids) if any(i is not None for i in ids) else pa.array(ids, pa.int64())


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``: the k best documents of every item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.
    Only documents that score above 0 are listed; equal scores go to smaller ids, NULL ids last.
    NULL or empty texts have no terms.  Each row of ``documents`` is a document, repeated or not;
    items that repeat in id and text are asked once, and different texts of one id are ranked each
    on its own.

    The items are a stated query set: they meet the documents in blocks of ``block_terms`` terms,
    each with one pass over the texts and one over the vectors made of them.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    parts = [
        _search_block(documents, ids, words, k, id_column, text_column)
        for ids, words in item_blocks(items, item_column, item_text_column, block_terms)
    ]
    return functools.reduce(DataFrame.unionByName, parts, _nothing(spark, items, item_column))


def _nothing(spark: SparkSession, items: DataFrame, item_column: str) -> DataFrame:
    kind = items.schema[item_column].dataType.simpleString()
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
