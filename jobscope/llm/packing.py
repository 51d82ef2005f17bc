"""Tokenised documents packed into sequences of fixed length.

Documents are tokenised and cut where they are read.  The lengths' histogram (at most one row per
possible length) is packed by :mod:`jobscope.llm.binpacking`; pieces then find their places by
their rank among the pieces of their length, so no piece and no bin passes through the driver.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.binpacking import Run, pack_histogram
from jobscope.llm.common import ROWS_PER_TASK, bounded_batches, latest, numbers, release, stored

CAPACITY = 1024
END_ID = 2


# Texts with a run of white space longer than this go to ``tokenizers``: the rank library fails on
# runs of about a million.
LONG_SPACE = 100_000


def special_strings(path: str) -> list[str]:
    """The strings of a tokenizer file's special tokens."""
    with open(path, encoding="utf-8") as text:
        return [t["content"] for t in json.load(text).get("added_tokens", [])]


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary, equal to those of ``tokenizers`` for its JSON file.

    ``ranks_path`` may name the same vocabulary as ranks; texts are then encoded by the faster
    library, but for those that hold one of the ``special`` strings or very long white space, or
    that it fails on.  The library of the JSON file is loaded when first needed.
    """

    def __init__(self, path: str, ranks_path: str | None = None, special: Sequence[str] | None = None) -> None:
        self.path, self.library, self.ranks = path, None, None
        self.special = special_strings(path) if special is None else special
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding(
                ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
            self.ranks._mergeable_ranks = {}  # the encoder has its own copy

    def exact(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.ranks is None or any(s in text for s in self.special):
            return self.exact(text)
        if len(text) > LONG_SPACE and any(m.end() - m.start() > LONG_SPACE for m in re.finditer(r"\s+", text)):
            return self.exact(text)
        try:
            return self.ranks.encode_ordinary(text)
        except BaseException as failure:  # a panic of the library is no Exception
            if type(failure).__name__ != "PanicException":
                raise
            return self.exact(text)


def pieces(
    documents: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int | None = END_ID,
) -> DataFrame:
    """Each document's ids, an end id after them, cut into pieces of at most ``capacity`` ids.

    Gives id, ``piece`` (from 0), ``start``, ``length`` and ``ids`` (little-endian unsigned
    32-bit numbers).  Only documents longer than the capacity are cut; the shorter piece comes
    first.  NULL text counts as empty.  Nothing is shuffled.
    """
    bounded_batches(documents.sparkSession)
    kind = documents.schema[id_column].dataType.simpleString()
    special = special_strings(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = latest("tokenizer", f"{tokenizer_path} {ranks_path}", lambda: ByteTokenizer(tokenizer_path, ranks_path, special))
        tail = [] if end_id is None else [end_id]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, number, start, length, ids = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    code = np.array(encoder.ids(text or "") + tail, "<u4")
                    cut = len(code) % capacity or min(capacity, len(code))
                    begin, stop, k = 0, cut, 0
                    while stop <= len(code) and stop > begin:
                        owner.append(row)
                        number.append(k)
                        start.append(begin)
                        length.append(stop - begin)
                        ids.append(code[begin:stop].tobytes())
                        begin, stop, k = stop, stop + capacity, k + 1
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(owner, pa.int64())),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=[id_column, "piece", "start", "length", "ids"],
                )
        release()

    chosen = documents.select(F.col(id_column), F.col(text_column))
    return chosen.mapInArrow(run, f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids binary")


def _places(runs: list[Run]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence, pieces per sequence and first offset of each run."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for run in runs:
        offset = 0
        for length in sorted(set(run.items), reverse=True):
            each = run.items.count(length)
            rank = used.get(length, 0)
            found.setdefault(length, []).append((rank, sequence, each, offset))
            used[length] = rank + each * run.bins
            offset += each * length
        sequence += run.bins
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in found.items()}


def _place(runs: list[Run], length: Column, rank: Column) -> Column:
    """``struct(sequence_id, offset)`` of the piece with this rank among those of its length."""
    table = _places(runs)

    @F.arrow_udf("sequence_id bigint, offset bigint")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        lengths, ranks = numbers(lengths), numbers(ranks)
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for value in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == value)
            first, start, each, shift = table[value]
            run = np.searchsorted(first, ranks[at], side="right") - 1
            within = ranks[at] - first[run]
            sequence[at] = start[run] + within // each[run]
            offset[at] = shift[run] + within % each[run] * value
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    return place(length, rank)


def pack(cut: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``: as few sequences as the method finds.

    ``cut`` has a ``length``; it is written once, with a number for each row, and read from there.
    Pieces of one length are interchangeable and take their places by rank.  Ranks are counted in
    slices of about ``ROWS_PER_TASK`` pieces, so neither a length nor a row that a third of all
    pieces share is one task's burden.
    """
    salt = F.xxhash64(*order, F.monotonically_increasing_id())
    salted = stored(cut.withColumn("_salt", salt), "pieces")
    counted = salted.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.toLocalIterator()}
    runs = pack_histogram(histogram, capacity)
    slices = [1 + histogram.get(i, 0) // ROWS_PER_TASK for i in range(capacity + 1)]
    many = F.element_at(F.array(*map(F.lit, slices)), (F.col("length") + 1).cast("int"))
    sliced = salted.withColumn("_slice", F.pmod("_salt", many))
    counts = sliced.groupBy("length", "_slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order, "_salt"))
    ranked = sliced.withColumn("_rank", within - 1).join(bases, ["length", "_slice"])
    placed = ranked.withColumn("_place", _place(runs, F.col("length"), F.col("_base") + F.col("_rank")))
    return placed.select(*cut.columns, "_place.sequence_id", "_place.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id`` and its ``ids``: the pieces' ids in the order of their offsets.

    A sequence holds at most the capacity, so no group is large.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(inside, F.lit(b""), lambda all_, piece: F.concat(all_, piece["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
