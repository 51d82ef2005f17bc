"""What the operators of this subpackage share: stored steps, Arrow runs, connected components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.session import scratch

# Bytes of text one Arrow batch may hold, whatever the length of its rows.
TEXT_BATCH_BYTES = 16 << 20

# Folds: a row is held out when the CRC-32 of its id's text is divisible by this.
FOLDS = 5

ROWS_PER_TASK = 100_000


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end by bytes too, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step below the shared folder and read it back.

    It cuts the lineage where a step is read more than once: a lost executor costs no more than
    its own tasks, and Spark knows the size of what it reads.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hashable(value: Column, kind: T.DataType) -> Column:
    """A value that Spark can hash: maps become entries in the order of their keys."""
    if isinstance(kind, T.MapType):
        return F.transform(
            F.array_sort(F.map_keys(value)), lambda k: F.struct(k, _hashable(F.element_at(value, k), kind.valueType))
        )
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_hashable(value[f.name], f.dataType) for f in kind.fields]))
    return F.to_json(value) if isinstance(kind, T.VariantType) else value


def row_key(rows: DataFrame) -> Column:
    """A hash of all columns, the same for equal rows; columns may have any type."""
    return F.xxhash64(*[_hashable(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields])


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in learning; a document without id does neither."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def cached(key: str, build: Callable[[], Any]) -> Any:
    """A value made once in a Python worker and kept for its later tasks."""
    shelf = sys.modules.setdefault("_jobscope_worker", ModuleType("_jobscope_worker"))
    if key not in shelf.__dict__:
        shelf.__dict__[key] = build()
    return shelf.__dict__[key]


def latest(kind: str, version: str, build: Callable[[], Any]) -> Any:
    """A value kept in a Python worker until another version of its kind is asked for."""
    shelf = cached(f"latest {kind}", dict)
    if version not in shelf:
        shelf.clear()  # the old value goes before the new one is built
        shelf[version] = build()
    return shelf[version]


def release() -> None:
    """Give back what Arrow keeps for later batches: workers live on between tasks."""
    pa.default_memory_pool().release_unused()


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column without NULLs as a numpy array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


def new_run(columns: list[np.ndarray]) -> np.ndarray:
    """Marks the rows that differ from the row before in any column; the first row is marked."""
    first = np.zeros(len(columns[0]), bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return first


def whole_runs(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, with the place where each run starts.

    The input is sorted by the keys, which are numbers without NULLs.  A table has about ``rows``
    rows, or one run if that is longer; callers bound the length of a run.
    """
    held: list[pa.Table] = []
    size = 0

    def starts(table: pa.Table) -> np.ndarray:
        return np.flatnonzero(new_run([numbers(table.column(k)) for k in keys]))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.concat_tables(held)
        first = starts(table)
        cut = int(first[-1])
        if cut:
            yield table.slice(0, cut), first[:-1]
        held, size = [table.slice(cut)], table.num_rows - cut
    if held:
        table = pa.concat_tables(held)
        yield table, starts(table)


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): the owners (0, 0, 2, 2, 2) and the numbers within (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, within


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i]; label[x] leads to the smallest member of x's group."""
    while True:
        while True:  # shorten all paths
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of ``a``-``b`` links.

    Alternating large and small stars: each round points every node at smaller ones of its
    neighbourhood until all point at the smallest of their group.  Minima are combined before
    they move, joins are left to Spark, which splits a hot node, and each round is a stored
    table, so a lost executor repeats part of one round only.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())

    pairs = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    star = stored(pairs.where("hi <> lo").distinct(), "links")
    before, after = None, state(star)
    while after != before:
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            star.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .unionByName(lowest.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        )
        star = stored(small.distinct(), "links")
        before, after = after, state(star)
    own = star.select(F.col("lo").alias("node")).distinct()
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        own.select("node", F.col("node").alias("component"))
    )
