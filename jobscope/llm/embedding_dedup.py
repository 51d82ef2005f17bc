"""Near-duplicate vectors by p-stable hashing: buckets of random projections, then exact cosines.

Two vectors of length one at cosine c are ``sqrt(2 - 2c)`` apart.  A hash is a projection on a
random Gaussian direction, shifted at random and cut into steps of ``WIDTH``; closer vectors fall
into the same step more often.  ``PROJECTIONS`` hashes make a bucket, and ``TABLES`` tables of
buckets give each pair so many chances to meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import components, expand, numbers, stored, unite, whole_runs
from jobscope.llm.topk import usable

THRESHOLD = 0.93
WIDTH = 1.5
PROJECTIONS = 8
RECALL = 0.97
SEED = 7
# Vectors of a bucket that meet in one task; larger buckets are cut into blocks that meet pairwise.
BUCKET_ROWS = 4096
_ROWS = 20_000
_PAIRS = 1 << 15


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that two vectors this far apart share a hash."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_needed(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Tables after which a pair just at the threshold has met with probability ``recall``."""
    together = collision(math.sqrt(2 - 2 * threshold)) ** PROJECTIONS
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; the largest component is taken out first."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashes(unit: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """One 32-bit bucket number per row and table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    directions = rng.standard_normal((unit.shape[1], tables * PROJECTIONS))
    shift = rng.random(tables * PROJECTIONS) * WIDTH
    steps = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64)
    mixed = np.zeros((len(unit), tables), np.uint64)
    for i in range(PROJECTIONS):
        mixed = (mixed ^ steps[:, i::PROJECTIONS]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def _bucketed(vectors: DataFrame, tables: int, seed: int) -> DataFrame:
    """``id``, ``unit`` and all bucket numbers of each vector, once per table with its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lengths = numbers(part.column("dims"))
                for dims in np.unique(lengths):
                    rows = part.filter(pa.array(lengths == dims))
                    flat = rows.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    unit = _unit(flat.reshape(rows.num_rows, dims))
                    buckets = _hashes(unit, tables, seed)
                    yield pa.record_batch(
                        [
                            rows.column("node"),
                            rows.column("label"),
                            rows.column("copies"),
                            rows.column("dims"),
                            pa.array([u.tobytes() for u in unit], pa.binary()),
                            pa.array([b.tobytes() for b in buckets.astype("<u4")], pa.binary()),
                            pa.array(list(buckets.astype(np.int64)), pa.list_(pa.int64())),
                        ],
                        names=["node", "label", "copies", "dims", "unit", "all", "buckets"],
                    )

    schema = "node bigint, label bigint, copies bigint, dims int, unit binary, all binary, buckets array<bigint>"
    hashed = vectors.mapInArrow(run, schema)
    return hashed.select("node", "label", "copies", "dims", "unit", "all", F.posexplode("buckets").alias("tbl", "bucket"))


def _cells(bucketed: DataFrame, bucket_rows: int) -> DataFrame:
    """The vectors of each bucket that can meet; a large bucket as pairs of blocks."""
    keys = ["label", "dims", "tbl", "bucket"]
    sizes = stored(bucketed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    large = sizes.where(F.col("n") > bucket_rows)
    met = bucketed.join(sizes, keys)
    small = met.where(F.col("n") <= bucket_rows).withColumns({"block": F.lit(0), "one": F.lit(0), "two": F.lit(0)})
    if large.isEmpty():
        return small
    blocks = F.ceil(F.col("n") / F.lit(bucket_rows // 2)).cast("int")
    cut = met.where(F.col("n") > bucket_rows).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    dealt = cut.select("*", other).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    return small.unionByName(dealt.drop("other"))


def near_pairs(vectors: DataFrame, threshold: float, tables: int, seed: int, bucket_rows: int) -> DataFrame:
    """Per vector (``node``) and cell: its links found there, and the smallest node they lead to.

    A pair counts where it meets first: in the first table whose buckets agree.  So links add up
    over cells, and no pair needs a row of its own.
    """
    cells = _cells(_bucketed(vectors, tables, seed), bucket_rows)
    keys = ["label", "dims", "tbl", "bucket", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, keys, _ROWS):
            node, copies, block = (numbers(table.column(c)) for c in ("node", "copies", "block"))
            one, two, tbl = (numbers(table.column(c)) for c in ("one", "two", "tbl"))
            width = numbers(table.column("dims"))
            ends = np.append(starts[1:], len(node))
            links, label = np.zeros(len(node), np.int64), np.arange(len(node))
            units = table.column("unit").combine_chunks()
            every = np.frombuffer(b"".join(table.column("all").to_pylist()), "<u4").reshape(len(node), tables)
            offsets = np.concatenate(([0], np.cumsum(width)))
            flat = np.frombuffer(b"".join(units.to_pylist()), "<f8")

            def check(a: np.ndarray, b: np.ndarray) -> None:
                for dims in np.unique(width[a]):
                    of = width[a] == dims
                    x, y = a[of], b[of]
                    cols = np.arange(dims)
                    cosine = np.einsum("ij,ij->i", flat[offsets[x][:, None] + cols], flat[offsets[y][:, None] + cols])
                    near = cosine >= threshold
                    x, y = x[near], y[near]
                    same = every[x] == every[y]
                    first = same.argmax(axis=1) == tbl[x]
                    x, y = x[first], y[first]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    unite(label, x, y)

            small = ends - starts <= 64
            sizes = (ends - starts)[small]
            pair, k = expand(sizes * sizes)
            a = starts[small][pair] + k // sizes[pair]
            b = starts[small][pair] + k % sizes[pair]
            keep = a < b
            # of a block pair only pairs across meet, but for a block with itself
            keep &= (one[a] == two[a]) | (block[a] != block[b])
            a, b = a[keep], b[keep]
            for at in range(0, len(a), _PAIRS):
                check(a[at : at + _PAIRS], b[at : at + _PAIRS])
            for begin, end in zip(starts[~small], ends[~small]):
                dims = int(width[begin])
                unit = flat[offsets[begin] : offsets[end]].reshape(end - begin, dims)
                for at in range(begin, end, 512):
                    strip = slice(at, min(at + 512, end))
                    cosine = unit[at - begin : strip.stop - begin] @ unit.T
                    x, y = np.nonzero(cosine >= threshold - 1e-9)
                    x, y = x + at, y + begin
                    keep = x < y
                    keep &= (one[begin] == two[begin]) | (block[x] != block[y])
                    x, y = x[keep], y[keep]
                    for i in range(0, len(x), _PAIRS):
                        check(x[i : i + _PAIRS], y[i : i + _PAIRS])
            while not np.array_equal(label[label], label):
                label = label[label]
            found = np.flatnonzero(links)
            yield pa.record_batch([node[found], links[found], node[label[found]]], names=["node", "links", "leads"])

    ordered = cells.repartition(*keys[:4], "one", "two").sortWithinPartitions(*keys)
    columns = [*keys, "block", "node", "copies", "unit", "all"]
    return ordered.select(*columns).mapInArrow(run, "node bigint, links bigint, leads bigint")


def near_duplicates(
    embeddings: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    threshold: float = THRESHOLD,
    tables: int | None = None,
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id`` and ``kept``.

    Rows with equal labels link where their cosine in double precision reaches ``threshold`` and
    the index lets them meet (chance at the threshold: ``RECALL``).  Equal vectors are one node
    with so many copies, and each copy links to the others.  Rows with a NULL label, and vectors
    that are NULL, empty, zero or hold NULL, NaN or infinite components, link with nothing, nor do
    vectors of different lengths.  A component is named after the smallest id reachable; a row
    without id passes links on, and its component is NULL if no row of it has an id (``kept``).
    """
    tables = tables or tables_needed(threshold)
    label, name = F.col(label_column), id_column
    if not isinstance(embeddings.schema[label_column].dataType, T.IntegralType):
        # Other labels are compared by their own type, and numbered: one row for each of them.
        embeddings = embeddings.select(F.col(id_column).alias("id"), label.alias("label"), F.col(vector_column).alias("vector"))
        known = embeddings.where("label IS NOT NULL").select("label").distinct()
        known = stored(known.withColumn("number", F.monotonically_increasing_id()), "labels")
        embeddings = embeddings.join(known, "label", "left").select("id", "vector", "number")
        id_column, vector_column, label_column = "id", "vector", "number"
        label = F.col(label_column)
    names = [F.col(id_column).alias("id"), label.cast("bigint").alias("label"), F.col(vector_column).alias("vector")]
    some = F.exists(vector_column, lambda x: x != 0)
    fit = usable(vector_column) & label.isNotNull() & F.coalesce(some, F.lit(False))
    read = embeddings.select(*names, fit.alias("fit"))
    alone = read.where("NOT fit").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    key = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("vector").cast("array<string>")), 256)
    usable_rows = stored(read.where("fit").select("id", "label", "vector", key.alias("key")), "vectors")
    nodes = usable_rows.groupBy("key").agg(F.min("id").alias("smallest"), F.count("*").alias("copies"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    one_each = usable_rows.groupBy("key").agg(F.first(F.struct("label", "vector")).alias("row"))
    vectors = one_each.join(nodes, "key").select("node", "row.label", "row.vector", "copies", F.size("row.vector").alias("dims"))
    found = stored(near_pairs(vectors, threshold, tables, seed, bucket_rows), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("leads").alias("b")))
    member = nodes.join(linked, "node", "left").join(joined, "node", "left").select(
        "key",
        "smallest",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    least = member.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = stored(member.join(least, "component").select("key", "n_links", "component_id"), "named")
    every = usable_rows.join(named, "key").select("id", "n_links", "component_id").unionByName(alone)
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return every.select(F.col("id").alias(name), "n_links", "component_id", kept.alias("kept"))
