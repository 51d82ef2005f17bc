"""Hard negatives by exact integer scores in a residue number system.

Scores are inner products of whole numbers.  Components are reduced modulo several small primes;
the residue matrices are multiplied in float32, where every partial sum stays below 2^24 and is
exact; Chinese remaindering gives the signed scores back, since the primes' product exceeds twice
the largest score possible.  Anchors meet rows in a grid of blocks: first those of their own
label, for the positives, then all, for the negatives inside each positive's window of scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import numbers, stored

# Rows and anchors that meet in one task: a cell of the grid.
ROW_BLOCK = 4096
ANCHOR_BLOCK = 8192
_STRIP = 128  # anchors scored at once inside a cell
_EXACT = 1 << 24  # float32 holds all whole numbers up to here
_LONG = (1 << 63) - 1


def _primes(most: int) -> list[int]:
    """Odd primes up to ``most``, largest first."""
    sieve = np.ones(most + 1, bool)
    sieve[:3] = False
    sieve[4::2] = False
    for p in range(3, math.isqrt(most) + 1, 2):
        if sieve[p]:
            sieve[p * p :: p] = False
    return np.flatnonzero(sieve)[::-1].tolist()


def moduli(dims: int, bound: int) -> tuple[int, list[int]]:
    """How many components to multiply at once, and primes whose product exceeds ``2 * bound``.

    ``width`` products of centred residues sum to less than 2^24.  Fewer components at once allow
    larger primes, which only matters for enormous scores.
    """
    for width in (max(1, dims), 512, 64, 8, 1):
        if width > max(1, dims):
            continue
        half = math.isqrt((_EXACT - 1) // width)
        if half < 1:
            continue
        chosen, product = [], 1
        for p in _primes(2 * half + 1):
            chosen.append(p)
            product *= p
            if product > 2 * bound:
                return width, chosen
    raise ValueError("components are too large")


def _residues(whole: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo ``p`` around zero, as float32."""
    r = (whole % p).astype(np.int64)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices of whole numbers, cut to 64 bits."""

    def largest(m: np.ndarray) -> int:
        return max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0

    dims = left.shape[1]
    width, primes = moduli(dims, dims * largest(left) * largest(right))
    digits: list[np.ndarray] = []  # mixed radix: score = d0 + d1 p0 + d2 p0 p1 + ...
    for i, p in enumerate(primes):
        a, b = _residues(left, p), _residues(right, p).T
        total = np.zeros((len(left), len(right)), np.int64)
        for at in range(0, dims, width):
            total += (a[:, at : at + width] @ b[at : at + width]).astype(np.int64) % p
        known, radix = np.zeros_like(total), 1
        for digit, q in zip(digits, primes):
            known += digit * (radix % p)
            radix = radix * q % p
        digits.append((total - known) * pow(radix, -1, p) % p)
    product = math.prod(primes)
    value = np.zeros((len(left), len(right)), np.int64 if product <= _LONG else object)
    for digit, p in zip(reversed(digits), reversed(primes)):
        value = value * p + digit
    value = np.where(value > product // 2, value - product, value)
    return value if value.dtype == np.int64 else np.clip(value, -_LONG - 1, _LONG).astype(np.int64)


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~odd, F.lit(False))


def _whole(table: pa.Table, scale: int) -> np.ndarray:
    """Components times ``scale``, floored; Python's whole numbers where 64 bits don't hold them."""
    lists = table.column("vector").combine_chunks()
    if not len(lists):
        return np.zeros((0, 0), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = values.reshape(len(lists), len(values) // max(1, len(lists)))
    if np.abs(values).max(initial=0) * scale < 2**62:
        return np.floor(values * scale).astype(np.int64)
    with np.errstate(over="ignore"):
        scaled = values * scale
    # a product beyond doubles has no fraction left
    cells = [math.floor(y) if math.isfinite(y) else int(x) * scale for x, y in zip(values.flat, scaled.flat)]
    return np.array(cells, object).reshape(values.shape)


def _codes(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the two tables' labels are, whatever their type."""
    labels = left.column("label")
    both = pa.chunked_array(labels.chunks + right.column("label").chunks, type=labels.type)
    codes = numbers(both.combine_chunks().dictionary_encode().indices)
    return codes[: left.num_rows], codes[left.num_rows :]


def _positives(anchors: pa.Table, rows: pa.Table, k: int, scale: int) -> pa.Table:
    """Per anchor the k best of these rows, all of its label."""
    if not anchors.num_rows or not rows.num_rows:
        anchors, rows = anchors.slice(0, 0), rows.slice(0, 0)
    ids, row_keys, x = numbers(rows.column("id")), numbers(rows.column("key")), _whole(rows, scale)
    a_ids, keys, a = numbers(anchors.column("id")), numbers(anchors.column("key")), _whole(anchors, scale)
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for at in range(0, len(a), _STRIP):
        found = scores(a[at : at + _STRIP], x)
        for i, score in enumerate(found, at):
            near = np.flatnonzero(ids != a_ids[i])
            if len(near) > k:
                floor = np.partition(score[near], len(near) - k)[len(near) - k]
                near = near[score[near] >= floor]
            order = near[np.lexsort((ids[near], ~score[near]))][:k]
            for column, values in zip(out, (np.full(len(order), a_ids[i]), np.full(len(order), keys[i]), ids[order], row_keys[order], score[order])):
                column.append(values)
    names = ["anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score"]
    return pa.table({n: np.concatenate([np.zeros(0, np.int64), *c]) for n, c in zip(names, out)})


def _negatives(anchors: pa.Table, rows: pa.Table, k: int, scale: int, low: tuple[int, int]) -> pa.Table:
    """Per anchor and positive the k best of these rows that have another label and fit its window."""
    if not anchors.num_rows or not rows.num_rows:
        anchors, rows = anchors.slice(0, 0), rows.slice(0, 0)
    ids, x = numbers(rows.column("id")), _whole(rows, scale)
    a_ids, keys, a = numbers(anchors.column("id")), numbers(anchors.column("key")), _whole(anchors, scale)
    mine, theirs = _codes(anchors, rows)
    positives = anchors.column("positives").to_pylist()
    out: list[list] = [[], [], [], [], [], [], []]
    for at in range(0, len(a), _STRIP):
        found = scores(a[at : at + _STRIP], x)
        for i, score in enumerate(found, at):
            windows = [(-(-low[0] * p["score"] // low[1]), p["score"]) for p in positives[i]]
            least, most = min(w[0] for w in windows), max(w[1] for w in windows)
            near = np.flatnonzero((theirs != mine[i]) & (ids != a_ids[i]) & (score >= least) & (score <= most))
            near = near[np.lexsort((ids[near], ~score[near]))]
            falling = ~score[near]  # ascending, as searchsorted asks
            for p, (bottom, top) in zip(positives[i], windows):
                first = int(np.searchsorted(falling, ~top, side="left"))
                last = int(np.searchsorted(falling, ~bottom, side="right"))
                for n in near[first : min(last, first + k)].tolist():
                    row = (int(a_ids[i]), int(keys[i]), p["id"], p["key"], p["score"], int(ids[n]), int(score[n]))
                    for column, value in zip(out, row):
                        column.append(value)
    names = ["anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score", "negative_id", "negative_score"]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, out)})


def _blocks(n: Column, size: int) -> Column:
    return (1 + F.call_function("div", n, F.lit(size).cast("bigint"))).cast("int")


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least_share: tuple[int, int] = (80, 100),
    scale: int = 256,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
    row_block: int = ROW_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """Hard negatives of every anchor and each of its positives.

    Components are multiplied by ``scale`` and floored; a score is the inner product of the whole
    numbers with the anchor's.  An anchor's positives are the best ``positives`` other rows of its
    label.  A positive's negatives are the best ``negatives`` rows of other labels that score from
    ``least_share`` of the positive's score up to that score; a negative score leaves no room.
    Gives ``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    Ties go to smaller ids.  Rows without id or label, and vectors that are NULL or hold NULL, NaN
    or infinite components, take no part; vectors of different lengths don't meet; rows that repeat
    in id, label and vector count once, and a row of the anchor's own id is neither positive nor
    negative.  Scores outside 64 bits are cut to them before they are compared.
    """
    clean = rows.where(
        F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & usable(vector_column)
    ).select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(label_column).alias("label"),
        F.col(vector_column).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    named = clean.distinct().withColumns({"key": F.xxhash64("id", "label", "vector"), "dims": F.size("vector")})
    clean = stored(named, "vectors")

    def dealt(df: DataFrame, own: str, own_blocks: Column, other: str, other_blocks: Column) -> DataFrame:
        """Each row in its block of one side, once for every block of the other.

        Block numbers are of one type on both sides: cells meet by their hash.
        """
        return df.withColumn(own, F.pmod("key", own_blocks).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), (other_blocks - 1).cast("int")))
        )

    def best(df: DataFrame, k: int, keys: list[str], score: str, vec: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), vec)
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # Positives: anchors meet the rows of their label.  How many blocks a label needs follows
    # from its rows, so one that holds a third of them is many cells.
    sizes = clean.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
    sized = clean.join(sizes.where("asked > 0"), ["label", "dims"])
    row_blocks, anchor_blocks = _blocks(F.col("n"), row_block), _blocks(F.col("asked"), anchor_block)
    cell = ["label", "dims", "row_block", "anchor_block"]
    columns = [*cell, "id", "key", "vector"]
    table = dealt(sized, "row_block", row_blocks, "anchor_block", anchor_blocks).select(*columns)
    asking = dealt(sized.where("asks"), "anchor_block", anchor_blocks, "row_block", row_blocks).select(
        *[F.col(c).alias(c) for c in columns]
    )

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        return _positives(right, left, positives, scale)

    near = table.groupBy(*cell).cogroup(asking.groupBy(*cell)).applyInArrow(
        first, "anchor_id bigint, anchor_key bigint, positive_id bigint, positive_key bigint, positive_score bigint"
    )
    chosen = best(near, positives, ["anchor_id", "anchor_key"], "positive_score", "positive_id")
    lists = chosen.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key")).agg(
        F.collect_list(
            F.struct(F.col("positive_id").alias("id"), F.col("positive_key").alias("key"), F.col("positive_score").alias("score"))
        ).alias("positives")
    )
    asked = stored(clean.where("asks").join(lists, ["id", "key"]), "anchors")

    # Negatives: anchors, each with its few positives, meet all rows.
    total = clean.agg(F.count(F.lit(1))).first()[0]
    anchors = asked.agg(F.count(F.lit(1))).first()[0]
    row_blocks, anchor_blocks = F.lit(1 + total // row_block), F.lit(1 + anchors // anchor_block)
    cell = ["dims", "row_block", "anchor_block"]
    columns = [*cell, "id", "key", "label", "vector"]
    table = dealt(clean, "row_block", row_blocks, "anchor_block", anchor_blocks).select(*columns)
    asking = dealt(asked, "anchor_block", anchor_blocks, "row_block", row_blocks).select(*columns, "positives")

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        return _negatives(right, left, negatives, scale, least_share)

    hard = table.groupBy(*cell).cogroup(asking.groupBy(*cell)).applyInArrow(
        second,
        "anchor_id bigint, anchor_key bigint, positive_id bigint, positive_key bigint, positive_score bigint, "
        "negative_id bigint, negative_score bigint",
    )
    keys = ["anchor_id", "anchor_key", "positive_id", "positive_key"]
    ranked = best(hard, negatives, keys, "negative_score", "negative_id")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
