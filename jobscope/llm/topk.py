"""Exact top-k by inner product with a uniform threshold in three phases.

A score is the sum of local scores, one per list: the components are cut into ``LISTS`` ranges
and each gives a list of partial products.  (1) Every list names its best rows per query; the
k-th best exact score among these is a safe cutoff, since k rows reach it.  (2) With the cutoff
at the tasks, each collects the rows of which some list reaches the uniform threshold, the
cutoff's share of one list: a row that no list brings that far cannot reach the cutoff.  (3)
The scores of the collected rows are resolved exactly, and those below the cutoff go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import numbers, stored

LISTS = 4
# Rows and queries that meet in one task: a cell of the grid.
ROW_BLOCK = 8192
QUERY_BLOCK = 1024
_STRIP = 128  # queries scored at once inside a cell
_LONG = (1 << 63) - 1


def usable(vector: str) -> F.Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~odd, F.lit(False))


def _integers(table: pa.Table, scale: float) -> np.ndarray:
    """The scaled and floored vectors, one row each; whole doubles, or Python numbers if too large."""
    lists = table.column("vector").combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dims = len(values) // max(1, len(lists))
    whole = np.floor(values * scale).reshape(len(lists), dims)
    if dims * np.abs(whole).max(initial=0) ** 2 < 2**52:
        return whole
    with np.errstate(over="ignore"):
        return np.array([[int(np.floor(x * scale)) if np.isfinite(x * scale) else int(x) * int(scale) for x in row] for row in values.reshape(whole.shape)], object)


def _lists(dims: int) -> list[slice]:
    edges = np.linspace(0, dims, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a] or [slice(0, 0)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best entries of one row of scores, ties to smaller ids."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        chosen = np.flatnonzero(score >= floor)
    else:
        chosen = np.arange(len(score))
    return chosen[np.lexsort((ids[chosen], -score[chosen]))[:k]]


def _answer(query: list, vec: list, score: list) -> pa.Table:
    clipped = [max(-_LONG - 1, min(_LONG, int(s))) for s in score]
    return pa.table(
        {"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(clipped, pa.int64())}
    )


def _first_phase(queries: pa.Table, rows: pa.Table, k: int, scale: float) -> pa.Table:
    """Per query the k best rows of every list, with exact scores."""
    q, x = _integers(queries, scale), _integers(rows, scale)
    q_ids, ids = numbers(queries.column("id")), numbers(rows.column("id"))
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), _STRIP):
        part = q[at : at + _STRIP]
        local = [part[:, s] @ x[:, s].T for s in _lists(x.shape[1])]
        top = min(k + 1, len(ids))  # the query itself may be among them
        for i in range(len(part)):
            chosen = np.unique(np.concatenate([np.argpartition(s[i], len(ids) - top)[len(ids) - top :] for s in local]))
            chosen = chosen[ids[chosen] != q_ids[at + i]]
            exact = sum(s[i, chosen] for s in local)
            keep = _best(exact, ids[chosen], k) if len(chosen) else []
            out[0].extend([int(q_ids[at + i])] * len(keep))
            out[1].extend(ids[chosen][keep].tolist())
            out[2].extend(np.asarray(exact)[keep].tolist())
    return _answer(*out)


def _later_phases(queries: pa.Table, rows: pa.Table, k: int, scale: float) -> pa.Table:
    """Per query the rows of this cell that reach its cutoff, k at most: all that can be answers."""
    q, x = _integers(queries, scale), _integers(rows, scale)
    q_ids, ids = numbers(queries.column("id")), numbers(rows.column("id"))
    cutoffs = queries.column("cutoff").to_pylist()
    lists = _lists(x.shape[1])
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), _STRIP):
        part = q[at : at + _STRIP]
        cutoff = np.array([-np.inf if c is None else c for c in cutoffs[at : at + _STRIP]], np.float64)
        share = cutoff / len(lists)
        share -= np.abs(share) * 1e-9  # a threshold rounded up would lose a row
        local = [part[:, s] @ x[:, s].T for s in lists]
        collected = np.zeros((len(part), len(ids)), bool)
        for scores in local:
            collected |= (scores >= share[:, None]).astype(bool)
        for i in range(len(part)):
            chosen = np.flatnonzero(collected[i])
            chosen = chosen[ids[chosen] != q_ids[at + i]]
            exact = sum(s[i, chosen] for s in local)
            if cutoffs[at + i] is not None:
                reach = np.asarray(exact >= cutoffs[at + i], bool)
                chosen, exact = chosen[reach], exact[reach]
            if not len(chosen):
                continue
            keep = _best(exact, ids[chosen], k)
            out[0].extend([int(q_ids[at + i])] * len(keep))
            out[1].extend(ids[chosen][keep].tolist())
            out[2].extend(np.asarray(exact)[keep].tolist())
    return _answer(*out)


def top_k(
    rows: DataFrame,
    is_query: F.Column,
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: float = 1.0,
    row_block: int = ROW_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the k best rows of every query.

    Components are multiplied by ``scale`` and floored; a score is the inner product of the
    whole numbers.  Every query meets every row, in a grid of blocks, with all rows but those of
    its own id and those of another length.  Ties go to smaller ids.  Rows without id, and
    vectors that are NULL or hold NULL, NaN or infinite components, take no part; rows that
    repeat in id and vector count once.  Scores outside 64 bits are cut to the largest long.
    """
    spark = rows.sparkSession
    clean = rows.where(F.col(id_column).isNotNull() & usable(vector_column)).select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("vector"), is_query.alias("asks")
    )
    clean = stored(clean.distinct().withColumn("dims", F.size("vector")), "vectors")
    asked = clean.where("asks")
    total = clean.agg(F.count("*"), F.count_if("asks")).first()
    row_blocks, query_blocks = 1 + total[0] // row_block, 1 + total[1] // query_block
    hashed = F.xxhash64("id", "vector")

    def spread(block: F.Column, other: str, blocks: int, df: DataFrame, own: str, *more: str) -> DataFrame:
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(other)
        return df.select(block.cast("int").alias(own), everywhere, "dims", "id", "vector", *more)

    grid = ["row_block", "query_block", "dims"]
    table = spread(F.pmod(hashed, F.lit(row_blocks)), "query_block", query_blocks, clean, "row_block").groupBy(*grid)

    def cells(phase, queries: DataFrame, *more: str) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _answer([], [], [])
            return phase(right, left, k, scale)

        asking = spread(F.pmod(hashed, F.lit(query_blocks)), "row_block", row_blocks, queries, "query_block", *more)
        found = table.cogroup(asking.groupBy(*grid)).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    seen = cells(_first_phase, asked)
    cutoff = seen.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff"))
    ready = stored(asked.join(cutoff, "id", "left"), "queries")
    return cells(_later_phases, ready, "cutoff").select("query_id", "rank", "vec_id", "score")
