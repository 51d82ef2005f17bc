"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is how often each of its documents is expected in the mix.  The
whole part is taken outright; the fraction is an inclusion probability.  The cube method moves
the probabilities of a few documents at a time through the null space of the constraints (number
of documents, number of words) until each is 0 or 1, so both totals stay what they were expected
to be.  Groups of documents do this side by side; the at most two that each group leaves open
meet in the next round, until one small group per source is left to land.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import numbers, row_key, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
# Documents that go through one flight together.
FLIGHT_ROWS = 2_000
_TINY = 1e-9


def word_count(text: str = "text") -> F.Column:
    """Runs of characters other than ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def flight(chance: np.ndarray, size: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """Chances moved to 0 or 1 with their sum and the sum of chance times size kept.

    At most two stay between 0 and 1.  With ``land`` these are settled too: first with only the
    words kept, then the last one by its chance.
    """
    chance = chance.copy()
    todo = np.flatnonzero((chance > _TINY) & (chance < 1 - _TINY))
    chance[(chance <= _TINY)], chance[chance >= 1 - _TINY] = 0.0, 1.0
    draws = np.random.default_rng(seed).random(len(todo) + 4).tolist()
    p, s = chance[todo].tolist(), size[todo].astype(float).tolist()
    open_, drawn, following = [], 0, 0

    def settle(at: list[int], move: list[float]) -> list[int]:
        """Step along ``move`` or against it until a chance reaches 0 or 1; gives what stays open."""
        nonlocal drawn
        up = min(((1 - p[i]) if m > 0 else -p[i]) / m for i, m in zip(at, move) if m)
        down = min((p[i] if m > 0 else p[i] - 1) / m for i, m in zip(at, move) if m)
        step = up if draws[drawn] * (up + down) < down else -down
        drawn += 1
        rest = []
        for i, m in zip(at, move):
            p[i] += step * m
            if p[i] <= _TINY or p[i] >= 1 - _TINY:
                p[i] = 0.0 if p[i] <= _TINY else 1.0
            else:
                rest.append(i)
        return rest

    while True:
        while len(open_) < 3 and following < len(p):
            open_.append(following)
            following += 1
        if len(open_) < 3:
            break
        a, b, c = (s[i] for i in open_)
        # orthogonal to (1, 1, 1) and to the sizes
        move = [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]
        open_ = settle(open_, move)
    if land:
        while len(open_) == 2:
            a, b = (s[i] for i in open_)
            open_ = settle(open_, [b, -a] if a or b else [1.0, -1.0])
        for i in open_:
            p[i] = float(draws[drawn] < p[i])
    chance[todo] = p
    return chance


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Per source (one row each in the result): ``source_size``, ``documents`` and ``target``.

    Sources in code-point order, NULL last, weigh ``weights`` in turn.  They share ``share`` of
    all words by weight, none above ``most`` times its size; what is cut off is shared again
    among the others.  Sources are ranked by range and only sums reach the driver, so their
    number may grow with the data.
    """
    order = [F.col("source").isNull(), F.col("source")]
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    ranged = stored(totals.repartitionByRange(*order).withColumn("task", F.spark_partition_id()), "sources")
    tasks = ranged.groupBy("task").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("task").orderBy(*order)) - 1 + F.col("base")
    turn = F.pmod(place, F.lit(len(weights))).cast("int") + 1
    weigh = F.element_at(F.array(*map(F.lit, weights)), turn)
    weighted = ranged.join(tasks, "task").select("source", "source_size", "documents", weigh.alias("weight"))
    weighted = stored(weighted.withColumn("most", F.col("source_size") * most), "weights")
    wanted = float(share * (weighted.agg(F.sum("source_size")).first()[0] or 0))
    rate, before = 0.0, None
    full = F.lit(False)  # whose share by weight reaches their most
    while True:
        cut, weight, n = weighted.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count_if(full),
        ).first()
        if n == before or not weight:
            break
        before, rate = n, (wanted - cut) / weight
        full = F.col("weight") * rate >= F.col("most")
    target = F.when(full, F.col("most")).otherwise(F.col("weight") * rate)
    return stored(weighted.select("source", "source_size", "documents", target.cast("double").alias("target")), "targets")


def _fly(open_: DataFrame, land: bool) -> DataFrame:
    """One round of flights, one per (number of the source, slice)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("size", "ascending")])
        seed = int(numbers(table.column("key"))[0]) & ((1 << 63) - 1)
        moved = flight(numbers(table.column("chance")), numbers(table.column("size")), seed, land)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(moved, pa.float64()))

    return open_.groupBy("source", "slice").applyInArrow(run, open_.schema)


def mix(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    flight_rows: int = FLIGHT_ROWS,
) -> DataFrame:
    """Per distinct row: id, ``key``, ``rows``, ``size``, ``source_size``, ``target``, ``copies``.

    ``copies`` says how often the mix takes the row in all, where it stands ``rows`` times in the
    table: rows that repeat are pooled before anything moves.  NULL text has size 0, NULL is a
    source of its own, a source without words takes nothing.  ``key`` is a hash of the row;
    random choices follow from keys only, so reruns agree.
    """
    sized = documents.select(
        row_key(documents).alias("key"),
        F.col(id_column),
        F.col(source_column).alias("source"),
        word_count(text_column).alias("size"),
    )
    sized = stored(sized.groupBy(*sized.columns).agg(F.count("*").alias("rows")), "sizes")
    words = (F.col("size") * F.col("rows")).alias("size")
    wanted = targets(sized.select("source", words), weights, share, most)
    often = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = often * F.col("rows")
    spread = joined.withColumns(
        {
            "whole": F.floor(expected),
            "chance": expected - F.floor(expected),
            "slice": F.pmod(F.xxhash64("key"), 1 + F.floor(F.col("documents") / flight_rows)),
        }
    )
    settled = F.col("chance").isin(0.0, 1.0)
    left, parts = spread, []
    while True:
        per_source = left.groupBy("source").agg(F.count("*").alias("n"))
        largest = per_source.agg(F.max("n")).first()[0] or 0
        last = not largest > flight_rows
        if parts:  # the first round is dealt already
            slices = per_source.select(F.col("source").alias("of"), (1 + F.floor(F.col("n") / flight_rows)).alias("slices"))
            left = left.join(slices, F.col("source").eqNullSafe(F.col("of")))
            left = left.withColumn("slice", F.pmod(F.xxhash64("key", F.lit(len(parts))), F.col("slices")))
        moved = _fly(left.select(*spread.columns), last)
        if last:
            parts.append(moved)
            break
        moved = stored(moved, "flight")
        parts.append(moved.where(settled))
        left = moved.where(~settled)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    copies = (F.col("whole") + F.col("chance")).cast("bigint")
    return every.select(id_column, "key", "rows", "size", "source_size", "target", copies.alias("copies"))


def per_row(mixed: DataFrame) -> DataFrame:
    """``mixed`` with one row per row of the table: its ``copies`` differ by one at most among equals."""
    once = mixed.where("rows = 1")
    blocks = mixed.where("rows > 1").withColumn("_from", F.explode(F.expr("sequence(0L, rows - 1, 10000L)")))
    blocks = blocks.hint("rebalance")  # a row may stand for a third of the table
    several = blocks.withColumn("_number", F.explode(F.expr("sequence(_from, least(_from + 10000L, rows) - 1)")))
    own = F.floor(F.col("copies") / F.col("rows")) + (F.col("_number") < F.col("copies") % F.col("rows")).cast("bigint")
    return once.unionByName(several.withColumn("copies", own).drop("_from", "_number"))


def repeat(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; ``mixed`` is a stored table."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    chosen = mixed.where("copies > 0").select(F.col("key").alias("_key"), "rows", F.col("copies").alias("_copies"))
    keyed = documents.select(row_key(documents).alias("_key"), F.struct(*columns).alias("_row"))
    # The numbers grow with the documents, so both sides are moved by their key at every size.
    taken = keyed.join(chosen.where("rows = 1").drop("rows").hint("merge"), "_key")
    taken = taken.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select("_row")
    repeated = chosen.where("rows > 1").drop("rows")
    if not repeated.isEmpty():
        several = keyed.join(repeated, "_key")
        several = several.groupBy("_key", "_copies").agg(F.first("_row").alias("_row"))
        blocks = several.withColumn("_from", F.explode(F.expr("sequence(1L, _copies, 10000L)"))).hint("rebalance")
        copies = F.explode(F.expr("sequence(_from, least(_from + 9999L, _copies))"))
        taken = taken.unionByName(blocks.withColumn("_copy", copies).select("_row"))
    return taken.select("_row.*")
