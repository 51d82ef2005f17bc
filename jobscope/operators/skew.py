"""Key frequency, key skew, and counts and joins that survive a hot key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from jobscope.functions.medians import covers_median

# Rows of a hot key that one task of a join takes.
ROWS_PER_TASK = 1_000_000
_NULL_SALTS = 4096


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))


def skew_ratio(counts: DataFrame, n: str = "row_count") -> DataFrame:
    """One row: largest and smallest key, and their integer ratio (at least 1)."""
    summary = counts.agg(F.max(n).alias("hot_rows"), F.min(n).alias("cold_rows"))
    return summary.withColumn(
        "skew_ratio", F.expr("greatest(1, hot_rows div greatest(cold_rows, 1))")
    )


def report(df: DataFrame, key: str, hot_ratio: float = 10.0) -> DataFrame:
    """Every key with its rows, share, ratio to the median key, rank and a hot flag.

    Rank and median are worked out on the table of *distinct* row counts by a window in one task:
    N rows allow at most sqrt(2N) distinct counts (1 + 2 + 3 + ... <= N), 1.5 million for 10^12
    rows.  The keys themselves are counted and then meet that table by their count.
    """
    counts = key_counts(df, key)
    sizes = counts.groupBy(F.col("row_count").alias("size")).agg(F.count(F.lit(1)).alias("keys"))
    whole = Window.partitionBy()
    rising = whole.orderBy("size")
    placed = sizes.select(
        "size",
        "keys",
        (F.sum("keys").over(rising) - F.col("keys")).alias("before"),
        F.sum("keys").over(whole).alias("total"),
        F.sum(F.col("size") * F.col("keys")).over(whole).alias("all_rows"),
        (F.count(F.lit(1)).over(whole) + 1 - F.row_number().over(rising)).alias("key_rank"),
    )
    middle = F.when(covers_median("keys"), F.col("size"))
    median = (F.min(middle).over(whole) + F.max(middle).over(whole)) / 2
    ranks = placed.select("size", "key_rank", "all_rows", median.alias("median"))
    return counts.join(ranks, F.col("row_count") == F.col("size")).select(
        key,
        "row_count",
        (F.col("row_count") / F.col("all_rows")).alias("share"),
        (F.col("row_count") / F.col("median")).alias("ratio_to_median"),
        F.col("key_rank").cast("bigint").alias("key_rank"),
        (F.col("row_count") / F.col("median") >= hot_ratio).alias("is_hot"),
    )


# The sketch holds this many items for each key that can be hot, and no more than Spark allows:
# its error is then a fifth of the share asked for, so no hot key is missing from it.
_ITEMS_PER_HOT_KEY = 16
_MOST_ITEMS = 1_000_000
_SKETCHED = (NumericType, StringType, BooleanType, DateType, TimestampType, TimestampNTZType)


def hot_keys(df: DataFrame, key: str, min_share: float = 0.01) -> DataFrame:
    """Keys that hold at least ``min_share`` of all rows: never more than 1 / min_share keys.

    A frequent-items sketch, one per task, finds the candidates (at most 16 / min_share of them);
    a second look at the key column counts only those, exactly.  Other keys are never shuffled.
    Shares too small for a sketch, and keys of types it does not take, are counted in full.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1")
    items = math.ceil(_ITEMS_PER_HOT_KEY / min_share)
    if items > _MOST_ITEMS or not isinstance(df.schema[key].dataType, _SKETCHED):
        counts = key_counts(df, key)
        total = counts.agg(F.sum("row_count")).scalar()
        return counts.where(F.col("row_count") >= F.lit(min_share) * total)
    keys = df.select(F.col(key).alias("_key"))
    sketch = keys.agg(F.call_function("approx_top_k", F.col("_key"), F.lit(items), F.lit(items)).alias("_found"))
    found = sketch.select(F.inline("_found")).select(F.col("item").alias("_item"))
    # the sketch leaves NULL out; it is one more candidate
    nothing = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[key].dataType).alias("_item"))
    candidates = F.broadcast(found.unionByName(nothing))
    total = keys.agg(F.count(F.lit(1))).scalar()
    counted = keys.join(candidates, F.col("_key").eqNullSafe(F.col("_item")), "left_semi")
    return key_counts(counted.withColumnRenamed("_key", key), key).where(F.col("row_count") >= F.lit(min_share) * total)


def _salt(spread: Sequence[str], salts: Column | int) -> Column:
    # A hash of row values, not a random number: a recomputed task must salt the same way.
    return F.pmod(F.xxhash64(*spread), F.lit(salts) if isinstance(salts, int) else salts).cast("int")


def salted_count(df: DataFrame, key: str, spread: Sequence[str], salts: int = 16) -> DataFrame:
    """``key_counts`` in two phases, with each key spread over ``salts`` reducers first.

    A count is combined before it moves anyway, so ``key_counts`` is the better plan for it; the
    two phases are the pattern for aggregates that Spark does not combine.
    """
    partial = df.groupBy(key, _salt(spread, salts).alias("salt")).agg(
        F.count(F.lit(1)).alias("part")
    )
    return partial.groupBy(key).agg(F.sum("part").alias("row_count"))


def key_salts(
    df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK, min_share: float = 0.01
) -> DataFrame:
    """``hot_keys`` with ``salts``: over how many tasks a key's rows are spread."""
    salts = F.ceil(F.col("row_count") / F.lit(rows_per_task)).cast("int")
    return hot_keys(df, key, min_share).withColumn("salts", salts)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    min_share: float = 0.01,
    how: str = "inner",
) -> DataFrame:
    """Join in which the left side's hot keys are spread over tasks of ``rows_per_task`` rows.

    Only the keys found hot are salted, each by its own number of rows, so only their right-hand
    rows are copied; every other row joins as usual.  The hot list is broadcast: it cannot
    exceed 1 / min_share keys.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    found = key_salts(left.where(F.col(key).isNotNull()), key, rows_per_task, min_share)
    hot = F.broadcast(found.select(F.col(key).alias("_hot_key"), F.col("salts").alias("_salts")))
    # NULL keys match nothing; in a left join they are spread so they do not pile up either.
    salts = F.when(F.col(key).isNull(), F.lit(_NULL_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted_left = (
        left.join(hot, F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_salt", _salt(spread, salts))
        .drop("_hot_key", "_salts")
    )
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = (
        right.join(hot, F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_hot_key", "_salts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def partitioned_count(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows per key, laid out in ``partitions`` hash partitions of the key.

    Rows are counted before they move, so each task ships one row per key and a key with a
    third of the table costs no more than any other.
    """
    return key_counts(df, key).repartition(partitions, key)


def partition_load(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows and keys each partition would get from ``df.repartition(partitions, key)``."""
    counts = key_counts(df, key)
    target = F.pmod(F.hash(key), F.lit(partitions)).alias("partition_id")
    return counts.groupBy(target).agg(
        F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("key_count")
    )
