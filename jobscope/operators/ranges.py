"""Range-partitioned reads: which partition a row falls in, and better bounds."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_DOWN, ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobscope.operators.slices import VALUES_PER_SLICE, running_counts


@dataclass(frozen=True)
class Strides:
    """Partition i > 0 starts at ``first + width * i``; partition 0 takes everything below."""

    first: int
    width: int
    partitions: int

    @property
    def cuts(self) -> list[int]:
        return [self.first + self.width * i for i in range(1, self.partitions)]

    def bucket(self, col: Column) -> Column:
        """Partition index; below the range the first, above it the last, NULL the first."""
        if self.partitions == 1:
            return F.lit(0).cast("bigint")
        top = self.first + self.width * self.partitions
        inside = F.least(F.greatest(col, F.lit(self.first)), F.lit(top)) - F.lit(self.first)
        index = F.call_function("div", inside, F.lit(self.width).cast("bigint"))
        return F.coalesce(F.least(index, F.lit(self.partitions - 1)), F.lit(0)).cast("bigint")


def strides(lower: int, upper: int, partitions: int) -> Strides:
    """Strides of a range-partitioned read with these options.

    The width is truncated, and half of what truncation loses is added to the start, so that
    the first and last partition share the loss.
    """
    if lower > upper:
        raise ValueError("lower bound above upper bound")
    n = min(partitions, upper - lower) if upper > lower else 1
    if n <= 1:
        return Strides(lower, 1, 1)
    with localcontext() as ctx:
        ctx.prec = 34  # as in the JVM reader; a half can fall either way beyond it
        step = Decimal("1e-18")
        exact = (Decimal(upper) / n).quantize(step, ROUND_HALF_EVEN) - (
            Decimal(lower) / n
        ).quantize(step, ROUND_HALF_EVEN)
        width = exact.to_integral_value(ROUND_DOWN)
        lost = (exact - width) * n / width
        shift = (lost / 2 * width).to_integral_value(ROUND_HALF_UP)
    return Strides(lower + int(shift), int(width), n)


def partition_histogram(
    df: DataFrame, col: str, lower: int, upper: int, partitions: int, hot_factor: int = 2
) -> DataFrame:
    """Rows, share and a hotspot flag for every partition of a range-partitioned read.

    A partition is a hotspot when it holds at least ``hot_factor`` times its even share.
    """
    plan = strides(lower, upper, partitions)
    counted = df.groupBy(plan.bucket(F.col(col)).alias("partition_id")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    # One row per partition of the read, so the window below sees `partitions` rows at most.
    slots = df.sparkSession.range(plan.partitions).withColumnRenamed("id", "partition_id")
    filled = slots.join(counted, "partition_id", "left").fillna(0, ["row_count"])
    total = F.sum("row_count").over(Window.partitionBy())
    return filled.select(
        "partition_id",
        "row_count",
        F.try_divide(F.col("row_count"), total).alias("share"),
        (
            (F.lit(plan.partitions) > 1)
            & (F.col("row_count") > 0)
            & (F.col("row_count") * plan.partitions >= total * hot_factor)
        ).alias("is_hotspot"),
    )


def case_bucket(col: Column, pivot: int) -> Column:
    """Everything below the pivot in bucket 1, every other value in a bucket of its own."""
    return F.when(col < pivot, F.lit(1).cast("bigint")).otherwise(col.cast("bigint"))


def suggest_bounds(
    df: DataFrame, col: str, partitions: int, per_slice: int = VALUES_PER_SLICE
) -> DataFrame:
    """Upper bounds that split the rows evenly: the k/n discrete quantiles, exactly.

    Values are counted first.  Where there are more than ``per_slice`` of them, a sketch cuts them
    into slices, and only those that hold a bound are walked.
    """
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("bound"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The k-th bound is the value that covers row ceil(k * total / partitions).
    first = F.expr(f"before * {partitions} div total + 1")
    last = F.least(F.expr(f"(before + n) * {partitions} div total"), F.lit(partitions - 1))
    ranked = running_counts(counts, "bound", "n", per_slice=per_slice, wanted=first <= last)
    return ranked.select(F.explode(F.sequence(first, last)).alias("k"), "bound")
