"""Exact medians per group without holding a group in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.operators.slices import running_counts


def covers_median(n: str) -> Column:
    """Marks the one or two values the median lies on, among rows of ``running_counts``."""
    lower, upper = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    upto = F.col("before") + F.col(n)
    return ((F.col("before") < lower) & (upto >= lower)) | ((F.col("before") < upper) & (upto >= upper))


def grouped_median(df: DataFrame, groups: Sequence[str], value: str, alias: str) -> DataFrame:
    """Exact median of ``value`` per group.

    Equal values are counted before anything meets, and a large group is walked in slices.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    middle = running_counts(counts, value, "_n", groups, wanted=covers_median("_n"))
    return middle.groupBy(*groups).agg(
        ((F.min(value) + F.max(value)) / 2).cast("double").alias(alias)
    )
