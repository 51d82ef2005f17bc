"""Distinct counts that are stored per day and merged over any range of days."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# 2^14 registers of a sketch: 10 KB, and a standard error of 1.04 / sqrt(2^14) = 0.8 %.
REGISTERS_LOG2 = 14


def relative_error(registers_log2: int = REGISTERS_LOG2) -> float:
    """The standard error of an estimate, as a share of the true count."""
    return 1.04 / 2 ** (registers_log2 / 2)


def day_sketches(
    events: DataFrame,
    dims: Sequence[str] = ("country",),
    *,
    day: str = "event_date",
    customer: str = "customer_id",
    registers_log2: int = REGISTERS_LOG2,
) -> DataFrame:
    """Per day and dimension the number of events and a sketch of the customers.

    Sketches are combined where events are read, so a group moves one sketch per task however
    many events it has.  NULL customers are not counted, as in an exact distinct count.
    """
    return events.groupBy(day, *dims).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.hll_sketch_agg(F.col(customer), F.lit(registers_log2)).alias("customer_sketch"),
    )


def store_days(sketches: DataFrame, path: str, day: str = "event_date") -> None:
    """Add days to a stored table; a day that is there already is replaced, all others stay.

    A day is a few rows, so each is written as one file.
    """
    (
        sketches.repartition(F.col(day))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day)
        .parquet(path)
    )


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; a range of days reads their folders only."""
    return spark.read.parquet(path)


def merge_days(
    sketches: DataFrame, dims: Sequence[str] = ("country",), since: date | None = None, until: date | None = None, day: str = "event_date"
) -> DataFrame:
    """Events and about how many distinct customers per dimension from ``since`` to ``until``.

    The events of the range are not read again.  ``dims`` may be fewer than those stored.  The
    number of events is exact; the number of customers is off by ``relative_error`` typically, and
    ``daily`` over the events gives it exactly.
    """
    kept: Column = F.lit(True)
    if since is not None:
        kept = kept & (F.col(day) >= F.lit(since))
    if until is not None:
        kept = kept & (F.col(day) <= F.lit(until))
    return sketches.where(kept).groupBy(*dims).agg(
        F.sum("event_count").alias("event_count"),
        F.hll_sketch_estimate(F.hll_union_agg("customer_sketch")).alias("about_customers"),
    )
