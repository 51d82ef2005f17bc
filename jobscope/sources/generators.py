"""Rows made from ids.

Every generator is a function of a row's id alone: rows come out the same however the ids are
partitioned and however often a task is run again, and the work splits like any other scan.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.text import padded_id
from jobscope.vocab import COUNTRIES, DEFAULT_SEED, EVENT_TYPE_WEIGHTS, EVENT_TYPES

_START = "TIMESTAMP_NTZ '2026-01-01 00:00:00'"
_MINUTES = 14 * 24 * 60


def synth_range(spark: SparkSession, n: int, *exprs: str) -> DataFrame:
    return spark.range(n).selectExpr(*exprs)


def _digits(start: int, length: int) -> Column:
    """A whole number from some hex digits of the row's hash."""
    return F.conv(F.substring("_hash", start, length), 16, 10).cast("bigint")


def _weighted(percent: Column) -> Column:
    """Event type for a number from 0 to 99."""
    tops = list(accumulate(EVENT_TYPE_WEIGHTS))
    pick = F.lit(EVENT_TYPES[-1])
    for name, top in reversed(list(zip(EVENT_TYPES[:-1], tops))):
        pick = F.when(percent < top, name).otherwise(pick)
    return pick


def synth_events(ids: DataFrame, rows: int | Column, seed: int = DEFAULT_SEED) -> DataFrame:
    """Events for a table of ids: weighted types, amounts by type, two weeks, five countries.

    One hash per row feeds all five draws from different digits of it.  ``rows`` sets the number of
    customers, one in eight rows and at least 20; it may be a scalar subquery.
    """
    count = F.lit(rows) if isinstance(rows, int) else rows
    customers = F.greatest(F.lit(20), F.floor(count / 8))
    hashed = ids.select("id", F.md5(F.concat_ws(":", F.lit(seed), F.col("id"))).alias("_hash"))
    kind, amount, minute = _digits(1, 5) % 100, _digits(6, 6), _digits(12, 5)
    country, customer = _digits(17, 4), _digits(21, 12)
    drawn = hashed.select(
        "id",
        _weighted(kind).alias("event_type"),
        amount.alias("draw"),
        (minute % (_MINUTES + 1)).alias("minute"),
        (country % len(COUNTRIES)).alias("country_no"),
        (customer % customers + 1).alias("customer_no"),
    )
    kind = F.col("event_type")
    cents = (
        F.when(kind == "view", 0)
        .when(kind == "cart", 1000 + F.col("draw") % 24001)
        .when(kind == "purchase", 1500 + F.col("draw") % 48501)
        .otherwise(-(500 + F.col("draw") % 19501))
    )
    countries = F.array(*[F.lit(c) for c in COUNTRIES])
    ts = F.expr(_START) + F.make_dt_interval(mins=F.col("minute"))
    return drawn.select(
        padded_id("evt-", F.col("id"), 8).alias("event_id"),
        padded_id("cust-", F.col("customer_no"), 6).alias("customer_id"),
        kind.alias("event_type"),
        (cents / 100).alias("amount"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_ts"),
        F.get(countries, F.col("country_no").cast("int")).alias("country"),
    )


def skewed_rows(ids: DataFrame, hot_rows: int, cold_rows: int) -> DataFrame:
    """Ids 0..hot_rows-1 go to one hot key, every following ``cold_rows`` ids to a cold key."""
    rest = F.col("id") - hot_rows
    is_hot = F.col("id") < hot_rows
    part = F.when(is_hot, 0).otherwise(F.call_function("div", rest, F.lit(cold_rows)) + 1)
    return ids.select(
        F.when(is_hot, "hot_customer")
        .otherwise(padded_id("cold_customer_", part, 3))
        .alias("customer_key"),
        part.alias("source_partition"),
        F.when(is_hot, F.col("id")).otherwise(rest % cold_rows).alias("row_id"),
    )


def synth_skewed(
    spark: SparkSession, partitions: int = 24, hot_rows: int = 100_000, cold_rows: int = 1_000
) -> DataFrame:
    """A hot key and ``partitions`` - 1 cold keys.

    The key follows from the id, so the hot key's rows are spread over all tasks.
    """
    return skewed_rows(spark.range(hot_rows + (partitions - 1) * cold_rows), hot_rows, cold_rows)
