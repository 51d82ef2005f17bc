"""Daily and per-type summaries of event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.casts import event_date, try_ts
from jobscope.functions.money import (
    avg_of_parts,
    merged_parts,
    money_avg,
    money_parts,
    money_sum,
    sum_of_parts,
)


def with_event_date(events: DataFrame, ts_text: str = "event_ts") -> DataFrame:
    """Parse the event time and derive its date."""
    return events.withColumn("event_timestamp", try_ts(F.col(ts_text))).withColumn(
        "event_date", event_date(F.col("event_timestamp"))
    )


def stamp(df: DataFrame, run_id: str, processed_at: Column | None = None) -> DataFrame:
    """Mark every row with the run that wrote it and, if given, the processing time."""
    stamped = df.withColumn("run_id", F.lit(run_id))
    return stamped if processed_at is None else stamped.withColumn("processed_at", processed_at)


def _measures(customer: str, amount: str, approximate: bool = False) -> list[Column]:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return [
        F.count(F.lit(1)).alias("event_count"),
        distinct(F.col(customer)).alias("unique_customers"),
        money_sum(F.col(amount)).alias("net_amount"),
        money_avg(F.col(amount)).alias("average_amount"),
    ]


def daily(
    events: DataFrame,
    dims: Sequence[str] = ("country",),
    *,
    customer: str = "customer_id",
    amount: str = "amount",
    approximate: bool = False,
) -> DataFrame:
    """Events, customers and money per day and dimension.

    The exact customer count shuffles on (group, customer) before it shuffles on the group,
    so one huge group is counted by many tasks.
    """
    return events.groupBy("event_date", *dims).agg(*_measures(customer, amount, approximate))


def both(
    events: DataFrame,
    dim: str = "country",
    *,
    customer: str = "customer_id",
    amount: str = "amount",
) -> DataFrame:
    """``daily`` and ``by_type`` from one pass over the events.

    Reading and parsing the events is the dear part.  They are combined once per day, dimension,
    type and customer; both summaries follow from that much smaller table, and customers are
    counted only where they are asked for.  ``daily_part`` and ``type_part`` take it apart.
    """
    keys = ["event_date", dim, "event_type", customer]
    parts = {f"_{p}": c for p, c in money_parts(F.col(amount)).items()}
    combined = events.groupBy(*[F.col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_events"), *[c.alias(p) for p, c in parts.items()]
    )
    # Always holds; it keeps the counts that one summary does not need, so that Spark makes the
    # same table for both, once.
    return combined.where(F.col("_events") >= F.col("_n"))


def daily_part(combined: DataFrame, dim: str = "country", customer: str = "customer_id") -> DataFrame:
    parts = merged_parts("_")
    return combined.groupBy("event_date", dim).agg(
        F.sum("_events").alias("event_count"),
        F.count_distinct(F.col(customer)).alias("unique_customers"),
        sum_of_parts(parts).alias("net_amount"),
        avg_of_parts(parts).alias("average_amount"),
    )


def subtotals(
    events: DataFrame,
    dims: Sequence[str] = ("event_date", "country"),
    *,
    customer: str = "customer_id",
    amount: str = "amount",
) -> DataFrame:
    """Events, customers and money per combination of ``dims``, per leading dims, and in all.

    ``level`` says how many dims a row is summed over: 0 for the finest groups, so a NULL value
    (level 0) is told from a total.  Events are combined once per group and customer; only that
    smaller table is multiplied by the levels, and money is added from exact parts.
    """
    parts = {f"_{p}": c for p, c in money_parts(F.col(amount)).items()}
    combined = events.groupBy(*dims, customer).agg(
        F.count(F.lit(1)).alias("_events"), *[c.alias(p) for p, c in parts.items()]
    )
    merged = merged_parts("_")
    # the grouping id has a bit for every dim that is summed over: 0, 1, 3, 7, ...
    return combined.rollup(*dims).agg(
        F.bit_count(F.grouping_id()).cast("int").alias("level"),
        F.sum("_events").alias("event_count"),
        F.count_distinct(F.col(customer)).alias("unique_customers"),
        sum_of_parts(merged).alias("net_amount"),
        avg_of_parts(merged).alias("average_amount"),
    )


def type_part(combined: DataFrame) -> DataFrame:
    return combined.groupBy("event_type").agg(
        F.sum("_events").alias("event_count"), sum_of_parts(merged_parts("_")).alias("net_amount")
    )


def by_type(events: DataFrame, *, amount: str = "amount") -> DataFrame:
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        money_sum(F.col(amount)).alias("net_amount"),
    )


def profile(df: DataFrame, values: dict[str, Sequence[str]]) -> DataFrame:
    """Rows per listed value of each column, zero where a value is absent.

    One pass: each listed value is a conditional count, so nothing is joined.
    """
    listed = [(c, v) for c, vs in values.items() for v in vs]
    counts = [F.count_if(F.col(c) == v).alias(f"n{i}") for i, (c, v) in enumerate(listed)]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(v).alias("value"),
                F.col(f"n{i}").alias("row_count"),
            )
            for i, (c, v) in enumerate(listed)
        ]
    )
    return df.agg(*counts).select(F.inline(rows))
