"""Threshold alarms over fixed periods.

The same plans serve batch tables and streams: only built-in windows are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.vocab import ALARM_PERIOD, IDLE_PERIODS


def sum_alarm(
    metrics: DataFrame,
    ts: str,
    value: str,
    keys: Sequence[str] = (),
    threshold: float = 1,
    period: str = ALARM_PERIOD,
) -> DataFrame:
    """Sum per period and whether it reaches the threshold.  Missing periods do not breach."""
    return (
        metrics.groupBy(F.window(ts, period).alias("period"), *keys)
        .agg(F.sum(value).alias("total"))
        .select(
            F.col("period.start").alias("period_start"),
            *keys,
            "total",
            (F.col("total") >= threshold).alias("in_alarm"),
        )
    )


def idle_alarm(
    metrics: DataFrame,
    ts: str,
    value: str,
    keys: Sequence[str] = (),
    threshold: float = 1,
    period_minutes: int = 5,
    periods: int = IDLE_PERIODS,
) -> DataFrame:
    """Starts of the periods that complete ``periods`` breaches in a row.

    Breaching periods are counted in a sliding window over the periods themselves.  A period
    without data is simply not there, so the count falls short and the streak is broken.
    """
    period = f"{period_minutes} minutes"
    span = f"{period_minutes * periods} minutes"
    breaches = (
        metrics.groupBy(F.window(ts, period), *keys)
        .agg(F.avg(value).alias("mean"))
        .where(F.col("mean") >= threshold)
    )
    return (
        breaches.groupBy(F.window(F.window_time("window"), span, period).alias("span"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == periods)
        .select(
            (F.col("span.end") - F.expr(f"INTERVAL {period_minutes} MINUTES")).alias(
                "period_start"
            ),
            *keys,
        )
    )
