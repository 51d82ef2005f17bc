"""Alarms on streams.

The batch operators already consist of streaming-safe windows, so a watermark is all that is
added.  Rows later than the watermark are dropped; a period is reported once it is closed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from jobscope.operators import alarms


def stream_sum_alarm(
    metrics: DataFrame,
    ts: str,
    value: str,
    keys: Sequence[str] = (),
    threshold: float = 1,
    watermark: str = "10 minutes",
) -> DataFrame:
    return alarms.sum_alarm(metrics.withWatermark(ts, watermark), ts, value, keys, threshold)


def stream_idle_alarm(
    metrics: DataFrame,
    ts: str,
    value: str,
    keys: Sequence[str] = (),
    threshold: float = 1,
    watermark: str = "10 minutes",
) -> DataFrame:
    return alarms.idle_alarm(metrics.withWatermark(ts, watermark), ts, value, keys, threshold)
