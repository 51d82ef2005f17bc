"""Casts that give NULL for malformed text instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope.vocab import EVENT_TS_FORMAT


def try_double(col: Column) -> Column:
    return col.try_cast("double")


def try_ts(col: Column, pattern: str = EVENT_TS_FORMAT) -> Column:
    return F.try_to_timestamp(col, F.lit(pattern))


def event_date(ts: Column) -> Column:
    return F.to_date(ts)
